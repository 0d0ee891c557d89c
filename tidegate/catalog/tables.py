"""Queries over flow tables and predictions: cleaning, sampling, exploration, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog import surrogates as S
from tidegate.catalog.registry import register
from tidegate.operators import cleaning as C
from tidegate.operators import eda as E
from tidegate.operators import metrics as M
from tidegate.operators import sampling as SA
from tidegate.operators.decisions import threshold_decision
from tidegate.plans.prepare import clean_flows
from tidegate.sources.tables import read_prepared

SEED = 42
PW = "WITH " + S.PREPARED_SQL + " "
DW = "WITH " + S.DIRTY_SQL + " "
SW = "WITH " + S.SCORED_SQL + " "
TW = "WITH " + S.THREE_SQL + " "


def on(view, fn):
    return lambda spark, sf: fn(view(spark, sf))


def rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- cleaning -------------------------------------------------------------------
register("scan_prepared", lambda spark, sf: read_prepared(spark, f"{sf}/lineitem.parquet").select(
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
register("drop_identifiers", on(S.dirty, lambda d: C.drop_identifiers(d).withColumns(
    {"qty": F.col("qty").cast("double"), "rate": F.col("rate").isNull(), "Label": F.trim("Label")})),
    DW + 'SELECT qty, kind IS NULL AS rate, disc, tax, "Label" FROM dirty_v')
register("coerce_numeric", on(S.dirty, lambda d: C.coerce_numeric(d).select(
    F.col("Flow ID").alias("flow_no"), "qty", "rate", "disc", "tax")),
    DW + "SELECT CAST(k AS DOUBLE) AS flow_no, qty, rate, disc, tax FROM dirty_v")
register("inf_to_null", on(S.dirty, C.count_infinite),
         DW + "SELECT count(*) FILTER (kind IN ('Infinity', ' -inf ')) AS n_infinite FROM dirty_v")
register("drop_missing", on(S.dirty, lambda d: C.drop_missing(C.coerce_numeric(d)).select(
    F.col("Flow ID").alias("flow_no"), "rate")),
    DW + "SELECT CAST(k AS DOUBLE) AS flow_no, rate FROM dirty_v WHERE rate IS NOT NULL")
register("drop_duplicates", on(S.dirty, lambda d: C.drop_duplicates(C.coerce_numeric(C.drop_identifiers(d))).withColumn(
    "Label", F.trim("Label"))),
    DW + 'SELECT DISTINCT qty, rate, disc, tax, "Label" FROM dirty_v')
register("normalise_labels", on(S.flows, lambda d: C.normalise_labels(d).select("l_orderkey", "l_linenumber", "Label", "Category")),
         PW + 'SELECT l_orderkey, l_linenumber, "Label", "Category" FROM prepared_v')
register("category_distribution", on(S.prepared, C.category_distribution),
         PW + 'SELECT "Category", count(*) AS n FROM prepared_v GROUP BY 1')
# The threshold lies between the category sizes, so some are dropped at every scale.
_RARE = PW.rstrip() + """, c AS (SELECT "Category", count(*) AS n FROM prepared_v GROUP BY 1)
SELECT "Category", n FROM c WHERE n >= (SELECT CAST(floor(avg(n)) AS BIGINT) FROM c) OR "Category" = 'BENIGN'"""


def _drop_rare(df):
    mean = df.groupBy("Category").count().agg(F.floor(F.avg("count"))).first()[0]
    return C.category_distribution(C.drop_rare_categories(df, mean))


register("drop_rare_categories", on(S.prepared, _drop_rare), _RARE)
def _padded(spark, sf):
    """Columns whose names have blanks around them."""
    d = S.dirty(spark, sf).select(F.col("Flow ID").alias("flow_no"), "disc", "tax")
    return C.strip_headers(d.toDF(*[f" {c}\t" for c in d.columns]))


register("strip_headers", _padded, "WITH " + S.DIRTY_SQL + " SELECT k AS flow_no, disc, tax FROM dirty_v")
register("label_normalise_types", lambda spark, sf: C.normalise_label_types(
    C.split_features_labels(S.prepared(spark, sf)).withColumn("y", F.col("y").cast("string"))).select(
    *S.FLOW_COLUMNS, "y", "category"), PW + """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST("Category" <> 'BENIGN' AS INTEGER) AS y, "Category" AS category
FROM prepared_v""")
register("split_features_labels", on(S.prepared, C.split_features_labels), PW + """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN "Category" = 'BENIGN' THEN 0 ELSE 1 END AS y,
  "Category" AS category FROM prepared_v""")
register("prepare", on(S.dirty, lambda d: C.category_distribution(clean_flows(d, fraction=0.2, seed=SEED, min_samples=1))),
         DW + """
SELECT "Category", CAST(round_even(0.2 * count(*), 0) AS BIGINT) AS n FROM
  (SELECT DISTINCT qty, rate, disc, tax, "Label", "Category" FROM dirty_v WHERE rate IS NOT NULL) d GROUP BY 1""")
register("feature_frame_sanitise", on(S.dirty, lambda d: C.sanitise_features(d.select(
    F.col("Flow ID").alias("k"), C.to_number(F.col("rate")).alias("rate"), "disc"), ["rate", "disc"]).select(
    "k", F.col("rate").cast("double"), F.col("disc").cast("double"))), DW + """
SELECT k, CASE kind WHEN 'Infinity' THEN 3.4028234663852886e38 WHEN ' -inf ' THEN -3.4028234663852886e38
  ELSE CAST(CAST(coalesce(rate, 0) AS FLOAT) AS DOUBLE) END AS rate, CAST(CAST(disc AS FLOAT) AS DOUBLE) AS disc FROM dirty_v""")
register("mask_category", on(S.prepared, lambda d: C.category_distribution(C.mask_category(d, "DDoS", "Category"))),
         PW + """SELECT "Category", count(*) AS n FROM prepared_v WHERE "Category" <> 'DDoS' GROUP BY 1""")
register("threshold_decision", on(S.scored, lambda d: threshold_decision(d, 0.25).select("row_id", "yhat")),
         SW + "SELECT row_id, CASE WHEN p >= 0.25 THEN 1 ELSE 0 END AS yhat FROM scored_v")

# ---- sampling ---------------------------------------------------------------------
register("stratified_sample", lambda spark, sf: C.category_distribution(SA.stratified_sample(
    C.normalise_labels(S.flows(spark, sf)), 0.2, SEED)), PW + """
SELECT "Category", CAST(round_even(0.2 * count(*), 0) AS BIGINT) AS n FROM prepared_v GROUP BY 1""")
register("stratified_split", lambda spark, sf: SA.stratified_split(
    C.normalise_labels(S.flows(spark, sf)), 0.2, 0.1, SEED, by="Category").groupBy("Category", "split").agg(
    F.count(F.lit(1)).alias("n")), PW.rstrip() + """,
c AS (SELECT "Category" AS cat, count(*) AS n FROM prepared_v GROUP BY 1),
t AS (SELECT sum(n) AS n_all, sum(n) - ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS keep FROM c),
u AS (SELECT n_all, keep, keep - ceil(keep * CAST(0.125 AS DOUBLE)) AS train FROM t),
a AS (SELECT cat, n, keep, train, keep * n / n_all AS e FROM c, u),
a2 AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, cat) <= keep - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS r FROM a),
b AS (SELECT *, train * r / sum(r) OVER () AS e2 FROM a2),
b2 AS (SELECT *, floor(e2) + CASE WHEN row_number() OVER (ORDER BY e2 - floor(e2) DESC, cat) <= train - sum(floor(e2)) OVER () THEN 1 ELSE 0 END AS tr FROM b)
SELECT cat AS "Category", 'test' AS split, CAST(n - r AS BIGINT) AS n FROM b2
UNION ALL SELECT cat, 'val', CAST(r - tr AS BIGINT) FROM b2 UNION ALL SELECT cat, 'train', CAST(tr AS BIGINT) FROM b2""")
register("class_cap", lambda spark, sf: C.category_distribution(SA.class_cap(
    C.normalise_labels(S.flows(spark, sf)), 5000, SEED, by="Category")),
    PW + 'SELECT "Category", least(count(*), 5000) AS n FROM prepared_v GROUP BY 1')


def _null_strata(spark, sf):
    """Sample, cap and split of rows of which a part has no category: per category, how many, and how many foreign."""
    rows = S.table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category"))
    parts = {
        "sample": SA.stratified_sample(rows, 0.25, SEED, "category", key=["o_orderkey"]),
        "cap": SA.class_cap(rows, 100, SEED, key=["o_orderkey"]),
        "copies": SA.class_cap(rows.select("category", F.lit(1).alias("same")), 100, SEED),
        "folds": SA.stratified_folds(rows, 4, SEED, "category", key=["o_orderkey"]).filter("fold = 0").drop("fold"),
    }
    out = None
    for name, part in parts.items():
        if "o_orderkey" in part.columns:
            own = part.groupBy("category").agg(
                F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))
        else:
            own = part.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("n_distinct"))
        own = own.withColumn("part", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


register("null_strata", _null_strata, """
WITH c AS (SELECT nullif(o_orderpriority, '5-LOW') AS category, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT category, 'sample' AS part, CAST(round_even(n * 0.25, 0) AS BIGINT) AS n FROM c
  UNION ALL SELECT category, 'cap', least(n, 100) FROM c UNION ALL SELECT category, 'copies', least(n, 100) FROM c
  UNION ALL SELECT category, 'folds', CAST(n // 4 AS BIGINT) FROM c)
SELECT category, part, n, n AS n_distinct FROM p""")
register("subsample_rows", lambda spark, sf: SA.subsample_rows(S.flows(spark, sf), 20_000, SEED).agg(
    F.count(F.lit(1)).alias("n")), "SELECT least(count(*), 20000) AS n FROM lineitem")
register("stratified_folds", lambda spark, sf: SA.stratified_folds(S.scored(spark, sf), 3, SEED, key=["row_id"]).groupBy(
    "y", "fold").agg(F.count(F.lit(1)).alias("n")), SW.rstrip() + """,
c AS (SELECT y, count(*) AS n FROM scored_v GROUP BY y)
SELECT y, CAST(f AS INTEGER) AS fold, CAST((f + 1) * n // 3 - f * n // 3 AS BIGINT) AS n FROM c, (SELECT unnest([0, 1, 2]) AS f) g""")

# ---- exploration --------------------------------------------------------------------
_LONG = """,
long_v AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, \"Category\", {c} AS v FROM prepared_v" for c in S.FLOW_COLUMNS) + ")"
register("eda_class_distribution", on(S.prepared, lambda d: rounded(E.class_distribution(d), 4, "pct")), PW + """
SELECT "Category", count(*) AS n, round(100.0 * count(*) / CAST((SELECT count(*) FROM prepared_v) AS DOUBLE), 4) AS pct
FROM prepared_v GROUP BY 1""")
register("eda_missing_audit", on(S.dirty, lambda d: E.missing_audit(C.coerce_numeric(d))), DW.rstrip() + """,
n AS (SELECT count(*) AS rows, count(*) FILTER (rate IS NULL) AS gone FROM dirty_v)
SELECT f AS feature, CASE WHEN f = 'rate' THEN gone ELSE 0 END AS missing, CASE WHEN f = 'rate' THEN rows - gone ELSE rows END AS present
FROM n, (SELECT unnest(['Flow ID', 'Source Port', 'Destination Port', 'qty', 'rate', 'disc', 'tax']) AS f) names""")
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) + 0.0 AS r FROM prepared_v"
    for a in S.FLOW_COLUMNS for b in S.FLOW_COLUMNS)
register("eda_corr_matrix", on(S.prepared, E.corr_matrix), PW + _PAIRS)
_LABEL_R = _LONG + """,
r_v AS (SELECT feature, corr(v, CASE WHEN "Category" = 'BENIGN' THEN 0.0 ELSE 1.0 END) AS r FROM long_v GROUP BY feature)"""
register("eda_label_correlation", on(S.prepared, lambda d: rounded(E.label_correlation(d), 6, "r")),
         PW.rstrip() + _LABEL_R + " SELECT feature, round(r, 6) + 0.0 AS r FROM r_v")
_BOX_COLS = ["q1", "median", "q3", "whisker_low", "whisker_high"]
register("eda_boxplot_stats", on(S.prepared, lambda d: rounded(E.boxplot_stats(d, S.FLOW_COLUMNS), 4, *_BOX_COLS)),
         PW.rstrip() + _LONG + """,
tails AS (SELECT feature, "Category", quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM long_v GROUP BY 1, 2),
trim_v AS (SELECT l.* FROM long_v l JOIN tails t ON l.feature = t.feature AND l."Category" = t."Category" WHERE v >= lo AND v <= hi),
box AS (SELECT feature, "Category", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
  FROM trim_v GROUP BY 1, 2)
SELECT b.feature, b."Category", any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high
FROM trim_v t JOIN box b ON t.feature = b.feature AND t."Category" = b."Category" GROUP BY 1, 2""")
register("eda_outlier_summary", on(S.prepared, E.outlier_summary), PW.rstrip() + _LONG + """,
box AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long_v GROUP BY 1)
SELECT b.feature, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  round(100.0 * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / CAST(count(*) AS DOUBLE), 2) AS outlier_pct
FROM long_v l JOIN box b ON l.feature = b.feature GROUP BY 1""")
register("eda_per_class_stats", on(S.prepared, lambda d: rounded(E.per_class_stats(d, S.FLOW_COLUMNS), 4, "mean", "median", "std")),
         PW.rstrip() + _LONG + """
SELECT feature, "Category" AS category, count(*) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median,
  round(stddev_samp(v), 4) AS std FROM long_v GROUP BY 1, 2""")
register("eda_summary", on(S.prepared, lambda d: rounded(E.summary(d), 6, "attack_ratio")), PW + """
SELECT count(*) AS rows, 6 AS columns, round(avg(CASE WHEN "Category" = 'BENIGN' THEN 0.0 ELSE 1.0 END), 6) AS attack_ratio FROM prepared_v""")

# ---- metrics -----------------------------------------------------------------------
_COUNTS = """counts_v AS (SELECT model, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 1 AND yhat = 0) AS fn FROM three_v GROUP BY model)"""
_D = "CAST({0} AS DOUBLE)"
_AUC = """auc_v AS (SELECT model, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - any_value(np) * (any_value(np) + 1) / 2.0) / (any_value(np) * any_value(nn)) AS roc_auc
  FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rk,
          CAST(sum(y) OVER (PARTITION BY model) AS DOUBLE) AS np, CAST(sum(1 - y) OVER (PARTITION BY model) AS DOUBLE) AS nn FROM three_v) r GROUP BY model)"""
_EDGES = ", ".join(repr(e) for e in M.unit_interval_edges(10)[1:-1])
_BIN = " ".join(f"WHEN p >= CAST({e!r} AS DOUBLE) THEN {i}" for i, e in reversed(list(enumerate(M.unit_interval_edges(10)))[1:-1]))
_BINS = f"""bins_v AS (SELECT model, CASE {_BIN} ELSE 0 END AS bin, avg(p) AS mean_p, avg(CAST(y AS DOUBLE)) AS observed, count(*) AS n
  FROM three_v GROUP BY 1, 2)"""
_ECE = "ece_v AS (SELECT model, sum(n * abs(mean_p - observed)) / sum(n) AS ece FROM bins_v GROUP BY model)"
_RATES = """rates_v AS (SELECT model, tp, fp, tn, fn,
  (2.0 * tp / (2.0 * tp + fp + fn) + 2.0 * tn / (2.0 * tn + fp + fn)) / 2 AS macro_f1,
  (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * CAST(tn + fp AS DOUBLE) * (tn + fn)) AS mcc,
  CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
  CAST(fp AS DOUBLE) / (fp + tn) AS false_positive_rate, CAST(fn AS DOUBLE) / (fn + tp) AS false_negative_rate FROM counts_v)"""
_RATE_COLS = list(M.RATES)
_ROUND_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in _RATE_COLS)
register("confusion_counts", on(S.three_models, M.confusion_counts),
         TW.rstrip() + f", {_COUNTS} SELECT model, tp, fp, tn, fn FROM counts_v")
register("binary_metrics", on(S.three_models, lambda d: rounded(M.binary_metrics(d), 6, *_RATE_COLS, "roc_auc")),
         TW.rstrip() + f""", {_COUNTS}, {_AUC}, {_RATES}
SELECT r.model, tp, fp, tn, fn, {_ROUND_RATES}, round(roc_auc, 6) AS roc_auc FROM rates_v r JOIN auc_v a ON r.model = a.model""")
register("roc_auc", on(S.three_models, lambda d: rounded(M.roc_auc(d), 6, "roc_auc")),
         TW.rstrip() + f", {_AUC} SELECT model, round(roc_auc, 6) AS roc_auc FROM auc_v")
register("pr_curve", on(S.three_models, lambda d: rounded(M.pr_curve(d), 6, "threshold", "precision", "recall")),
         TW.rstrip() + """,
g AS (SELECT model, p, sum(y) AS pos, count(*) AS n FROM three_v GROUP BY 1, 2),
h AS (SELECT model, p, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS flagged, CAST(sum(pos) OVER (PARTITION BY model) AS DOUBLE) AS np
  FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(p, 6) AS threshold, round(tp / flagged, 6) AS precision, round(tp / np, 6) AS recall FROM h
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM g""")
register("per_category_recall", on(S.three_models, lambda d: rounded(M.per_category_recall(d), 6, "recall")), TW + """
SELECT model, category, round(avg(CASE WHEN category = 'BENIGN' THEN 1.0 - yhat ELSE yhat END), 6) AS recall FROM three_v GROUP BY 1, 2""")
_MODELS = ["ModelA", "ModelB", "ModelC"]
register("recall_pivot", on(S.three_models, lambda d: rounded(M.recall_pivot(M.per_category_recall(d), _MODELS), 6, *_MODELS)),
         TW + "SELECT category, " + ", ".join(
             f"round(avg(CASE WHEN category = 'BENIGN' THEN 1.0 - yhat ELSE yhat END) FILTER (model = '{m}'), 6) AS \"{m}\""
             for m in _MODELS) + " FROM three_v GROUP BY category")
register("reliability_curve", on(S.three_models, lambda d: rounded(M.reliability_curve(d), 9, "mean_p", "observed")),
         TW.rstrip() + f""", {_BINS}
SELECT m.model, CAST(b.bin AS INTEGER) AS bin, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model FROM three_v) m CROSS JOIN (SELECT unnest(range(10)) AS bin) b
LEFT JOIN bins_v v ON v.model = m.model AND v.bin = b.bin""")
register("expected_calibration_error", on(S.three_models, lambda d: rounded(M.expected_calibration_error(d), 6, "ece")),
         TW.rstrip() + f", {_BINS}, {_ECE} SELECT model, round(ece, 6) AS ece FROM ece_v")
_ALL = ", ".join(f"round({c}, 6) AS {c}" for c in [*_RATE_COLS, "roc_auc", "ece"])
_EVALUATE = TW.rstrip() + f""", {_COUNTS}, {_AUC}, {_RATES}, {_BINS}, {_ECE}
SELECT r.model, {_ALL}, tp, fp, tn, fn FROM rates_v r JOIN auc_v a ON r.model = a.model JOIN ece_v e ON r.model = e.model"""
register("evaluate_models", on(S.three_models, lambda d: rounded(M.evaluate_models(d), 6, *_RATE_COLS, "roc_auc", "ece")), _EVALUATE)
register("report_tables", on(S.three_models, lambda d: M.rounded(M.evaluate_models(d))), _EVALUATE.replace(", 6)", ", 4)"))


def _held_out(df):
    """Every row once per held-out category, as if one model had been fitted for each."""
    categories = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup")])
    return df.withColumn("held_out_category", F.explode(categories)).withColumn(
        "yhat", ((F.col("p") >= 0.5) & (F.col("category") != F.col("held_out_category"))
                 | (F.col("p") >= 0.9)).cast("int")).withColumn("y", (F.col("category") != "BENIGN").cast("int"))


_LOACO = SW.rstrip() + """,
h AS (SELECT hc AS held_out_category, category, CASE WHEN category = 'BENIGN' THEN 0 ELSE 1 END AS y,
  CASE WHEN (p >= 0.5 AND category <> hc) OR p >= 0.9 THEN 1 ELSE 0 END AS yhat
  FROM scored_v, (SELECT unnest(['click', 'error', 'purchase', 'signup']) AS hc) c),
c AS (SELECT held_out_category, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 1 AND yhat = 0) AS fn,
  avg(CAST(yhat AS DOUBLE)) FILTER (category = held_out_category) AS novel,
  avg(CAST(yhat AS DOUBLE)) FILTER (category <> held_out_category AND category <> 'BENIGN') AS known,
  avg(1.0 - yhat) FILTER (category = 'BENIGN') AS tnr FROM h GROUP BY 1)"""
_LOACO_COLS = ["novel_recall", "known_attack_recall", "true_negative_rate", "overall_macro_f1", "overall_mcc", "overall_fpr"]
register("loaco_metrics", on(S.scored, lambda d: rounded(M.loaco_metrics(_held_out(d)), 6, *_LOACO_COLS)), _LOACO + """
SELECT held_out_category, round(novel, 6) AS novel_recall, round(known, 6) AS known_attack_recall, round(tnr, 6) AS true_negative_rate,
  round((2.0 * tp / (2.0 * tp + fp + fn) + 2.0 * tn / (2.0 * tn + fp + fn)) / 2, 6) AS overall_macro_f1,
  round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * CAST(tn + fp AS DOUBLE) * (tn + fn)), 6) AS overall_mcc,
  round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS overall_fpr FROM c""")
register("loaco_summary", on(S.scored, lambda d: rounded(M.loaco_summary(M.loaco_metrics(_held_out(d))), 6,
                                                        "mean_novel_recall", "mean_known_recall", "gap")), _LOACO + """
SELECT round(avg(novel), 6) AS mean_novel_recall, round(avg(known), 6) AS mean_known_recall, round(avg(known) - avg(novel), 6) AS gap FROM c""")
_CONFIGURED = ["DoS", "DDoS", "PortScan", "Brute Force", "Web Attack", "Bot"]
register("loaco_category_check", on(S.prepared, lambda d: M.loaco_categories(d, _CONFIGURED, "Category").drop("position")), PW + """
SELECT c AS category, c IN (SELECT "Category" FROM prepared_v) AS present FROM
  (SELECT unnest(['DoS', 'DDoS', 'PortScan', 'Brute Force', 'Web Attack', 'Bot']) AS c) t""")
