"""Queries over feature vectors: scaling, balancing, model fits and scores.

Fits run on the embedding table with the library's settings.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegate.catalog import surrogates as S
from tidegate.catalog.registry import register
from tidegate.config import Config, LoacoConfig
from tidegate.functions.numbers import logistic
from tidegate.models import features as FE
from tidegate.models import forest as FO
from tidegate.models import isolation as IS
from tidegate.models import linear as LI
from tidegate.models import oneclass as OC
from tidegate.models import stack as ST
from tidegate.operators import metrics as M
from tidegate.operators.cleaning import split_features_labels
from tidegate.operators.sampling import stratified_split
from tidegate.operators.smote import smote
from tidegate.plans import evaluate as EV
from tidegate.plans import preprocess as PP
from tidegate.plans import train as TR
from tidegate.session import stage

NAMES = [f"f{i:02d}" for i in range(64)]
#: The library's settings, with which every fit takes all rows.
SETTINGS = Config()
VW = "WITH " + S.VECTORS_SQL + " "
PW = "WITH " + S.PREPARED_SQL + " "


def labelled(spark, sf):
    return split_features_labels(S.vectors(spark, sf).drop("Label"))


def vectors(spark, sf):
    """row_id, features, y, category of the embedding table."""
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(labelled(spark, sf))
    return stage(rows.select("row_id", "features", "y", "category"), "vectors")


def splits(spark, sf):
    return stage(stratified_split(vectors(spark, sf), 0.2, 0.1, SETTINGS.seed, key=["row_id"]), "splits")


def scores(df):
    return df.select("row_id", F.round("p", 6).alias("p"))


register("standard_scale", lambda spark, sf: FE.standard_scale(S.prepared(spark, sf), S.FLOW_COLUMNS).select(
    *[F.round(c, 6).alias(c) for c in S.FLOW_COLUMNS]),
    PW + "SELECT " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in S.FLOW_COLUMNS)
    + " FROM prepared_v")
register("isolation_forest_score", lambda spark, sf: IS.scale_scores(S.scored(spark, sf).drop("y"), raw="p", output="scaled").select(
    "row_id", F.round("scaled", 6).alias("scaled")), "WITH " + S.SCORED_SQL + """
SELECT row_id, round((p - (SELECT min(p) FROM scored_v)) / ((SELECT max(p) FROM scored_v) - (SELECT min(p) FROM scored_v)), 6) AS scaled FROM scored_v""")


def _smote(spark, sf):
    rows = vectors(spark, sf).withColumn("x", vector_to_array("features"))
    return smote(rows, 5, SETTINGS.seed).groupBy("category", "y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


register("smote", _smote, VW.rstrip() + """,
c AS (SELECT category, count(*) AS n FROM vectors_v GROUP BY 1), m AS (SELECT max(n) AS m FROM c)
SELECT category, CASE WHEN category = 'BENIGN' THEN 0 ELSE 1 END AS y, false AS synthetic, n FROM c
UNION ALL SELECT category, CASE WHEN category = 'BENIGN' THEN 0 ELSE 1 END, true, m - n FROM c, m WHERE m > n""")


def _pipeline(spark, sf):
    rows, options = labelled(spark, sf), SETTINGS.preprocess
    return rows, FE.fit_feature_pipeline(rows, NAMES, options.rfe_features, options.pca_variance)


def _rfe(spark, sf):
    _, fitted = _pipeline(spark, sf)
    return spark.createDataFrame([(i, c) for i, c in enumerate(fitted.selected)], "position int, feature string")


def _apply(spark, sf):
    rows, fitted = _pipeline(spark, sf)
    entries = vector_to_array("features")
    finite = F.forall(entries, lambda v: F.abs(v) < F.lit(float("inf")))
    return fitted.transform(rows.drop(fitted.selected[0])).select("row_id", finite.alias("finite"))


register("rfe_select", _rfe)
register("fit_feature_pipeline", lambda spark, sf: _pipeline(spark, sf)[1].diagnostics(spark))
register("apply_feature_pipeline", _apply, "SELECT vec_id AS row_id, true AS finite FROM embeddings")


def _pca(spark, sf):
    from pyspark.ml.feature import PCA

    rows = FE.standard_scale(labelled(spark, sf), NAMES)
    model = PCA(k=len(NAMES), inputCol="v", outputCol="pc").fit(VectorAssembler(inputCols=NAMES, outputCol="v").transform(rows))
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    table = spark.createDataFrame(shares, "component int, share double")
    return table.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("share"), 6).alias("total"))


register("pca_variance", _pca, "SELECT any_value(len(embedding)) AS components, 1.0 AS total FROM embeddings")


def _svc(spark, sf):
    rows = vectors(spark, sf)
    return scores(LI.fit_linear_svc(rows, max_iter=SETTINGS.models.svc_max_iter).transform(rows))


def _one_class(spark, sf):
    rows = vectors(spark, sf)
    detector, = OC.fit_one_class(rows.filter("y = 0"), [0.1], SETTINGS.models.one_class_iterations)
    inside = LI.with_array(rows).select("row_id", "y", (-detector.anomaly()).alias("decision"))
    # At most about a share of nu of the benign rows lies outside.
    return inside.filter("y = 0").agg((F.avg((F.col("decision") < 0).cast("double")) <= 0.12).alias("within_nu"))


def _calibrated(method):
    def run(spark, sf):
        rows = vectors(spark, sf)
        detector, = OC.fit_one_class(rows.filter("y = 0"), [0.1], SETTINGS.models.one_class_iterations)
        p = OC.calibrate(detector, rows, method).transform(rows)
        return p.select("row_id", F.col("p").between(0, 1).alias("in_range"))

    return run


def _grid(spark, sf):
    rows = vectors(spark, sf)
    detectors = OC.fit_one_class(rows.filter("y = 0"), SETTINGS.models.nu_grid, SETTINGS.models.one_class_iterations)
    best, area = OC.search_detector(detectors, rows)
    return spark.createDataFrame([(best.nu, area)], "nu double, roc_auc double")


register("linear_svc_calibrated", _svc)
register("one_class_svm", _one_class, "SELECT count(*) > 0 AS within_nu FROM embeddings")
register("calibrate_sigmoid", _calibrated("sigmoid"), "SELECT vec_id AS row_id, true AS in_range FROM embeddings")
register("calibrate_isotonic", _calibrated("isotonic"), "SELECT vec_id AS row_id, true AS in_range FROM embeddings")
register("anomaly_grid_search", _grid)


def _forest(spark, sf):
    rows = vectors(spark, sf)
    model = FO.fit_random_forest(rows, SETTINGS.models.forest_trees, SETTINGS.models.forest_depth, SETTINGS.seed)
    return scores(FO.score_forest(model, rows))


def _kfold(spark, sf):
    score = FO.forest_cv_score(
        vectors(spark, sf), SETTINGS.models.forest_trees, SETTINGS.models.forest_depth, SETTINGS.seed,
        SETTINGS.models.forest_cv_rows)
    return spark.createDataFrame([(score,)], "macro_f1 double")


def _isolation(spark, sf):
    rows = vectors(spark, sf)
    forest = IS.fit_isolation_forest(rows.filter("y = 0"), SETTINGS.models.isolation_trees, seed=SETTINGS.seed)
    return forest.transform(rows).select("row_id", "yhat", F.round("raw", 6).alias("raw"))


def _isolation_nodes(spark, sf):
    forest = IS.fit_isolation_forest(vectors(spark, sf).filter("y = 0"), SETTINGS.models.isolation_trees, seed=SETTINGS.seed)
    inner = (forest.feature >= 0).sum(axis=1)
    return spark.createDataFrame([(int(t), int(n)) for t, n in enumerate(inner)], "tree int, inner_nodes int")


def _stack(spark, sf):
    table = splits(spark, sf)
    train, validation, test = (TR.part(table, n) for n in ("train", "val", "test"))
    return scores(ST.fit_stack(train, validation, SETTINGS).transform(test))


def _train_all(spark, sf):
    table = splits(spark, sf)
    return EV.evaluate(table, TR.train_all(table, SETTINGS), SETTINGS)["metrics_summary"]


def attack_classes(table):
    """Every class of the table but the benign one."""
    rows = table.filter("y = 1").select("category").distinct().orderBy("category").collect()
    return tuple(r.category for r in rows)


def _loaco(spark, sf):
    table = splits(spark, sf)
    return EV.loaco(table, replace(SETTINGS, loaco=LoacoConfig(categories=attack_classes(table))))


register("random_forest", _forest)
register("kfold_cv", _kfold)
register("isolation_forest_predict", _isolation)
register("isolation_forest_fit", _isolation_nodes)
register("stack_predict", _stack)
register("train_all", _train_all)
register("loaco", _loaco)


def _meta_learner(spark, sf):
    """The logistic meta-learner on two scores a row; without penalty on the intercept the mean probability is the rate."""
    rows = S.scored(spark, sf).select("row_id", "y", F.col("p").alias("p_supervised"), (F.col("p") * F.col("p")).alias("p_anomaly"))
    rows = stage(rows, "meta")
    options = SETTINGS.models
    scores_by_c = ST.meta_scores(rows, options.meta_c_grid, SETTINGS.seed, options.meta_max_iter)
    best = max(options.meta_c_grid, key=lambda c: (scores_by_c[c], -options.meta_c_grid.index(c)))
    (weights, intercept), = LI.logistic_fits(rows, [LI.LogisticTask(ST.STACK_INPUTS, best)], options.meta_max_iter)
    p = logistic(LI.linear(ST.STACK_INPUTS, [*weights, intercept]))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"))


register("stack_meta_learner", _meta_learner, "WITH " + S.SCORED_SQL + """
SELECT count(*) AS n, round(avg(y), 6) AS mean_p FROM scored_v""")


def _split_sizes(spark, sf):
    rows, _ = PP.split_table(S.prepared(spark, sf), SETTINGS)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


register("preprocess_split", _split_sizes, """
WITH t AS (SELECT count(*) AS n, count(*) - ceil(CAST(0.2 AS DOUBLE) * count(*)) AS keep FROM lineitem),
u AS (SELECT n, keep, ceil(keep * CAST(0.125 AS DOUBLE)) AS val FROM t)
SELECT 'test' AS split, CAST(n - keep AS BIGINT) AS n FROM u UNION ALL SELECT 'val', CAST(val AS BIGINT) FROM u
UNION ALL SELECT 'train', CAST(keep - val AS BIGINT) FROM u""")
