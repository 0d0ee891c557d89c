"""Round trips through sources and sinks: derived tables are written, read back and compared."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegate.catalog import models as CM
from tidegate.catalog import surrogates as S
from tidegate.catalog.registry import register
from tidegate.models import stack as ST
from tidegate.operators import cleaning as C
from tidegate.operators import decisions as OD
from tidegate.operators import metrics as M
from tidegate.operators import report as RP
from tidegate.operators.sampling import stratified_split
from tidegate.plans import train as TR
from tidegate.session import scratch_path
from tidegate.sinks.decisions import write_bulk, write_decisions_csv
from tidegate.sinks.tables import write_prepared, write_splits, write_tables
from tidegate.sources.flow_csv import discover, headers, load_raw
from tidegate.sources.tables import read_decisions_csv, read_ground_truth
from tidegate.streaming.live import run_available

PARTS, ROWS_PER_FILE = 16, 100_000
DW = "WITH " + S.DECISIONS_SQL + " "


def _load_raw(spark, sf):
    """Raw flow CSVs in two layouts, one of them without the tax column."""
    path = scratch_path(spark, "raw")
    raw = S.dirty(spark, sf).withColumnsRenamed({"qty": " qty", "Label": " Label"})
    even = F.pmod(F.col("Flow ID"), F.lit(2)) == 0
    raw.filter(even).write.option("header", True).csv(f"{path}/a")
    raw.filter(~even).drop("tax").write.option("header", True).csv(f"{path}/b")
    clean = C.coerce_numeric(load_raw(spark, path))
    return clean.select(F.col("Flow ID").alias("flow_no"), "qty", "rate", "tax", "Label")


register("load_raw", _load_raw, "WITH " + S.DIRTY_SQL + """
SELECT CAST(k AS DOUBLE) AS flow_no, qty, rate, CASE WHEN k % 2 = 0 THEN tax END AS tax, "Label" FROM dirty_v""")


def _scan_flow_csv(spark, sf):
    """The folders of a tree and the header lines of their files; every second part has other columns."""
    path, raw = scratch_path(spark, "flow-files"), S.dirty(spark, sf)
    shares = max(1, math.ceil(raw.count() / (PARTS * ROWS_PER_FILE)))
    raw = raw.withColumn("part", F.pmod(F.col("Flow ID"), F.lit(PARTS)))
    raw = raw.repartition(PARTS * shares, "part", F.pmod(F.xxhash64("Flow ID"), F.lit(shares)))
    odd = F.col("part") % 2 == 1
    for name, rows in (("a", raw.filter(odd)), ("b", raw.filter(~odd).drop("tax"))):
        rows.write.partitionBy("part").option("header", True).csv(f"{path}/{name}")
    files = headers(discover(spark, path)).select(F.col("line").cast("string").alias("header"), F.explode("paths").alias("path"))
    return files.select("header", F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part")).distinct()


register("scan_flow_csv", _scan_flow_csv, """
SELECT DISTINCT CASE WHEN l_orderkey % 2 = 1 THEN 'Flow ID,Source Port,Destination Port,qty,rate,disc,tax,Label'
                     ELSE 'Flow ID,Source Port,Destination Port,qty,rate,disc,Label' END AS header,
  CAST(l_orderkey % 16 AS BIGINT) AS part FROM lineitem""")


def _metrics_tables(spark, sf):
    """Result tables of three models, written as CSV and read back."""
    path, predictions = scratch_path(spark, "tables"), S.three_models(spark, sf)
    write_tables({"confusion": M.confusion_counts(predictions), "per_category_recall": M.per_category_recall(predictions)},
                 path, "csv")
    csv = spark.read.option("header", True).option("inferSchema", True).csv
    counts = csv(f"{path}/confusion").select("model", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")])
    recalls = csv(f"{path}/per_category_recall").select("model", "category", F.round("recall", 6).alias("recall"))
    return recalls.join(counts, "model")


register("metrics_tables", _metrics_tables, "WITH " + S.THREE_SQL + """,
c AS (SELECT model, count(*) FILTER (yhat = 1 AND y = 1) AS tp, count(*) FILTER (yhat = 1 AND y = 0) AS fp,
  count(*) FILTER (yhat = 0 AND y = 0) AS tn, count(*) FILTER (yhat = 0 AND y = 1) AS fn FROM three_v GROUP BY model),
r AS (SELECT model, category, round(avg(CASE WHEN (category = 'BENIGN') = (yhat = 0) THEN 1.0 ELSE 0.0 END), 6) AS recall
  FROM three_v GROUP BY model, category)
SELECT r.model, category, recall, tp, fp, tn, fn FROM r JOIN c ON r.model = c.model""")


def _decisions_csv(spark, sf):
    path = scratch_path(spark, "decisions-csv")
    write_decisions_csv(S.decisions(spark, sf), path)
    return read_decisions_csv(spark, path).withColumn("suricata_signature", F.coalesce("suricata_signature", F.lit("")))


register("write_decisions_csv", _decisions_csv, DW + """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port, proto,
  CAST(bytes_total AS DOUBLE) AS bytes_total, CAST(signature_alert AS INTEGER) AS suricata_alert, signature AS suricata_signature,
  round(model_proba, 6) AS ml_proba, CAST(model_decision AS INTEGER) AS ml_decision, CAST(fused_decision AS INTEGER) AS fused_decision,
  fusion_reason FROM decisions_v""")
register("scan_decisions_csv", lambda spark, sf: RP.signature_breakdown(OD.from_batch_records(_decisions_csv(spark, sf))), DW + """
SELECT signature, count(*) AS n FROM decisions_v WHERE signature_alert GROUP BY signature""")


def _truth_csv(spark, sf):
    path = scratch_path(spark, "truth-csv")
    S.truth(spark, sf).write.option("header", True).csv(path)
    return read_ground_truth(spark, path).groupBy("src_ip", "is_attack").agg(F.count(F.lit(1)).alias("n"))


register("scan_ground_truth", _truth_csv, "WITH " + S.TRUTH_SQL + """
SELECT src_ip, is_attack, count(*) AS n FROM truth_v GROUP BY 1, 2""")


def _bulk(spark, sf):
    path = scratch_path(spark, "bulk")
    write_bulk(S.decisions(spark, sf), path, "decisions")
    lines = spark.read.text(path)
    action = F.get_json_object("value", "$.index._index")
    return lines.groupBy(action.alias("target"), F.get_json_object("value", "$.verdict").alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"))


register("write_bulk", _bulk, DW + """
SELECT 'decisions' AS target, CAST(NULL AS VARCHAR) AS verdict, count(*) AS n FROM decisions_v
UNION ALL SELECT NULL, verdict, count(*) FROM decisions_v GROUP BY verdict""")
register("write_prepared", lambda spark, sf: write_prepared(S.prepared(spark, sf), scratch_path(spark, "prepared")),
         "WITH " + S.PREPARED_SQL + ' SELECT "Category", count(*) AS n FROM prepared_v GROUP BY 1')


def _splits(spark, sf):
    path = scratch_path(spark, "splits")
    rows = C.split_features_labels(S.prepared(spark, sf))
    write_splits(stratified_split(rows, 0.2, 0.1, CM.SETTINGS.seed), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


register("write_splits", _splits, """
WITH t AS (SELECT count(*) AS n, count(*) - ceil(CAST(0.2 AS DOUBLE) * count(*)) AS keep FROM lineitem),
u AS (SELECT n, keep, ceil(keep * CAST(0.125 AS DOUBLE)) AS val FROM t)
SELECT 'test' AS split, CAST(n - keep AS BIGINT) AS n FROM u UNION ALL SELECT 'val', CAST(val AS BIGINT) FROM u
UNION ALL SELECT 'train', CAST(keep - val AS BIGINT) FROM u""")


def _stream_scoring(spark, sf):
    """A fitted stack scores the rows as a stream; every probability equals the batch score."""
    rows = CM.vectors(spark, sf)
    table = CM.splits(spark, sf)
    model = ST.fit_stack(TR.part(table, "train"), TR.part(table, "val"), CM.SETTINGS)
    path, out = scratch_path(spark, "vectors"), scratch_path(spark, "scored")
    rows.select("row_id", "features").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    run_available(model.transform(stream).select("row_id", F.col("p").alias("streamed")), out, scratch_path(spark, "state"))
    both = model.transform(rows).select("row_id", "p").join(spark.read.parquet(out), "row_id", "full")
    return both.select("row_id", (F.abs(F.col("p") - F.col("streamed")) < 1e-12).alias("same"))


register("stream_scoring", _stream_scoring, "SELECT vec_id AS row_id, true AS same FROM embeddings")
