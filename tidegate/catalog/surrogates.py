"""The given tables seen as flow-security tables, once as DataFrames and once as SQL text.

The mapping is arithmetic on whole tables; nothing is filtered, sampled or generated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators import decisions as OD
from tidegate.schemas import EVENT

EVENTS_PER_TASK = 50_000
SIG_SSH = "LOCAL SSH connection attempt"
SIG_POST = "LOCAL HTTP POST to login endpoint"
SIG_UNION = "LOCAL Possible SQL injection (UNION SELECT)"
SIG_ICMP = "LOCAL ICMP echo request seen"
SIG_SCAN = "LOCAL Possible TCP SYN scan"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key, values, default):
    out = F.lit(default)
    for i, value in enumerate(values):
        out = F.when(key == i, F.lit(value)).otherwise(out)
    return out


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flows with a signature text and a model probability."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    port = F.pmod(i, F.lit(5))
    signature = (
        F.when(F.col("event_type") == "error", _case(F.pmod(i, F.lit(4)), [SIG_SSH, SIG_POST, SIG_UNION], SIG_ICMP))
        .when((F.col("event_type") == "signup") & (F.pmod(i, F.lit(3)) == 0), F.lit(SIG_SCAN))
        .otherwise(F.lit(""))
    )
    return e.select(
        i.cast("string").alias("flow_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("10.0.0."), u.cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.10."), (F.pmod(i, F.lit(20)) + 20).cast("string")).alias("dst_ip"),
        _case(port, [80, 443, 22, 21], 53).alias("dst_port"),
        F.when(port == 4, F.lit("UDP")).otherwise(F.lit("TCP")).alias("proto"),
        F.pmod(i, F.lit(13)).alias("pkts_to"),
        F.pmod(u, F.lit(11)).alias("pkts_from"),
        F.floor(F.col("value") * 10).alias("bytes_to"),
        F.pmod(u * 37, F.lit(5000)).alias("bytes_from"),
        F.pmod(i * 7919, F.lit(5_000_000)).alias("duration_us"),
        signature.alias("signature"),
        (F.pmod(i * 7919, F.lit(1000)) / F.lit(1000.0)).alias("model_proba"),
        "event_type",
    )


FLOWS_SQL = f"""
flows_v AS (
  SELECT CAST(event_id AS VARCHAR) AS flow_id, event_id, user_id, event_type, ts,
    '10.0.0.' || CAST(user_id AS VARCHAR) AS src_ip,
    '192.168.10.' || CAST(event_id % 20 + 20 AS VARCHAR) AS dst_ip,
    CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 21 ELSE 53 END AS dst_port,
    CASE WHEN event_id % 5 = 4 THEN 'UDP' ELSE 'TCP' END AS proto,
    event_id % 13 AS pkts_to, user_id % 11 AS pkts_from,
    CAST(floor(value * 10) AS BIGINT) AS bytes_to, (user_id * 37) % 5000 AS bytes_from,
    (event_id * 7919) % 5000000 AS duration_us,
    CASE WHEN event_type = 'error' THEN
           CASE event_id % 4 WHEN 0 THEN '{SIG_SSH}' WHEN 1 THEN '{SIG_POST}' WHEN 2 THEN '{SIG_UNION}' ELSE '{SIG_ICMP}' END
         WHEN event_type = 'signup' AND event_id % 3 = 0 THEN '{SIG_SCAN}' ELSE '' END AS signature,
    CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS model_proba
  FROM events)"""

DECISIONS_SQL = FLOWS_SQL + """,
decisions_v AS (
  SELECT *, bytes_to + bytes_from AS bytes_total, pkts_to + pkts_from AS pkts_total,
    signature <> '' AS signature_alert, model_proba >= 0.5 AS model_decision,
    signature <> '' OR model_proba >= 0.5 AS fused_decision,
    CASE WHEN signature <> '' AND model_proba >= 0.5 THEN 'suricata+ml' WHEN signature <> '' THEN 'suricata'
         WHEN model_proba >= 0.5 THEN 'ml' ELSE 'none' END AS fusion_reason,
    CASE WHEN signature <> '' AND model_proba >= 0.5 THEN 'attack_both' WHEN signature <> '' THEN 'attack_suricata_only'
         WHEN model_proba >= 0.5 THEN 'attack_ml_only' ELSE 'benign' END AS verdict
  FROM flows_v)"""


def decisions(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    flows = event_flows(spark, sf_dir).withColumns({
        "bytes_total": F.col("bytes_to") + F.col("bytes_from"),
        "pkts_total": F.col("pkts_to") + F.col("pkts_from"),
        "age": F.floor(F.col("duration_us") / F.lit(1e6)).cast("double"),
    })
    return OD.fuse(flows, threshold)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One truth row per event: several per source, so the join with decisions is many-to-many."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"),
        (F.pmod("user_id", F.lit(3)) == 0).cast("int").alias("is_attack"),
    )


TRUTH_SQL = """
truth_v AS (SELECT '10.0.0.' || CAST(user_id AS VARCHAR) AS src_ip,
  CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS is_attack FROM events)"""


# ------------------------------------------------------------------ event log
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as event-log text lines: one flow line each, an earlier alert line per signature.

    Every 7th flow carries its counters at the top level, every 11th has no end time, every
    17th ends before it starts; UDP flows have no tcp object. Tasks format up to about EVENTS_PER_TASK events each.
    """
    flows = event_flows(spark, sf_dir)
    f = flows.repartition(max(1, math.ceil(flows.count() / EVENTS_PER_TASK)), "flow_id").withColumn("i", F.col("flow_id").cast("long"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    shift = F.when(F.pmod("i", F.lit(17)) == 0, -F.col("duration_us")).otherwise(F.col("duration_us"))
    started = F.timestamp_micros(F.unix_micros("ts") - shift)
    ended = F.when(F.pmod("i", F.lit(11)) != 0, stamp(F.col("ts")))
    counters = [
        F.col("pkts_to").alias("pkts_toserver"), F.col("pkts_from").alias("pkts_toclient"),
        F.col("bytes_to").alias("bytes_toserver"), F.col("bytes_from").alias("bytes_toclient"),
        stamp(started).alias("start"), ended.alias("end"),
        F.floor(F.col("duration_us") / F.lit(1e6)).alias("age"),
    ]
    tcp = F.when(F.col("proto") == "TCP", F.struct(
        (F.pmod("i", F.lit(2)) == 0).alias("syn"), (F.pmod("i", F.lit(3)) == 0).alias("ack"),
        (F.pmod("i", F.lit(5)) == 0).alias("fin"),
    ))
    common = [F.col("src_ip"), F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), F.col("proto")]
    head = [stamp(F.col("ts")).alias("timestamp"), F.lit("flow").alias("event_type"), F.col("i").alias("flow_id")]
    nested = F.to_json(F.struct(*head, *common, F.struct(*counters).alias("flow"), tcp.alias("tcp")))
    flat = F.to_json(F.struct(*head, *common, *counters, tcp.alias("tcp")))
    flow_line = F.when(F.pmod("i", F.lit(7)) == 0, flat).otherwise(nested)
    earlier = F.timestamp_micros(F.unix_micros("ts") - 1_000_000)
    alert_line = F.when(F.col("signature") != "", F.to_json(F.struct(
        stamp(earlier).alias("timestamp"), F.lit("alert").alias("event_type"), F.col("i").alias("flow_id"),
        *common, F.struct("signature").alias("alert"),
    )))
    return f.select(F.explode(F.array_compact(F.array(alert_line, flow_line))).alias("value"))


PARSED_SQL = FLOWS_SQL + """,
parsed_v AS (
  SELECT *, CASE WHEN event_id % 11 = 0 OR event_id % 17 = 0 THEN 0 ELSE duration_us END AS dur FROM flows_v)"""


# ---------------------------------------------------------------- flow tables
FLOW_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Label of the flow surrogate by return flag and line status.
LABEL_BY_STATUS = {
    "NO": "BENIGN", "NF": "DoS Hulk", "AO": "DDoS", "AF": "PortScan", "RO": "FTP-Patator", "RF": "Web Attack  XSS",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a labelled flow table."""
    li = table(spark, sf_dir, "lineitem")
    status = F.concat("l_returnflag", "l_linestatus")
    label = F.lit(None).cast("string")
    for key, name in LABEL_BY_STATUS.items():
        label = F.when(status == key, F.lit(name)).otherwise(label)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *FLOW_COLUMNS, label.alias("Label"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.operators.cleaning import normalise_labels

    return normalise_labels(flows(spark, sf_dir)).select(*FLOW_COLUMNS, "Label", "Category")


_LABEL_CASE = "CASE l_returnflag || l_linestatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_BY_STATUS.items()
) + " END"
_CATEGORY_CASE = ("CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'BENIGN' WHEN 'NF' THEN 'DoS' WHEN 'AO' THEN 'DDoS' "
                  "WHEN 'AF' THEN 'PortScan' WHEN 'RO' THEN 'Brute Force' WHEN 'RF' THEN 'Web Attack' END")
PREPARED_SQL = f"""
prepared_v AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, {_LABEL_CASE} AS "Label",
  {_CATEGORY_CASE} AS "Category", l_orderkey, l_linenumber FROM lineitem)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flows as text columns with identifiers, junk, infinities, gaps and exact duplicates."""
    f = flows(spark, sf_dir)
    k = F.col("l_orderkey")
    rate = (
        F.when(F.pmod(k, F.lit(97)) == 0, F.lit("Infinity"))
        .when(F.pmod(k, F.lit(89)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, F.lit(83)) == 0, F.lit("junk"))
        .when(F.pmod(k, F.lit(79)) == 0, F.lit(" -inf "))
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    rows = f.select(
        k.alias("Flow ID"), F.col("l_partkey").alias("Source Port"), F.col("l_linenumber").alias("Destination Port"),
        F.col("l_quantity").cast("string").alias("qty"), rate.alias("rate"), F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"), F.concat(F.lit(" "), F.col("Label"), F.lit(" ")).alias("Label"),
        F.when(F.pmod(k, F.lit(53)) == 0, 2).otherwise(1).alias("_copies"),
    )
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "col")


DIRTY_SQL = f"""
dirty_v AS (
  SELECT l_orderkey AS k, l_quantity AS qty, l_discount AS disc, l_tax AS tax, {_LABEL_CASE} AS "Label",
    {_CATEGORY_CASE} AS "Category",
    CASE WHEN l_orderkey % 97 = 0 THEN 'Infinity' WHEN l_orderkey % 89 = 0 THEN NULL
         WHEN l_orderkey % 83 = 0 THEN 'junk' WHEN l_orderkey % 79 = 0 THEN ' -inf ' ELSE 'num' END AS kind,
    CASE WHEN l_orderkey % 97 = 0 OR l_orderkey % 89 = 0 OR l_orderkey % 83 = 0 OR l_orderkey % 79 = 0
         THEN NULL ELSE l_extendedprice END AS rate
  FROM lineitem JOIN (SELECT 1 AS c UNION ALL SELECT 2) d ON d.c = 1 OR l_orderkey % 53 = 0)"""


# -------------------------------------------------------------- scored tables
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (row_id, y, p, category)."""
    f = event_flows(spark, sf_dir)
    return f.select(
        F.col("flow_id").cast("long").alias("row_id"),
        (F.col("event_type") == "error").cast("int").alias("y"), F.col("model_proba").alias("p"),
        F.when(F.col("event_type") == "view", F.lit("BENIGN")).otherwise(F.col("event_type")).alias("category"),
    )


SCORED_SQL = """
scored_v AS (SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS p,
  CASE WHEN event_type = 'view' THEN 'BENIGN' ELSE event_type END AS category, user_id, event_type FROM events)"""


def three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three stand-in models in long form (model, category, y, yhat, p)."""
    s = scored(spark, sf_dir)
    ps = {"ModelA": F.col("p"), "ModelB": F.col("p") * F.col("p"),
          "ModelC": F.when(F.col("y") == 1, (F.col("p") + 1) / 2).otherwise(F.col("p") / 2)}
    models = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in ps.items()])
    long = s.select("row_id", "category", "y", F.inline(models))
    return long.withColumn("yhat", (F.col("p") >= 0.5).cast("int"))


THREE_SQL = SCORED_SQL + """,
three_v AS (
  SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM (
    SELECT 'ModelA' AS model, category, y, p FROM scored_v
    UNION ALL SELECT 'ModelB', category, y, p * p FROM scored_v
    UNION ALL SELECT 'ModelC', category, y, CASE WHEN y = 1 THEN (p + 1) / 2 ELSE p / 2 END FROM scored_v) t)"""


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the outputs of two engines."""
    t = table(spark, sf_dir, "labels")
    rows = t.select(
        F.col("doc_id").cast("string").alias("flow_id"),
        F.when(F.col("toxic") == 1, F.lit("LOCAL toxic")).otherwise(F.lit("")).alias("signature"),
        (1 - F.col("quality")).cast("double").alias("model_proba"),
    )
    return OD.fuse(rows)


# --------------------------------------------------------------- vector tables
def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """embeddings as a feature table f00..f63 with Label and Category; label 0 is BENIGN."""
    e = table(spark, sf_dir, "embeddings")
    category = F.when(F.col("label") == 0, F.lit("BENIGN")).otherwise(
        F.concat(F.lit("class"), F.col("label").cast("string")))
    features = [F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(dims)]
    return e.select(F.col("vec_id").alias("row_id"), *features, category.alias("Label"), category.alias("Category"))


VECTORS_SQL = """
vectors_v AS (SELECT vec_id AS row_id, embedding,
  CASE WHEN label = 0 THEN 'BENIGN' ELSE 'class' || CAST(label AS VARCHAR) END AS category FROM embeddings)"""


# --------------------------------------------------------------- traffic table
def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packet-level records, 200 per second, for the signature rules."""
    e = table(spark, sf_dir, "events")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    uri = (
        F.when(kind == "signup", F.concat(F.lit("/Login?user="), u.cast("string")))
        .when((kind == "click") & (F.pmod(i, F.lit(4)) == 0), F.lit("/q?x=1 UNION ALL Select 2"))
        .when(kind == "click", F.lit("/q?x=select union"))
        .when((kind == "purchase") & (F.pmod(i, F.lit(3)) == 0), F.lit("/item?id=%27 OR 1=1"))
        .when(kind == "purchase", F.lit("/item?id=or %27"))
    )
    packet = kind.isin("error", "view")
    return e.select(
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 5_000).alias("ts"),
        F.concat(F.lit("10.0.0."), F.pmod(u, F.lit(5)).cast("string")).alias("src_ip"),
        F.when(packet, _case(F.pmod(i, F.lit(3)), [22, 21], 8080)).otherwise(80).alias("dst_port"),
        F.when((kind == "view") & (F.pmod(i, F.lit(2)) == 0), F.lit("ICMP")).otherwise(F.lit("TCP")).alias("proto"),
        F.when(kind == "view", F.when(F.pmod(i, F.lit(8)) == 0, 8).otherwise(0)).alias("icmp_type"),
        F.when(kind == "signup", F.lit("POST")).when(~packet, F.lit("GET")).alias("http_method"),
        uri.alias("http_uri"),
        F.when(packet & (F.pmod(i, F.lit(3)) == 1), F.concat(F.lit("User "), u.cast("string"))).alias("ftp_command"),
        packet.alias("tcp_syn"), (F.pmod(i, F.lit(2)) == 1).alias("tcp_ack"),
    )


TRAFFIC_SQL = """
traffic_v AS (
  SELECT 1704067200000000 + event_id * 5000 AS us, '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS src_ip,
    CASE WHEN event_type IN ('error', 'view') THEN CASE event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 21 ELSE 8080 END
         ELSE 80 END AS dst_port,
    CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'ICMP' ELSE 'TCP' END AS proto,
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 8 = 0 THEN 8 ELSE 0 END END AS icmp_type,
    CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_type IN ('click', 'purchase') THEN 'GET' END AS http_method,
    CASE WHEN event_type = 'signup' THEN '/Login?user=' || CAST(user_id AS VARCHAR)
         WHEN event_type = 'click' AND event_id % 4 = 0 THEN '/q?x=1 UNION ALL Select 2'
         WHEN event_type = 'click' THEN '/q?x=select union'
         WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN '/item?id=%27 OR 1=1'
         WHEN event_type = 'purchase' THEN '/item?id=or %27' END AS http_uri,
    CASE WHEN event_type IN ('error', 'view') AND event_id % 3 = 1 THEN 'User ' || CAST(user_id AS VARCHAR) END AS ftp_command,
    event_type IN ('error', 'view') AS tcp_syn, event_id % 2 = 1 AS tcp_ack
  FROM events)"""


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.sources.event_log import parse_lines

    return parse_lines(log_lines(spark, sf_dir))


EVENT_SCHEMA = EVENT
