"""The dashboard panels as queries over the decision frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions import decision as D
from tidegate.functions.numbers import ratio
from tidegate.operators.rules import ATTACK_NAME_BY_SIGNATURE

RETAINED_ALERTS = 300  # length of the alert list that a browser shows
# Candidate bucket widths in seconds for automatic histograms.
BUCKET_LADDER = [1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800, 2592000]
TARGET_BUCKETS = 100


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def verdict_breakdown(decisions: DataFrame, k: int = 5) -> DataFrame:
    return top_counts(decisions, "verdict", k)


def top_attackers(decisions: DataFrame, k: int = 15) -> DataFrame:
    return top_counts(decisions.filter("fused_decision"), "src_ip", k)


def signature_hits(decisions: DataFrame, k: int = 10) -> DataFrame:
    return top_counts(decisions.filter("signature_alert"), "signature", k)


def signature_top(decisions: DataFrame, k: int = 6) -> DataFrame:
    """Most frequent signatures, shown without their `LOCAL ` mark."""
    top = signature_hits(decisions, k)
    return top.select(F.replace("signature", F.lit("LOCAL "), F.lit("")).alias("signature"), "n")


def protocol_mix(decisions: DataFrame, k: int = 8) -> DataFrame:
    return top_counts(decisions, "proto", k)


def auto_bucket_seconds(low: Column, high: Column) -> Column:
    """Smallest width of the ladder that needs at most TARGET_BUCKETS buckets."""
    span = (F.unix_micros(high) - F.unix_micros(low)) / F.lit(1e6)
    width = F.lit(BUCKET_LADDER[-1])
    for seconds in reversed(BUCKET_LADDER[:-1]):
        width = F.when(span <= F.lit(float(seconds * TARGET_BUCKETS)), F.lit(seconds)).otherwise(width)
    return width


def flows_over_time(decisions: DataFrame, seconds: int | None = None) -> DataFrame:
    """Flows per time bucket and verdict, empty buckets left out; width automatic unless given."""
    if seconds is None:
        width = decisions.agg(auto_bucket_seconds(F.min("ts"), F.max("ts")).alias("w")).scalar()
    else:
        width = F.lit(seconds)
    staged = decisions.select("verdict", F.unix_seconds("ts").alias("_s"), width.cast("long").alias("_w"))
    bucket = F.timestamp_seconds(F.col("_s") - F.pmod("_s", "_w"))
    return staged.groupBy(bucket.alias("bucket"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_counts() -> list[Column]:
    named = [F.count_if(F.col("verdict") == v).alias(v) for v in D.VERDICTS]
    return named + [F.count(F.lit(1)).alias("total")]


def rate_buckets(decisions: DataFrame, seconds: int = 5) -> DataFrame:
    """One row per tumbling bucket with a column per verdict; works on streams."""
    grouped = decisions.groupBy(F.window("ts", f"{seconds} seconds")).agg(*verdict_counts())
    return grouped.select(F.col("window.start").alias("bucket"), *D.VERDICTS, "total")


def flow_rate(decisions: DataFrame, seconds: int = 5, last: int | None = None) -> DataFrame:
    """Rates of all buckets; with `last`, of so many newest ones, as a panel shows them."""
    rates = rate_buckets(decisions, seconds)
    return rates if last is None else rates.orderBy(F.desc("bucket")).limit(last)


def cumulative_attacks(decisions: DataFrame, seconds: int = 5, last: int | None = None) -> DataFrame:
    """Attacks up to the end of each bucket; the count starts with the first flow, also where only `last` are shown.

    Buckets are summed day by day; only the totals of days meet in one task.
    """
    attacks = F.col("total") - F.col(D.VERDICT_BENIGN)
    rates = rate_buckets(decisions, seconds).select(
        "bucket", attacks.alias("attacks"), F.date_trunc("day", "bucket").alias("_day"))
    in_day = Window.partitionBy("_day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = rates.groupBy("_day").agg(F.sum("attacks").alias("_n"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    running = rates.withColumn("_running", F.sum("attacks").over(in_day)).join(offsets, "_day").select(
        "bucket", "attacks", (F.col("_before") + F.col("_running")).alias("cumulative"))
    return running if last is None else running.orderBy(F.desc("bucket")).limit(last)


def newest(decisions: DataFrame, k: int) -> DataFrame:
    return decisions.orderBy(F.desc("ts"), F.desc("flow_id")).limit(k)


def recent_alerts(decisions: DataFrame, k: int = RETAINED_ALERTS) -> DataFrame:
    columns = ["ts", "src_ip", "dst_ip", "dst_port", "model_proba", "signature", "verdict"]
    return newest(decisions.filter("fused_decision"), k).select(*columns)


def recent_flows(decisions: DataFrame, k: int = 500, hide_benign: bool = False) -> DataFrame:
    return newest(decisions.filter("fused_decision") if hide_benign else decisions, k)


def recent_signature_log(decisions: DataFrame, k: int = 200) -> DataFrame:
    return newest(decisions.filter("signature_alert"), k)


def recent_probabilities(decisions: DataFrame, k: int = 400) -> DataFrame:
    return newest(decisions, k).select("ts", "model_proba", "verdict")


def attacker_share(decisions: DataFrame, k: int = 10, retained: int | None = None) -> DataFrame:
    """Busiest sources among all alerts, or the newest `retained` ones, with their share of these."""
    alerts = decisions.filter("fused_decision")
    if retained is not None:
        alerts = newest(alerts, retained)
    counts = alerts.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    shared = counts.withColumn("share_pct", F.round(100 * F.col("n") / total, 1))
    return shared.orderBy(F.desc("n"), "src_ip").limit(k)


def proba_histogram(decisions: DataFrame, width: float = 0.05) -> DataFrame:
    bin_no = F.floor(F.col("model_proba") / F.lit(width))
    grouped = decisions.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("bin", (F.col("bin") * F.lit(width)).alias("bin_start"), "n")


def totals_columns() -> list[Column]:
    fused = F.col("fused_decision")
    by_verdict = [F.count_if(F.col("verdict") == v).alias(v) for v in D.VERDICTS]
    return [
        F.count(F.lit(1)).alias("flows"),
        F.count_if(fused).alias("attacks"),
        *by_verdict,
        F.sum(F.col("bytes_total").cast("long")).alias("bytes"),
        F.sum(F.col("pkts_total").cast("long")).alias("packets"),
        F.sum(F.when(fused, F.col("bytes_total").cast("long")).otherwise(0)).alias("attack_bytes"),
    ]


def session_totals(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*totals_columns())


def agreement_pct(decisions: DataFrame) -> DataFrame:
    counts = decisions.agg(
        F.count_if(F.col("verdict").isin(D.VERDICT_BOTH, D.VERDICT_BENIGN)).alias("agree"),
        F.count_if("fused_decision").alias("attacks"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.select(
        F.round(100 * ratio(F.col("agree"), F.col("total")), 1).alias("agreement_pct"),
        F.round(100 * ratio(F.col("attacks"), F.col("total")), 1).alias("attack_pct"),
    )


def agreement_matrix(decisions: DataFrame) -> DataFrame:
    """All four combinations of the two engines with count and share, absent ones as 0."""
    wanted = {
        (a, m): F.count_if((F.col("signature_alert") == a) & (F.col("model_decision") == m))
        for a in (False, True) for m in (False, True)
    }
    cells = F.array(*[
        F.struct(F.lit(int(a)).alias("signature_attack"), F.lit(int(m)).alias("model_attack"), n.alias("n"))
        for (a, m), n in wanted.items()
    ])
    row = decisions.agg(cells.alias("cells"), F.count(F.lit(1)).alias("total"))
    flat = row.select(F.inline("cells"), "total")
    share = F.round(100 * ratio(F.col("n"), F.col("total")), 1)
    return flat.select("signature_attack", "model_attack", "n", share.alias("share_pct"))


def attack_type_distribution(decisions: DataFrame, retained: int | None = None) -> DataFrame:
    """Alerts (all, or the newest `retained`) per attack name of the rule table, with the ratio to the most frequent."""
    alerts = decisions.filter("fused_decision")
    if retained is not None:
        alerts = newest(alerts, retained)
    name = F.lit(None).cast("string")
    for signature, attack in ATTACK_NAME_BY_SIGNATURE.items():
        name = F.when(F.col("signature") == signature, F.lit(attack)).otherwise(name)
    counts = alerts.select(name.alias("attack_name")).filter("attack_name is not null")
    counts = counts.groupBy("attack_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio_to_max", F.col("n") / F.max("n").over(Window.partitionBy()))


def threshold_whatif(decisions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Verdict counts under other thresholds, all thresholds in one pass over the decisions."""
    alert = F.col("signature_alert")
    rows = []
    for t in thresholds:
        flagged = D.at_least(F.col("model_proba"), t)
        cell = [F.count_if(D.verdict(alert, flagged) == v).alias(v) for v in D.VERDICTS]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *cell))
    return decisions.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def time_range(decisions: DataFrame, minutes: int = 30) -> DataFrame:
    """Decisions of the last minutes before the newest one."""
    latest = decisions.agg(F.max("ts").alias("m")).scalar()
    return decisions.filter(F.col("ts") >= latest - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
