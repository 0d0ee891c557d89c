"""Signature rules over traffic records.

Traffic columns: ts, src_ip, dst_ip, dst_port, proto, icmp_type, http_method, http_uri,
ftp_command, tcp_syn, tcp_ack. Every rule yields ts, src_ip, hits, sid, signature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TRAFFIC = ["ts", "src_ip", "dst_port", "proto", "icmp_type", "http_method", "http_uri",
           "ftp_command", "tcp_syn", "tcp_ack"]


@dataclass(frozen=True)
class Rule:
    """A record predicate; with `count` it alerts once per source and period of `seconds`."""

    sid: int
    signature: str
    attack_name: str
    matches: Callable[[], Column]
    count: int | None = None
    seconds: int | None = None


def _uri_has(pattern: str) -> Column:
    return F.lower("http_uri").rlike(pattern)


# Rule numbers, signature texts, attack names and burst limits.
RULES = {
    "icmp_echo": Rule(1000001, "LOCAL ICMP echo request seen", "ICMP Flood",
                      lambda: (F.col("proto") == "ICMP") & (F.col("icmp_type") == 8)),
    "http_login_post": Rule(1000010, "LOCAL HTTP POST to login endpoint", "HTTP Login Brute",
                            lambda: (F.col("http_method") == "POST") & _uri_has("login")),
    "sqli_union": Rule(1000020, "LOCAL Possible SQL injection (UNION SELECT)", "SQL Injection",
                       lambda: _uri_has("union.*select")),
    "sqli_quote_or": Rule(1000021, "LOCAL Possible SQL injection (single quote with OR)", "SQL Injection",
                          lambda: _uri_has("%27.*or")),
    "ssh_burst": Rule(1000030, "LOCAL SSH connection attempt", "SSH Brute",
                      lambda: (F.col("proto") == "TCP") & (F.col("dst_port") == 22), count=5, seconds=30),
    "ftp_burst": Rule(1000040, "LOCAL FTP authentication attempt", "FTP Brute",
                      lambda: (F.col("proto") == "TCP") & (F.col("dst_port") == 21)
                      & F.lower("ftp_command").contains("user"), count=5, seconds=30),
    "syn_scan": Rule(1000050, "LOCAL Possible TCP SYN scan", "Port Scan",
                     lambda: (F.col("proto") == "TCP") & F.col("tcp_syn") & ~F.col("tcp_ack"),
                     count=30, seconds=10),
}
ATTACK_NAME_BY_SIGNATURE = {rule.signature: rule.attack_name for rule in RULES.values()}


def apply_rules(traffic: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Alerts of the named rules (all by default).

    Record rules are expanded from one scan; all burst rules share one aggregate, keyed by
    rule, source and aligned period, so a busy source is reduced before the shuffle.
    """
    chosen = [RULES[name] for name in (names or RULES)]
    plain = [rule for rule in chosen if rule.count is None]
    bursts = [rule for rule in chosen if rule.count is not None]
    parts = []
    if plain:
        parts.append(_expand(traffic, plain).select("ts", "src_ip", F.lit(1).cast("long").alias("hits"),
                                                    "sid", "signature"))
    if bursts:
        second = F.unix_seconds("ts")
        period = F.timestamp_seconds(second - F.pmod(second, F.col("seconds").cast("long")))
        counted = _expand(traffic, bursts).groupBy(
            period.alias("ts"), "src_ip", "sid", "signature", "needed"
        ).agg(F.count(F.lit(1)).alias("hits"))
        parts.append(counted.filter(F.col("hits") >= F.col("needed")).select(
            "ts", "src_ip", "hits", "sid", "signature"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _expand(traffic: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per record and matching rule."""
    hit = F.array_compact(F.array(*[
        F.when(rule.matches(), F.struct(
            F.lit(rule.sid).alias("sid"), F.lit(rule.signature).alias("signature"),
            F.lit(rule.count).cast("int").alias("needed"), F.lit(rule.seconds).cast("int").alias("seconds"),
        ))
        for rule in rules
    ]))
    return traffic.select("ts", "src_ip", F.inline(hit))


def as_alerts(hits: DataFrame) -> DataFrame:
    """Rule hits in the shape of event-log alerts (without a flow id)."""
    return hits.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.lit("alert").alias("event_type"), "src_ip",
        F.struct("signature").alias("alert"), "sid",
    )


def traffic_from_events(events: DataFrame) -> DataFrame:
    """Traffic columns of a parsed event log, for running the rules on logged records."""
    flag = lambda name: F.lower(F.coalesce(f"tcp.{name}", F.lit("false"))).isin("true", "1", "1.0")
    return events.select(
        F.try_to_timestamp("timestamp").alias("ts"), "src_ip", F.col("dest_ip").alias("dst_ip"),
        F.col("dest_port").try_cast("int").alias("dst_port"), "proto", "icmp_type",
        F.col("http.http_method").alias("http_method"), F.col("http.url").alias("http_uri"),
        F.col("ftp.command").alias("ftp_command"), flag("syn").alias("tcp_syn"), flag("ack").alias("tcp_ack"),
    )
