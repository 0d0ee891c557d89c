"""Decision outputs: CSV tables, bulk index lines, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.operators.decisions import batch_records, live_records


def bulk_lines(records: DataFrame, index: str) -> DataFrame:
    """An action line and a document line per record, as one two-line text value."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    return records.select(F.concat_ws("\n", action, document).alias("value"))


def write_decisions_csv(decisions: DataFrame, path: str, mode: str = "overwrite") -> None:
    batch_records(decisions).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_bulk(decisions: DataFrame, path: str, index: str, mode: str = "overwrite") -> None:
    bulk_lines(live_records(decisions), index).write.mode(mode).text(path)
