"""Label texts to attack categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegate.schemas import BENIGN

# Exact label -> category, and label prefix -> category.
CATEGORY_BY_LABEL = {
    "Heartbleed": "DoS",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
}
CATEGORY_BY_PREFIX = {"Web Attack": "Web Attack", "DoS": "DoS"}


def category(label: Column) -> Column:
    """Canonical category; a label outside the lists is its own category."""
    text = F.btrim(label, F.lit(" \t\r\n"))
    result = F.lit(None).cast("string")
    for prefix, name in CATEGORY_BY_PREFIX.items():
        result = F.coalesce(result, F.when(text.startswith(prefix), F.lit(name)))
    for name in sorted(set(CATEGORY_BY_LABEL.values())):
        labels = [k for k, v in CATEGORY_BY_LABEL.items() if v == name]
        result = F.coalesce(result, F.when(text.isin(labels), F.lit(name)))
    return F.coalesce(result, text)


def is_attack(category_col: Column) -> Column:
    return (category_col != BENIGN).cast("int")
