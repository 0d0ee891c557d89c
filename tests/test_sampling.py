from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.operators import sampling as SA
from tidegate.operators.neighbours import nearest
from tidegate.operators.quantiles import column_quantiles
from tidegate.operators.smote import smote


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 8, "BENIGN").when(F.col("id") % 10 == 8, "DoS").otherwise("Bot").alias("category"),
    ).cache()


def counts(df, *by):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


def test_sample_sizes_round_half_to_even(spark):
    df = spark.range(25).select(F.col("id"), F.when(F.col("id") < 5, "a").when(F.col("id") < 12, "b").otherwise("c").alias("Category"))
    out = SA.stratified_sample(df, 0.5, 7, key=["id"])
    assert counts(out, "Category") == {("a",): 2, ("b",): 4, ("c",): 6}
    assert out.select("id").distinct().count() == out.count()
    assert SA.stratified_sample(df, 1.0, 7).count() == 25
    with pytest.raises(KeyError):
        SA.stratified_sample(df, 0.5, 7, by="nope")


def test_same_seed_same_rows_whatever_the_partitioning(table):
    one = {r.row_id for r in SA.class_cap(table, 100, 3, key=["row_id"]).collect()}
    two = {r.row_id for r in SA.class_cap(table.repartition(13), 100, 3, key=["row_id"]).collect()}
    other = {r.row_id for r in SA.class_cap(table, 100, 4, key=["row_id"]).collect()}
    assert one == two != other and len(one) == 300


def test_split_sizes_are_ceilings(table):
    out = SA.stratified_split(table.filter("row_id < 2997"), 0.2, 0.1, 42, key=["row_id"]).cache()
    by_split = counts(out, "split")
    assert by_split == {("test",): 600, ("val",): 300, ("train",): 2097}
    assert out.select("row_id").distinct().count() == 2997
    shares = counts(out, "split", "category")
    for split, n in by_split.items():
        assert abs(shares[(split[0], "BENIGN")] - 0.8 * n) <= 2


def test_published_split_sizes(spark):
    totals = spark.createDataFrame([("BENIGN", 379334), ("DoS", 38751), ("DDoS", 25603), ("Brute Force", 1830),
                                    ("Web Attack", 429), ("PortScan", 391)], "category string, n long")
    row = SA.split_sizes(totals, "category", 0.2, 0.1).agg(F.sum("n_test"), F.sum("n_val")).first()
    assert tuple(row) == (89268, 44634)


@pytest.mark.parametrize("sizes", [(0.0, 0.1), (0.2, 0.0), (0.6, 0.4), (1.0, 0.1)])
def test_bad_sizes(table, sizes):
    with pytest.raises(ValueError):
        SA.stratified_split(table, *sizes, 1, key=["row_id"])


def test_copies_without_a_key_are_shared_out_exactly(spark):
    rows = [(1, "a")] * 500 + [(i, "a") for i in range(2, 102)] + [(5, "b")] * 40
    df = spark.createDataFrame(rows, "v int, category string")
    out = SA.class_cap(df, 300, 9)
    assert counts(out, "category") == {("a",): 300, ("b",): 40}
    assert out.exceptAll(df).count() == 0


def test_folds(table):
    sizes = counts(SA.stratified_folds(table, 3, 5, by="category", key=["row_id"]), "category", "fold")
    for category in ("BENIGN", "DoS", "Bot"):
        per_fold = [sizes[(category, f)] for f in range(3)]
        assert max(per_fold) - min(per_fold) <= 1


@pytest.mark.parametrize("direct_rows", [10_000_000, 200])
@pytest.mark.parametrize("by", [None, "group"])
def test_quantiles_are_exact(spark, direct_rows, by):
    rng = np.random.default_rng(3)
    n = 9_000
    table = pd.DataFrame({
        "group": rng.choice(["a", "b", "rare"], n, p=[0.6, 0.3995, 0.0005]), "normal": rng.normal(size=n),
        "copies": np.where(rng.random(n) < 0.7, 1.25, rng.normal(size=n)), "heavy.tail": rng.pareto(0.3, n),
        "few": np.where(np.arange(n) < 3, rng.random(n), np.nan), "none": np.full(n, np.nan), "whole": rng.integers(0, 9, n)})
    probs = [0.0, 0.25, 0.999]
    columns = [c for c in table.columns if c != "group"]
    df = spark.createDataFrame(table).unionByName(
        spark.createDataFrame([("a", None), ("a", float("nan"))], "group string, normal double"), allowMissingColumns=True)
    got = {(r[by] if by else None, r.feature): (r.n, r.q)
           for r in column_quantiles(df, columns, probs, by, direct_rows=direct_rows).collect()}
    want = {}
    for name, rows in (table.groupby("group") if by else [(None, table)]):
        for c in columns:
            present = rows[c].dropna().to_numpy()
            if len(present):
                want[name, c] = (len(present), np.quantile(present, probs))
    assert got.keys() == want.keys()
    for key, (count, q) in want.items():
        assert got[key][0] == count
        assert got[key][1] == pytest.approx(q, rel=1e-12, abs=1e-12), key


def test_quantiles_at_the_ends(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 9, 9)], "v double")
    row, = column_quantiles(df, ["v"], [0.0, 0.001, 1.0]).collect()
    assert (row.n, row.q) == (4, pytest.approx([1.0, 1.009, 9.0]))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "group string, v double")
    assert column_quantiles(empty, ["v"], [0.5]).count() == 0
    assert column_quantiles(empty, ["v"], [0.5], "group").count() == 0


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(c, 1, (150, 3)) for c in (0, 3, 9)])


def test_neighbours_match_brute_force(spark, clusters):
    category = np.array(["a"] * 330 + ["b"] * 120)
    pdf = pd.DataFrame({"id": np.arange(450), "category": category, "x": list(clusters)})
    df = spark.createDataFrame(pdf, "id long, category string, x array<double>")
    found = nearest(df, df.filter("id % 2 = 0"), 5, block_rows=40).toPandas()
    assert len(found) == 225 * 5
    for i, part in found.groupby("id"):
        same = np.flatnonzero(category == category[i])
        wanted = np.sort(np.sqrt(((clusters[same] - clusters[i]) ** 2).sum(1)))[:5]
        assert np.allclose(np.sort(part["distance"]), wanted)


def test_smote_rows_lie_between_neighbours(spark, clusters):
    x = np.vstack([clusters[:100], np.repeat(clusters[200:201], 30, axis=0), clusters[201:221]])
    category = ["BENIGN"] * 100 + ["DoS"] * 50
    pdf = pd.DataFrame({"row_id": np.arange(150), "category": category, "x": list(x)})
    out = smote(spark.createDataFrame(pdf, "row_id long, category string, x array<double>"), 3, block_rows=20).toPandas()
    assert Counter(out["category"]) == {"BENIGN": 100, "DoS": 100}
    assert out["row_id"].is_unique and (out.loc[out["synthetic"], "row_id"] < 0).all()
    assert (out["y"] == (out["category"] != "BENIGN")).all()
    own = x[100:]
    for point in np.stack(out.loc[out["synthetic"], "x"].to_numpy()):
        d = own[None] - own[:, None]
        length = (d**2).sum(2)
        t = np.clip(np.divide(((point - own[:, None]) * d).sum(2), length, out=np.zeros_like(length), where=length > 0), 0, 1)
        nearest_on_segment = own[:, None] + t[..., None] * d
        assert np.sqrt(((nearest_on_segment - point) ** 2).sum(2)).min() < 1e-9


def test_smote_needs_two_rows_per_category(spark):
    df = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [2.0]), (2, "b", [1.0])], "row_id long, category string, x array<double>")
    with pytest.raises(ValueError):
        smote(df)
