import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidegate.models import forest as FO
from tidegate.models import trees as T
from tidegate.session import scratch_path


def vectors(spark, x, y):
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y int").select("row_id", array_to_vector("x").alias("features"), "y")


def grown_by_hand(rows, y, count, weights, depth, tried, seed):
    """Shares of class 1 at the leaf of each row, by looking at every cut."""
    out, todo = np.zeros(len(rows)), [np.arange(len(rows))]
    for level in range(depth + 1):
        following = []
        order = T.feature_order(seed, 0, (1 << 6) + level, max(len(todo), 1), rows.shape[1])
        for members, features in zip(todo, order, strict=False):
            c1 = float((count[members] * y[members]).sum())
            c0 = float(count[members].sum()) - c1
            out[members] = weights[1] * c1 / (weights[0] * c0 + weights[1] * c1)
            best = None
            for place, f in enumerate(features):
                if level == depth or not (c0 and c1) or (place >= tried and best):
                    break
                values = np.unique(rows[members, f])
                for a, b in zip(values[:-1], values[1:], strict=True):
                    low = members[rows[members, f] <= a]
                    l1 = (count[low] * y[low]).sum()
                    l0 = count[low].sum() - l1
                    value = T.purity(l0, l1, weights) + T.purity(c0 - l0, c1 - l1, weights)
                    if best is None or value > best[0]:
                        best = (value, f, (int(a) + int(b) - 1) // 2)
            if best:
                right = rows[members, best[1]] > best[2]
                following += [members[~right], members[right]]
        todo = following
    return out


def test_growth_equals_looking_at_every_cut():
    rng = np.random.default_rng(4)
    rows, y = rng.integers(0, 6, (150, 5)).astype(np.uint8), rng.integers(0, 2, 150)
    rows[:, 4] = 3
    count = rng.integers(1, 4, 150)
    for depth, tried in ((0, 2), (3, 2), (30, 1), (30, 3)):
        nodes = T.grow(rows, y, count, (1.3, 0.8), depth, tried, 7, 0, 1)
        expected = grown_by_hand(rows, y, count.astype(float), (1.3, 0.8), depth, tried, 7)
        assert np.allclose(T.shares(rows, nodes), expected, atol=1e-6)


def test_bootstrap_counts_follow_the_poisson_law():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    counts = [T.bootstrap(keys, tree) for tree in (0, 1)]
    for c in counts:
        assert abs(c.mean() - 1) < 0.01 and abs((c == 0).mean() - np.exp(-1)) < 0.005 and abs(c.var() - 1) < 0.02
    assert abs(np.corrcoef(*counts)[0, 1]) < 0.01


def test_large_nodes_split_by_counts_give_the_same_trees(spark):
    """Two features are both tried everywhere, so it must not matter which task splits a node."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    rows = vectors(spark, x, (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(int)).repartition(3)
    whole = FO.fit_random_forest(rows, 6, 5, 1)
    parts = FO.fit_random_forest(rows, 6, 5, 1, subtree_rows=200)
    assert not whole.splits and min(len(s) for s in parts.splits.values()) > 4
    both = FO.score_forest(parts, FO.score_forest(whole, rows, "a"), "b").toPandas()
    # ties between cuts are the only freedom
    assert (np.abs(both["a"] - both["b"]) < 1e-6).mean() > 0.99
    path = scratch_path(spark, "kept")
    FO.save_random_forest(parts, spark, path)
    stored = FO.score_forest(FO.load_random_forest(spark, path), rows).select("row_id", F.col("p").alias("c")).toPandas()
    merged = both.merge(stored, on="row_id")
    assert np.abs(merged["b"] - merged["c"]).max() < 1e-12
    assert ((both["a"] > 0.5) == (both["y"] == 1)).mean() > 0.8


def test_forest_learns_and_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 9))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    train, test = vectors(spark, x[:1000], y[:1000]), vectors(spark, x[1000:], y[1000:])
    scored = [FO.score_forest(FO.fit_random_forest(t, 30, 30, 5), test).orderBy("row_id").toPandas()
              for t in (train.coalesce(1), train.repartition(7))]
    assert np.array_equal(scored[0]["p"], scored[1]["p"])
    assert ((scored[0]["p"] > 0.5) == (scored[0]["y"] == 1)).mean() > 0.85


def test_large_pure_and_equal_nodes_are_leaves(spark):
    x = np.r_[np.zeros((400, 2)), np.ones((400, 2)), np.full((300, 2), 2.0)]
    y = np.r_[np.zeros(400, int), np.ones(400, int), np.arange(300) % 2]
    rows = vectors(spark, x, y)
    p = FO.score_forest(FO.fit_random_forest(rows, 4, 30, 1, subtree_rows=100), rows).toPandas()
    means = p.assign(x=x[:, 0]).groupby("x")["p"].agg(["min", "max"])
    assert means.loc[0.0].tolist() == [0, 0] and means.loc[1.0].tolist() == [1, 1]
    assert 0.3 < means.loc[2.0, "min"] == means.loc[2.0, "max"] < 0.7
    one_class = FO.score_forest(FO.fit_random_forest(rows.filter("y = 1"), 3, 30, 1, subtree_rows=100), rows)
    assert pd.unique(one_class.toPandas()["p"]).tolist() == [1.0]


def test_nodes_that_are_counted_and_sorted_have_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(6)
    rows, y = rng.integers(0, 40, (4000, 6)).astype(np.uint8), (rng.random(4000) < 0.2).astype(int)
    rows[:, 5], rows[:1000, 0] = 9, 3
    count = rng.integers(1, 5, 4000)
    found = []
    for counted in (1, 300, 10_000):
        monkeypatch.setattr(T, "COUNTED_ROWS", counted)
        monkeypatch.setattr(T, "COUNTED_AT_ONCE", 500)
        found.append(T.grow(rows, y, count, (0.7, 2.1), 30, 2, 3, 1, 1))
    for nodes in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], nodes, strict=True))
    assert len(found[0][0]) > 500


def test_trees_of_whole_tables_equal_those_of_shuffled_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 9))
    x[:300] = 1.0
    rows = vectors(spark, x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5) ^ (rng.random(1500) < 0.1)).astype(int)).repartition(3)
    whole = FO.fit_random_forest(rows, 8, 12, 5, subtree_rows=200)
    monkeypatch.setattr(FO, "HELD_PARTS", 0)
    parts = FO.fit_random_forest(rows, 8, 12, 5, subtree_rows=200)
    assert not whole.splits and parts.splits
    both = FO.score_forest(parts, FO.score_forest(whole, rows, "a"), "b").toPandas()
    assert np.abs(both["a"] - both["b"]).max() < 1e-7 and both["a"].nunique() > 100


def test_forests_that_grow_together_equal_forests_alone(spark):
    rng = np.random.default_rng(9)
    x, kind = rng.normal(size=(900, 5)), np.array(["BENIGN", "a", "b"])[np.arange(900) % 3]
    x[kind == "a", 0] += 2
    x[kind == "b", 1] += 2
    named = spark.createDataFrame([(i, k) for i, k in enumerate(kind.tolist())] + [(900, None)], "row_id long, category string")
    rows = vectors(spark, np.r_[x, x[:1]], np.r_[kind != "BENIGN", True].astype(int)).join(named, "row_id")
    together = FO.fit_random_forests(rows, [None, "a", "b", "BENIGN"], 6, 8, 3)
    alone = [FO.fit_random_forest(t, 6, 8, 3) for t in (rows, *(rows.filter(F.col("category") != c) for c in ("a", "b", "BENIGN")))]
    scored = rows.select("row_id", FO.mean_shares(together).alias("p"), *[m.score().alias(f"p{i}") for i, m in enumerate(alone)])
    for r in scored.collect():
        assert r.p == [r.p0, r.p1, r.p2, r.p3]
