"""Nearest neighbours, prefix tries and whitening against brute force, odd rows and clashing columns included."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import catalog, heavy, prefix_trie, vantage_trees, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors_of(df):
    return [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    """The smallest table with copies, zero, null and unfinished vectors; further columns clash with internal names."""
    base = [(i, [float(v) for v in x]) for i, x in vectors_of(spark.read.parquet(f"{SF}/embeddings.parquet"))]
    odd = [(1000, None), (1050, [0.0] * 64), (1001, [NAN] + [1.0] * 63), (1002, [INF] + [1.0] * 63),
           (1003, [None] + [1.0] * 63), (None, base[7][1]), (1100, base[7][1]), (1004, base[0][1]), (1004, base[0][1]),
           (1150, [1e200] * 64)] + [(2000 + i, base[50][1]) for i in range(30)]
    rows = [(i, x, 1, "s", "q", 0) for i, x in base + odd]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, x string, query string, n int")


def brute_nearest(rows, k, every):
    good = [(i, np.array(x, float)) for i, x in rows if x is not None and None not in x
            and np.isfinite(np.array(x, float)).all() and any(x)]
    units = [x / np.abs(x).max() for _, x in good]
    units = [u / np.sqrt(u @ u) for u in units]
    out = {}
    for (i, _), q in zip(good, units, strict=True):
        if i is None or i % every:
            continue
        cells = [(-round(float(q @ u), 12), j is None, j or 0) for (j, _), u in zip(good, units, strict=True) if j != i]
        out[i] = [(None if none else j, -s) for s, none, j in sorted(cells)[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_nearest_is_exact_with_factor_one(vectors, shard_rows):
    got = defaultdict(list)
    found = vantage_trees.nearest(vectors, 5, factor=1.0, shard_rows=shard_rows).collect()
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, round(r.score, 12)))
    want = brute_nearest(vectors_of(vectors), 5, 50)
    assert set(got) == set(want)
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-9)
        assert [v for v, _ in got[i]] == [v for v, _ in want[i]]


def test_nearest_recall_of_the_default_factor(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        want = brute_nearest(vectors_of(df), 5, 50)
        got = defaultdict(set)
        for r in vantage_trees.nearest(df, 5, shard_rows=512).collect():
            got[r.query_id].add(r.vec_id)
        assert np.mean([len(got[i] & {v for v, _ in want[i]}) / 5 for i in want]) >= 0.95


def test_nearest_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert vantage_trees.nearest(spark.createDataFrame([], schema), 5).count() == 0
    assert vantage_trees.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), 5).count() == 0
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 1.0]), (1, [1.0, -1.0]), (4, [1.0])], schema)
    got = sorted((r["rank"], r.vec_id) for r in vantage_trees.nearest(rows, 5).collect())
    assert got == [(1, 3), (2, 1), (3, 2)]  # ties to the smaller id; another length takes no part


def test_trees_hold_every_vector():
    x = vantage_trees.unit(np.random.default_rng(0).normal(size=(777, 8)))
    x[100:400] = x[3]
    rows = []

    def walk(node):
        if node.halves is None:
            rows.extend(node.rows)
        else:
            for half in node.halves:
                walk(half)

    walk(vantage_trees.build(x, 16))
    assert sorted(rows) == list(range(777))


def brute_trie(rows, group=5, spread=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}
    whole = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % spread, c - (c % group if c >= 0 else -(-c % group))
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members, children, totals, out = defaultdict(list), defaultdict(list), {}, set()
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        totals[s] = (sum(totals[k][0] for k in children[s]) or 1, saved + sum(totals[k][1] for k in children[s]))
    for s, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(whole[c]) == len(s))))
        out.add((min(held), len(s), min(members[s[:-1]]) if s else None, len(held), len(children[s]), *totals[s],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df):
    found = [tuple(r) for r in prefix_trie.conversation_trie(df).select(*NODE).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_trie_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert trie_of(df) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 4)
    monkeypatch.setattr(heavy, "HEAVY_ROWS", 1)
    draw = random.Random(1)
    rows = [(draw.choice([None, -7, -6, -5, -3, 0, 1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 16, 21]),
             draw.choice([None, 0, 1, 2, 3, 3]), draw.choice(["u", "a", None]), draw.choice(["x", "yé", "", None]))
            for _ in range(150)]
    rows += [(30 + k, i, "u", "same") for k, n in enumerate((70, 64, 63)) for i in range(n)]
    rows += [(c, t, "u", f"common {t} {c % 3 if t == 7 else ''}") for c in range(100, 160) for t in range(9)]
    rows += [(200, 0, "u", "long " * 200_000)]
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, whole string, j int")
    assert trie_of(df) == brute_trie(rows)
    assert trie_of(df.filter("false")) == set()
    one = df.filter("conv_id = 31 and turn = 0")
    assert trie_of(one) == brute_trie([(31, 0, "u", "same")])


def brute_whitening(rows, counted=False):
    good = [(i, x) for i, x in rows if x is not None and None not in x and np.isfinite(np.array(x, float)).all()]
    x = np.floor(256 * np.array([v for _, v in good], float)).astype(np.int64)
    fit, copies = np.unique(x, axis=0, return_counts=True)
    weight = copies if counted else np.ones(len(fit), np.int64)
    n, sums = int(weight.sum()), (fit * weight[:, None]).sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh((centred * weight[:, None]).T @ centred / n)
    return good, x, n, sums, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(vectors, weights, monkeypatch):
    monkeypatch.setattr(heavy, "HEAVY_ROWS", 1)
    table = vectors.filter("vec_id is null or vec_id <> 1150")
    rows = vectors_of(table)
    good, x, n, sums, values, components = brute_whitening(rows, weights == "count")
    found, fit = whitening.whiten(table, 4, weights)
    assert fit.n == n and fit.sums == sums.tolist() and fit.identity_error < 1e-9
    want = sorted((i is None, i or 0, int(((n * v - sums) ** 2).sum()),
                   *np.abs((v - sums / n) @ components[:, :4] / np.sqrt(values[:4])).round(7)) for (i, _), v in zip(good, x, strict=True))
    got = sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation), *np.abs(r.whitened).round(7)) for r in found.collect())
    assert np.allclose(np.array(got, float), np.array(want, float), atol=1e-6)
    # one sign of a component for all rows
    by_id = {i: v for (i, _), v in zip(good, x, strict=True)}
    for c in range(4):
        signs = {float(np.sign(r.whitened[c] * ((by_id[r.vec_id] - sums / n) @ components[:, c]))) for r in found.collect()}
        assert len(signs - {0.0}) == 1
    assert [fit.explained(c) for c in range(4)] == pytest.approx((values[:4] / values.sum()).tolist(), rel=1e-9)


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(1, [1.0]), (2, [0.5, 0.25]), (3, [1e30, 0.0]), (4, [])], schema)
    found, _ = whitening.whiten(rows)
    assert {r.vec_id: r.x for r in found.collect()} == {
        1: [256, 0], 2: [128, 64], 3: [2 ** 63 - 1, 0], 4: [0, 0]}
    alone, fit = whitening.whiten(rows.filter("vec_id = 2"))
    assert [(r.vec_id, r.whitened, int(r.deviation)) for r in alone.collect()] == [(2, [None, None], 0)]
    assert fit.identity_error is None
    assert whitening.by_component(*whitening.whiten(rows.filter("false"))).count() == 0


def test_heavy_lookup_keeps_all_rows(spark):
    rows = spark.range(10_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("key"), "id")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("key") * 2)
    found = heavy.lookup(rows, keyed, ["key"], "n", ["v"])
    assert found.count() == 10_000 and found.filter("v = key * 2").count() == 10_000


def test_digest_queries(spark):
    trees = catalog.QUERIES["op11_vantage_trees"](spark, SF)
    assert trees.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert trees.count() == 50
    nodes = catalog.QUERIES["op12_prefix_trie"](spark, SF)
    assert nodes.columns == NODE and {t for c, t in nodes.dtypes if c != "ends_sha256"} == {"bigint"}
    white = catalog.QUERIES["op13_whitened_embeddings"](spark, SF)
    assert dict(white.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                  "whitened": "double", "explained": "double", "identity_error": "double"}
    assert white.count() == 2000
