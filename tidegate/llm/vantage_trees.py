"""Nearest neighbours by cosine with vantage-point trees, one a shard.

On unit vectors the cosine falls with the distance, so a metric tree finds the largest cosines. A node has a vantage
point and two halves of the rest, each with the least and largest distance from it; by the triangle inequality a half
holds nothing nearer to a query than the gap between the query's distance from the vantage point and that range. A
half is skipped if the gap exceeds `factor` times the distance of the worst neighbour found so far: with factor one the
search is exact, smaller factors skip more.

A small tree over a bounded sample deals all vectors to shards; every shard has a tree of its own. A query is first
searched in the shard it falls into, which bounds its distances, then in the shards that the sample's tree leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.llm.staging import Stage

#: Vectors of a shard; those of a larger one are dealt to several trees.
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Vectors, and entries of them, that the tree dealing out the shards is fitted on at most, by a hash of the vectors.
SAMPLE_ROWS, SAMPLE_ENTRIES = 32_768, 4_000_000
SAMPLE_LEAF = 16
QUERY_CHUNK = 4096
#: Share of the worst distance found that a gap must exceed.
FACTOR = 0.2
#: Added to what a gap must exceed, for rounding.
SLACK = 1e-7
#: Digits to which the search tells cosines apart; scores of what it found are worked out in full.
DIGITS = 13
QUERY_EVERY = 50


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, without rounding, so that squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / lengths(x)[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, rows of `a` from the one vector `b`."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b), 0.0))


@dataclass
class Node:
    """`rows` at a leaf; else a vantage point, its halves and their ranges of distances from it."""

    rows: np.ndarray | None = None
    vantage: int = -1
    halves: tuple[Node, Node] | None = None
    ranges: tuple[tuple[float, float], tuple[float, float]] | None = None
    number: int = -1


def build(x: np.ndarray, leaf_rows: int) -> Node:
    """A balanced tree; the vantage point of a node is the one farthest from the first of its vectors.

    Vantage points stay in the halves, so every vector is in one leaf. Ties are cut by place.
    """
    numbers = iter(range(len(x) + 1))

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf_rows:
            return Node(rows=rows, number=next(numbers))
        vantage = int(rows[distances(x[rows], x[rows[0]]).argmax()])
        d = distances(x[rows], x[vantage])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return Node(vantage=vantage, halves=(grow(rows[near]), grow(rows[far])),
                    ranges=((float(d[near].min()), float(d[near].max())), (float(d[far].min()), float(d[far].max()))))

    return grow(np.arange(len(x)))


def gaps(d: np.ndarray, reach: tuple[float, float]) -> np.ndarray:
    return np.maximum(np.maximum(d - reach[1], reach[0] - d), 0.0)


class Search:
    """The `k` nearest of `x` for all rows of `q` within `bound` (distances), ties to smaller places in `x`."""

    def __init__(self, x: np.ndarray, q: np.ndarray, k: int, factor: float, bound: np.ndarray):
        self.x, self.q, self.k, self.factor = x, q, k, factor
        self.bound = bound.copy()
        self.best = np.full((len(q), k), -np.inf)
        self.rows = np.full((len(q), k), -1)
        self.looked = 0

    def visit(self, node: Node, active: np.ndarray) -> None:
        """Half by half, the nearer one first for each query."""
        if not len(active):
            return
        if node.halves is None:
            return self._leaf(node.rows, active)
        d = distances(self.q[active], self.x[node.vantage])
        gap = [gaps(d, reach) for reach in node.ranges]
        first = (gap[1] < gap[0]).astype(int)
        for side in (0, 1):
            self.visit(node.halves[side], active[(first == side) & self._open(active, gap[side])])
        for side in (0, 1):
            self.visit(node.halves[side], active[(first != side) & self._open(active, gap[side])])

    def _open(self, active: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return gap <= self.factor * self.bound[active] + SLACK

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.looked += len(rows) * len(active)
        cosine = np.round(self.q[active] @ self.x[rows].T, DIGITS)
        better = cosine.max(1) >= self.best[active].min(1)
        active, cosine = active[better], cosine[better]
        if not len(active):
            return
        both = np.concatenate([self.best[active], cosine], 1)
        names = np.concatenate([self.rows[active], np.broadcast_to(rows, cosine.shape)], 1)
        top = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(both, top, 1)
        self.rows[active] = np.take_along_axis(names, top, 1)
        worst = self.best[active][:, -1]
        far = np.sqrt(np.maximum(2.0 - 2.0 * np.maximum(worst, -1.0), 0.0))
        self.bound[active] = np.minimum(self.bound[active], np.where(np.isfinite(worst), far, np.inf))


class Router:
    """The tree over the sample: its leaves are the shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.x = sample
        leaf = max(SAMPLE_LEAF, -(-len(sample) // max(1, shards)))
        self.root = build(sample, leaf)
        self.shards = self._count(self.root)

    def _count(self, node: Node) -> int:
        return 1 if node.halves is None else sum(self._count(h) for h in node.halves)

    def shard_of(self, x: np.ndarray) -> np.ndarray:
        """The shard of each vector: at each vantage point, the half whose range is nearer."""
        out = np.zeros(len(x), np.int32)

        def go(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.halves is None:
                out[rows] = node.number
                return
            cut = (node.ranges[0][1] + node.ranges[1][0]) / 2
            near = distances(x[rows], self.x[node.vantage]) <= cut
            go(node.halves[0], rows[near])
            go(node.halves[1], rows[~near])

        go(self.root, np.arange(len(x)))
        return out

    def open_shards(self, q: np.ndarray, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) for all shards that the triangle inequality, relaxed by `factor`, leaves to a query.

        Vectors were dealt by the cut between the halves, so that is where a half begins or ends.
        """
        found: list[tuple[np.ndarray, int]] = []

        def go(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.halves is None:
                found.append((rows, node.number))
                return
            cut = (node.ranges[0][1] + node.ranges[1][0]) / 2
            d = distances(q[rows], self.x[node.vantage])
            most = factor * bound[rows] + SLACK
            go(node.halves[0], rows[d - cut <= most])
            go(node.halves[1], rows[cut - d <= most])

        go(self.root, np.arange(len(q)))
        return (np.concatenate([r for r, _ in found]),
                np.concatenate([np.full(len(r), s, np.int32) for r, s in found])) if found else (
            np.zeros(0, int), np.zeros(0, np.int32))


def usable(vector: Column) -> Column:
    """Vectors with finite entries, not all zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """(point, x, ids): each distinct vector once, with the `keep` smallest ids that have it (null last)."""
    order = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
    grouped = least.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id"))).alias("ids"))
    return grouped.select(F.xxhash64("x").alias("point"), "x", F.transform("ids", lambda s: s["vec_id"]).alias("ids"))


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(df: DataFrame, k: int = 5, query: Column | None = None, factor: float = FACTOR, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The `k` rows of largest cosine found for every query row, nearest first, ties to smaller ids.

    Returns query_id, rank (from 1), vec_id, score. `query` picks the query rows (ids divisible by QUERY_EVERY if not
    given); every row with a usable vector is a candidate but those with the query's id. Null vectors, zero ones and
    those with null, infinite or NaN entries take no part, nor do vectors of another length than the query's. A null id
    is a candidate, last among ties, and no query. Equal rows are candidates as often as they are there; a query that
    is there several times is answered once for each of its vectors. An empty table gives no rows. Factor one is exact.
    """
    chosen = F.col(id_col).cast("long") % QUERY_EVERY == 0 if query is None else query
    rows = df.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"),
        F.coalesce(chosen, F.lit(False)).alias("asked"))
    # the own id may be among the smallest ids of a vector, so one more is kept
    points = Stage(distinct_points(rows.select("vec_id", "x"), k + 1).withColumn("width", F.size("x")), "points")
    asked = Stage(rows.filter("asked and vec_id is not null").select("vec_id", "x").distinct().withColumn(
        "width", F.size("x")).withColumn("query", F.xxhash64("vec_id", "x")), "asked")
    results = [
        _nearest_of(points.read().filter(F.col("width") == r.width), asked.read().filter(F.col("width") == r.width),
                    r.n, r.width, k, factor, shard_rows)
        for r in points.read().groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()]
    out = None
    for part in results:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _nearest_of(points: DataFrame, asked: DataFrame, n: int, width: int, k: int, factor: float,
                shard_rows: int) -> DataFrame:
    spark = points.sparkSession
    most = max(1024, min(SAMPLE_ROWS, SAMPLE_ENTRIES // width))
    sample = points.select("x", "point")
    if n > most:
        sample = sample.filter(F.pmod("point", F.lit(1 << 40)) < F.lit(int((1 << 40) * (most / n))))
    found = sample.limit(2 * most).toArrow().column("x").combine_chunks()
    order = np.lexsort(_arrow_matrix(found).T) if len(found) else np.zeros(0, int)
    router = Router(unit(_arrow_matrix(found)[order]) if len(found) else np.zeros((0, width)), -(-n // shard_rows))
    shared = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = shared.value.shard_of(unit(_arrow_matrix(batch.column("x"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    dealt = points.select("point", "x", "ids").mapInArrow(place, "point long, x array<double>, ids array<long>, shard int")
    dealt = Stage(dealt, "dealt")
    sizes = Stage(dealt.read().groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("trees")), "sizes")
    small = F.broadcast(sizes.read())  # a row a shard, at most as many as the sample has vectors
    index = dealt.read().join(small, "shard").withColumn("tree", F.pmod("point", F.col("trees")).cast("int"))
    index = Stage(index.select("shard", "tree", "x", "ids"), "trees")
    home = asked.select("query", "vec_id", "x").mapInArrow(
        place, "query long, vec_id long, x array<double>, shard int").join(small, "shard")
    home = home.withColumn("tree", F.pmod("query", F.col("trees")).cast("int")).withColumn("bound", F.lit(float("inf")))
    near = Stage(_searched(index.read(), home.select("query", "vec_id", "x", "shard", "tree", "bound"), k, factor), "near")
    bounds = near.read().groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))
    known = home.select("query", "vec_id", "x", F.col("shard").alias("own"), F.col("tree").alias("own_tree")).join(
        bounds, "query", "left").withColumn("bound", F.coalesce(reach, F.lit(float("inf")))).drop("worst")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, shard = shared.value.open_shards(
                unit(_arrow_matrix(batch.column("x"))), batch.column("bound").to_numpy(), factor)
            for start in range(0, len(q), 10_000):
                part = batch.take(pa.array(q[start: start + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shard[start: start + 10_000])], [*part.schema.names, "shard"])

    visits = known.select("query", "vec_id", "x", "own", "own_tree", "bound").mapInArrow(
        route, "query long, vec_id long, x array<double>, own int, own_tree int, bound double, shard int")
    visits = visits.join(small, "shard").withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    visits = visits.filter((F.col("shard") != F.col("own")) | (F.col("tree") != F.col("own_tree")))
    rest = _searched(index.read(), visits.select("query", "vec_id", "x", "shard", "tree", "bound"), k, factor)
    both = near.read().unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(
        F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, visits: DataFrame, k: int, factor: float) -> DataFrame:
    """The `k` best rows of a tree for each query that visits it; a task sees one tree and a chunk of queries."""
    keys = ["shard", "tree"]
    chunks = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("chunks"))
    left = index.join(chunks, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = visits.join(chunks, keys).withColumn("chunk", F.pmod("query", F.col("chunks")).cast("int"))

    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame({c: [] for c in ("query", "query_id", "vec_id", "score")})
        ids = points["ids"].to_list()
        vectors = _stacked(points["x"])
        # by smallest id: shuffled rows come in any order, which must not decide between ties or shape the tree
        first = [i[0] for i in ids]
        order = np.lexsort((*vectors.T, [v or 0 for v in first], [v is None for v in first]))
        x, ids = scaled(vectors[order]), [ids[i] for i in order]
        q, own = scaled(_stacked(asked["x"])), asked["vec_id"].to_numpy()
        names = asked["query"].to_numpy()
        job = Search(unit(x), unit(q), min(k + 1, len(x)), factor, asked["bound"].to_numpy(float))
        job.visit(build(job.x, LEAF_ROWS), np.arange(len(q)))
        q_lengths, x_lengths = lengths(q), lengths(x)
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        for i in range(len(q)):
            rows = job.rows[i][job.rows[i] >= 0]
            scores = np.einsum("ij,j->i", x[rows], q[i]) / (x_lengths[rows] * q_lengths[i])
            cells = [(-s, v is None, v) for s, r in zip(scores.tolist(), rows, strict=True)
                     for v in ids[r] if v is None or v != own[i]]
            for s, _, v in sorted(cells, key=lambda c: (c[0], c[1], c[2] or 0))[:k]:
                out["query"].append(names[i])
                out["query_id"].append(own[i])
                out["vec_id"].append(v)
                out["score"].append(-s)
        return pd.DataFrame(out).astype({"vec_id": "Int64"})

    left = left.select("x", "ids", *keys, "chunk")
    right = right.select("query", "vec_id", "x", "bound", *keys, "chunk")
    right = right.select([F.col(c).alias(f"q_{c}") for c in right.columns]).toDF(*right.columns)
    grouped = left.groupBy(*keys, "chunk").cogroup(right.groupBy(*keys, "chunk"))
    return grouped.applyInPandas(search, "query long, query_id long, vec_id long, score double")
