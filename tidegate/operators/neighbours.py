"""Exact k nearest neighbours within a category, by pivots and triangle-inequality pruning.

Points are assigned to the nearest of a bounded number of pivots and each cell is cut into blocks.
A query first searches one block of its own cell, which bounds the distance of its k-th
neighbour, and then only those blocks whose cell can hold something closer. A task sees one block
of points and a bounded chunk of queries and returns at most k candidates per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidegate.operators.sampling import assign_parts
from tidegate.session import stage

BLOCK_ROWS = 2000
QUERY_CHUNK = 20_000
MAX_PIVOTS = 256
MAX_PIVOT_CELLS = 4_000_000  # pivots * dimensions that are sent to every task


def nearest(points: DataFrame, queries: DataFrame, k: int, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest points of every query, the query's own point included.

    `points` has id, category, x (array of double), all ids different; `queries` is a subset of
    it with the same columns. Returns id, neighbour, distance.
    """
    pivots = choose_pivots(points, seed, block_rows)
    assign = _assigner(points.sparkSession, pivots)
    placed = stage(points.mapInPandas(assign, "id long, category string, x array<double>, cell int, d double"), "placed")
    cells = placed.groupBy("category", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("d").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    resident = placed.join(cells.drop("size", "radius"), ["category", "cell"]).withColumn("block", block)
    resident = stage(resident, "blocks")
    asked = resident.join(queries.select("id"), "id", "left_semi")

    first = _search(resident, asked.select("id", "category", "x", "cell", "block"), k)
    bound = first.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    reach = asked.join(bound, "id")
    radii = {(r.category, r.cell): r.radius for r in cells.select("category", "cell", "radius").collect()}
    visits = reach.mapInPandas(
        _visitor(points.sparkSession, pivots, radii), "id long, category string, x array<double>, own int, own_block int, cell int")
    visits = visits.join(cells.select("category", "cell", "blocks"), ["category", "cell"])
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = visits.filter((F.col("cell") != F.col("own")) | (F.col("block") != F.col("own_block")))
    rest = _search(resident, visits.select("id", "category", "x", "cell", "block"), k)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return first.unionByName(rest).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def choose_pivots(points: DataFrame, seed: int, block_rows: int = BLOCK_ROWS) -> dict[str, np.ndarray]:
    """Random points per category, about one per block, their total size bounded by settings."""
    shape = points.agg(F.countDistinct("category").alias("c"), F.max(F.size("x")).alias("d")).first()
    limit = max(1, min(MAX_PIVOTS, MAX_PIVOT_CELLS // max(1, shape.c * (shape.d or 1))))

    def limits(totals):
        return totals.withColumn("_k1", F.least(F.ceil(F.col("n") / block_rows), F.lit(limit)).cast("long"))

    rows = assign_parts(points, ["category"], seed, limits, 2, key=["id"]).filter("_part = 0").orderBy("id").toPandas()
    return {c: np.unique(np.stack(part["x"].to_numpy()), axis=0) for c, part in rows.groupby("category")}


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _assigner(spark, pivots):
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            for category, part in pdf.groupby("category"):
                d = _distances(np.stack(part["x"].to_numpy()), shared.value[category])
                cell = d.argmin(1)
                yield part[["id", "category", "x"]].assign(cell=cell.astype("int32"), d=d[np.arange(len(part)), cell])

    return assign


def _visitor(spark, pivots, radii):
    """Cells that may hold a point within a query's bound.

    A point of cell j is nearer to pivot j than to the query's pivot, and not farther from pivot j
    than the cell radius; both give a lower bound of its distance to the query. A small slack
    covers rounding.
    """
    shared = spark.sparkContext.broadcast((pivots, radii))

    def visit(batches):
        pivots, radii = shared.value
        for pdf in batches:
            for category, part in pdf.groupby("category"):
                centres = pivots[category]
                radius = np.array([radii.get((category, j), -np.inf) for j in range(len(centres))])
                d = _distances(np.stack(part["x"].to_numpy()), centres)
                own = part["cell"].to_numpy()
                mine = d[np.arange(len(part)), own]
                between = _distances(centres, centres)[own]
                plane = np.divide(d**2 - mine[:, None] ** 2, 2.0 * between, out=np.zeros_like(d), where=between > 0)
                lower = np.maximum(plane, d - radius[None, :])
                slack = 1e-7 * (1.0 + d)
                row, cell = np.nonzero(lower - slack <= part["bound"].to_numpy()[:, None])
                chosen = part.iloc[row]
                yield pd.DataFrame({
                    "id": chosen["id"].to_numpy(), "category": category, "x": chosen["x"].to_numpy(),
                    "own": chosen["cell"].to_numpy(), "own_block": chosen["block"].to_numpy(), "cell": cell.astype("int32"),
                })

    return visit


def _search(resident: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The k best points of a block for every query that visits it, queries in bounded chunks."""
    keys = ["category", "cell", "block"]
    chunks = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("chunks"))
    left = resident.select("id", "x", *keys).join(chunks, keys)
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = visits.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "neighbour", "distance"]
        if points.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        ids, x = points["id"].to_numpy(), np.stack(points["x"].to_numpy())
        out = []
        for start in range(0, len(asked), 1024):
            part = asked.iloc[start : start + 1024]
            q = np.stack(part["x"].to_numpy())
            take = min(k, len(ids))
            approx = _distances(q, x)
            near = np.argpartition(approx, min(take + 8, len(ids)) - 1, axis=1)[:, : min(take + 8, len(ids))]
            exact = np.sqrt(((q[:, None, :] - x[near]) ** 2).sum(2))
            order = np.lexsort((ids[near], exact), axis=1)[:, :take]
            rows = np.arange(len(part))[:, None]
            out.append(pd.DataFrame({
                "id": np.repeat(part["id"].to_numpy(), take), "neighbour": ids[near][rows, order].ravel(),
                "distance": exact[rows, order].ravel(),
            }))
        return pd.concat(out, ignore_index=True)

    # Both sides come from one table; new column identities keep the cogroup unambiguous.
    left, right = left.select("id", "x", *keys, "chunk"), right.select("id", "x", *keys, "chunk")
    right = right.select([F.col(c).alias(f"q_{c}") for c in right.columns]).toDF(*right.columns)
    grouped = left.groupBy(*keys, "chunk").cogroup(right.groupBy(*keys, "chunk"))
    return grouped.applyInPandas(search, "id long, neighbour long, distance double")
