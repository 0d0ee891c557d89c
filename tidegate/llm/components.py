"""Connected components of an undirected graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.llm.staging import Stage


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); a component is named by its smallest node.

    Rounds of large-star and small-star steps: every node hangs its larger neighbours, then its smaller ones, on the
    smallest node it sees. Each step is a minimum by node and a join, never a list of neighbours; the
    edges of a round are written before the next, until they stay the same.
    """
    clean = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    current = Stage(clean, "edges")
    before = _print_of(current.read())
    for _ in range(max_rounds):
        following = Stage(_small_star(_large_star(current.read())), "edges")
        after = _print_of(following.read())
        current.drop()
        current = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.read()
    # settled edges are stars: every node of a component hangs on its smallest
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("end")
    both = edges.select(ends).select("end.*")
    # merge: a broadcast of the minima would be one more job a step
    least = both.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    dealt = edges.repartition("u")  # once, for the minimum and for the join
    least = dealt.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
    own, moved = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    both = F.explode(F.when(F.col("v") > F.col("m"), F.array(own, moved)).otherwise(F.array(own))).alias("edge")
    return dealt.join(least, "u").select(both).select("edge.*").distinct()
