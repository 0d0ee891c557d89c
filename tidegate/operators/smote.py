"""Synthetic minority rows: points on segments between a row and one of its nearest same-class rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegate.functions.hashing import row_hash, unit_hash
from tidegate.operators.neighbours import BLOCK_ROWS, nearest
from tidegate.operators.sampling import COPY_CHUNK, assign_parts
from tidegate.schemas import BENIGN
from tidegate.session import small_table, stage


def smote(rows: DataFrame, neighbours: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Raises every category to the size of the largest one.

    Expects row_id (long, not negative), x (array of double), category. Returns the given rows and
    the synthetic ones, which have negative row ids, with columns row_id, x, category, y, synthetic.
    """
    rows = stage(rows.select("row_id", "x", "category"), "smote")
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    sizes = small_table(counts)
    limits = sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).first()
    if limits.smallest < 2:
        raise ValueError("every category needs at least two rows")
    k = max(1, min(neighbours, limits.smallest - 1))
    largest = limits.largest
    wanted = sizes.withColumn("need", F.lit(largest).cast("long") - F.col("n")).filter("need > 0")
    wanted = wanted.withColumn("each", F.floor(F.col("need") / F.col("n"))).withColumn("more", F.col("need") % F.col("n"))

    def extra(totals):
        return totals.withColumn("_k1", (F.lit(largest).cast("long") - F.col("n")) % F.col("n"))

    shared = assign_parts(rows, ["category"], seed, extra, 2, key=["row_id"])
    per_row = shared.join(wanted, "category").withColumn(
        "synthetic", F.col("each") + F.when(F.col("_part") == 0, 1).otherwise(0))
    # Equal rows become one point with a count, so copies neither fill blocks nor neighbour lists.
    merged = per_row.groupBy("category", "x").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("synthetic").alias("synthetic"))
    points = stage(merged.withColumn("id", F.monotonically_increasing_id()), "points")
    seeds = points.filter("synthetic > 0")
    found = nearest(points.select("id", "category", "x"), seeds.select("id", "category", "x"), k + 1, seed, block_rows)
    named = found.join(points.select(F.col("id").alias("neighbour"), F.col("x").alias("nx"), "copies"), "neighbour")
    # The row itself is no neighbour of its own, its other copies are.
    usable = F.when(F.col("id") == F.col("neighbour"), F.col("copies") - 1).otherwise(F.col("copies"))
    counted = named.withColumn("copies", F.least(usable, F.lit(k)).cast("int")).filter("copies > 0")
    spread = counted.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour", "_c"))
    lists = spread.withColumn("_place", place).filter(F.col("_place") <= k).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("_place", "nx"))).alias("near"))

    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("synthetic") - 1) / COPY_CHUNK).cast("int")))
    jobs = seeds.join(lists, "id").withColumn("_chunk", chunk).repartition("id", "_chunk")
    last = F.least(F.col("synthetic"), (F.col("_chunk") + 1) * F.lit(COPY_CHUNK)) - 1
    drawn = jobs.withColumn("_i", F.explode(F.sequence(F.col("_chunk") * F.lit(COPY_CHUNK).cast("long"), last.cast("long"))))
    pick = F.pmod(row_hash(f"{seed}/pick", ["category", "x", "_i"]), F.size("near")).cast("int")
    step = unit_hash(row_hash(f"{seed}/step", ["category", "x", "_i"]))
    staged = drawn.select("category", "x", "id", "_i", F.col("near")[pick]["nx"].alias("_to"), step.alias("_u"))
    point = F.transform(F.arrays_zip("x", "_to"), lambda e: e["x"] + F.col("_u") * (e["_to"] - e["x"]))
    # Given rows have ids from 0 up, so hashed negative ids cannot meet them.
    new_id = -F.shiftrightunsigned(F.xxhash64("id", "_i"), 1) - 1
    made = staged.select(new_id.alias("row_id"), point.alias("x"), "category", F.lit(True).alias("synthetic"))
    both = rows.select("row_id", "x", "category", F.lit(False).alias("synthetic")).unionByName(made)
    return both.withColumn("y", (F.col("category") != BENIGN).cast("int"))
