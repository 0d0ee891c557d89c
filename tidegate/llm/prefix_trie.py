"""Trie of conversation prefixes by van Emde Boas recursion.

A problem is a root node and the distinct stretches of `2^k` turns that conversations through this root continue with.
A round cuts all problems of a height at half depth at once: the distinct upper halves, each named by the smallest
conversation that has it, are the problems of the upper tries; what follows a name is a problem of the lower forests.
After as many rounds as the longest conversation has doublings, each problem is one turn below one node, that is a
node. Equal stretches below a root are one row with a count, so copies and common openings shrink in the first rounds.

Totals go upward over the same cuts, tallest first: what lies below a cut name is added to the node above the cut.
Every round is a few joins and sums over rows of numbers, and is written before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.llm.heavy import lookup
from tidegate.llm.staging import Stage

#: Ids that one piece of a list of ids spans; a piece so has at most as many ids.
ID_RANGE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def ordered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, pos, token, size): places from 0 by turn (null first, ties by role and text), a digest of role and text,
    the text's bytes.

    Rows are sorted by range first, so a conversation with a large share of all rows lies in several partitions, which
    count from where the one before ended. Rows without a conversation are left out; null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    token = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("text"), token.alias("token"),
        F.octet_length(text).cast("long").alias("size"))
    order = ["turn", "role", "text"]
    ranged = rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    here = Stage(ranged.select("part", "conv", *order, "token", "size"), "turns")
    counts = here.read().groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    placed = here.read().withColumn("inside", inside).join(offsets, ["conv", "part"])
    return placed.select("conv", (F.col("before") + F.col("inside")).alias("pos"), "token", "size")


def rebuilt(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where conversation c opens with the first h turns of c - c % group, and goes on with its
    own turns after the first h; h is the checksum of c as decimal text, modulo `spread`."""
    own = turns.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % spread))
    convs = own.groupBy("conv", "h").agg(F.max("pos").alias("last"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % group)
    sizes = convs.select(F.col("conv").alias("base"), (F.col("last") + 1).alias("base_turns"))
    convs = convs.join(sizes, "base", "left").withColumn(
        "opening", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("turns", F.col("opening") + F.greatest(F.col("last") + 1 - F.col("h"), F.lit(0)))
    opening = turns.filter(F.col("pos") < spread - 1).withColumnRenamed("conv", "base").join(
        convs.select("base", "conv", "opening"), "base").filter("pos < opening")
    rest = own.filter("pos >= h").join(convs.select("conv", "opening"), "conv")
    both = opening.select("conv", "pos", "token", "size").unionByName(
        rest.select("conv", (F.col("pos") - F.col("h") + F.col("opening")).alias("pos"), "token", "size"))
    return convs.select("conv", "turns"), both


class _Blocks:
    """Digests of stretches of 2^k turns, for each k: written tables (conv, j, block, left, right)."""

    def __init__(self, turns: DataFrame, longest: int):
        self.levels = [Stage(turns.select("conv", F.col("pos").alias("j"), F.col("token").alias("block"), "size"), "blocks-0")]
        while 1 << (len(self.levels) - 1) < longest + 1:
            self.levels.append(Stage(self._pairs(self.levels[-1].read()), f"blocks-{len(self.levels)}"))

    @staticmethod
    def _pairs(below: DataFrame) -> DataFrame:
        side = F.col("j") % 2
        halves = below.groupBy("conv", F.shiftright("j", 1).alias("j")).agg(
            F.max(F.when(side == 0, F.col("block"))).alias("left"),
            F.max(F.when(side == 1, F.col("block"))).alias("right"))
        joined = F.concat("left", F.coalesce("right", F.lit(b"")))
        return halves.select("conv", "j", F.unhex(F.sha2(joined, 256)).alias("block"), "left", "right")


def _cut(problems: DataFrame, blocks: DataFrame) -> Stage:
    """One round: cuts all problems and returns those of half their height.

    Problems are (j, root, rep, n, end_rep): place, root and smallest conversation of a distinct stretch, number of
    conversations, and the smallest of those that end in it.
    """
    ends = F.when(F.col("right").isNull(), F.col("end_rep"))
    halves = Stage(problems.join(blocks.select(F.col("conv").alias("rep"), "j", "left", "right"), ["rep", "j"]), "halves")
    upper = Stage(halves.read().groupBy("j", "root", "left").agg(
        F.min("rep").alias("rep"), F.sum("n").alias("n"), F.min(ends).alias("end_rep"),
        F.count(F.lit(1)).alias("rows")), "upper")
    named = upper.read().select("j", "root", "left", "rows", F.col("rep").alias("name"))
    below = halves.read().filter("right is not null")
    lower = lookup(below, named, ["j", "root", "left"], "rows", ["name"])
    following = upper.read().select((F.col("j") * 2).alias("j"), "root", "rep", "n", "end_rep").unionByName(
        lower.select((F.col("j") * 2 + 1).alias("j"), F.col("name").alias("root"), "rep", "n", "end_rep"))
    done = Stage(following, "problems")
    halves.drop()
    upper.drop()
    return done


def _end_lists(convs: DataFrame) -> DataFrame:
    """(rep, turns, whole, ends_sha256) of each distinct whole sequence; convs has conv, turns, whole.

    Ids are joined to texts by ranges of ids first, and the texts of a sequence are hashed in order by one task, which
    holds one text at a time.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = convs.withColumn("range", F.floor(F.col("conv") / ID_RANGE)).groupBy("whole", "turns", "range").agg(
        piece.alias("ids"), F.min("conv").alias("first"))
    ordered = pieces.repartition("whole").sortWithinPartitions("whole", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0] == row["whole"]:
                    held[3].update(b"," + row["ids"].encode())
                    continue
                if held:
                    done.append((*held[:3], held[3].hexdigest()))
                held = [row["whole"], row["turns"], row["first"], hashlib.sha256(row["ids"].encode())]
            if done:
                yield _ends_batch(done)
                done = []
        if held:
            yield _ends_batch([(*held[:3], held[3].hexdigest())])

    return ordered.select("whole", "turns", "first", "ids").mapInArrow(
        run, "whole binary, turns long, rep long, ends_sha256 string")


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    whole, turns, rep, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(whole, pa.binary()), pa.array(turns, pa.int64()), pa.array(rep, pa.int64()), pa.array(sha, pa.string())],
        ["whole", "turns", "rep", "ends_sha256"])


def _grafted(own: DataFrame, parents: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """Totals over subtrees of `own` (conv_id, depth, leaves, saved), tallest cuts first.

    cuts[k] has, for stretches of 2^k turns, the name at half depth: (rep, j, name). A node at or below the cut of its
    stretch counts for the cut name above it, whose parent gets the sum.
    """
    added: list[Stage] = []
    for k in range(len(cuts) - 1, 0, -1):
        half = 1 << (k - 1)
        rows = own
        for stage in added:
            rows = rows.unionByName(stage.read())
        sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
        low = rows.filter(F.col("depth").bitwiseAND(F.lit(half)) != 0).groupBy(
            "conv_id", F.shiftright("depth", k).alias("j")).agg(*sums)
        # a node at the cut itself needs no name: it is its own
        named = low.join(cuts[k].withColumnRenamed("rep", "conv_id"), ["conv_id", "j"], "left")
        below = named.groupBy("j", F.coalesce("name", "conv_id").alias("name")).agg(*sums)
        at = F.col("j") * (2 * half) + half
        up = below.withColumn("depth", at).join(
            parents.select(F.col("conv_id").alias("name"), "depth", "parent_conv_id"), ["name", "depth"])
        up = up.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*sums)
        added.append(Stage(up, "grafts"))
    rows = own
    for stage in added:
        rows = rows.unionByName(stage.read())
    return rows.groupBy("conv_id", "depth").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of given conversations: convs (conv, turns), turns (conv, pos, token, size).

    Returns one row a node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members),
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members less one times the
    bytes of the last text), ends_sha256 (of the ids of members that end there). No conversations: no rows. All ids
    are different; conversations without turns are members of the root alone.
    """
    spark = convs.sparkSession
    head = convs.agg(F.max("turns"), F.min("conv"), F.count(F.lit(1))).first()
    longest, first, total = head
    if not total:
        return spark.createDataFrame([], NODE)
    blocks = _Blocks(turns, longest)
    top = len(blocks.levels) - 1
    whole = Stage(convs.join(blocks.levels[top].read().select("conv", F.col("block").alias("whole")), "conv", "left"), "whole")
    listed = Stage(_end_lists(whole.read()), "ends")
    starts = whole.read().filter("turns > 0").groupBy("whole").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"))
    problems = [Stage(starts.select(F.lit(0).cast("long").alias("j"), F.lit(first).cast("long").alias("root"), "rep", "n",
                                    F.col("rep").alias("end_rep")), "problems")]
    for k in range(top, 0, -1):
        problems.append(_cut(problems[-1].read(), blocks.levels[k].read()))
    problems.reverse()
    cuts = [None] + [p.read().filter("j % 2 = 1").select("rep", F.shiftright("j", 1).alias("j"), F.col("root").alias("name"))
                     for p in problems[:-1]]
    # one turn below a node: equal turns below one are the next node
    single = problems[0].read().join(
        blocks.levels[0].read().select(F.col("conv").alias("rep"), "j", "block", "size"), ["rep", "j"])
    nodes = single.groupBy("j", "root", "block").agg(
        F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("end_rep").alias("end_rep"),
        F.max("size").alias("size"))
    nodes = nodes.select("conv_id", (F.col("j") + 1).alias("depth"), F.col("root").alias("parent_conv_id"), "n_convs",
                         "end_rep", "size")
    root = spark.createDataFrame([(first, 0, None, total, None, 0)], nodes.schema)
    nodes = Stage(nodes.unionByName(root), "nodes")
    children = nodes.read().filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    shaped = Stage(nodes.read().join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "shaped")
    nodes.drop()
    own = shaped.read().select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    totals = _grafted(own, shaped.read(), cuts)
    ends = listed.read()
    deep = ends.filter("turns > 0").select(F.col("rep").alias("end_rep"), "ends_sha256")
    turnless = ends.filter("turns = 0").agg(F.max("ends_sha256")).first()[0]
    out = shaped.read().join(totals, ["conv_id", "depth"]).join(deep, "end_rep", "left")
    sha = F.coalesce("ends_sha256", F.when(F.col("depth") == 0, F.lit(turnless)), F.lit(EMPTY_SHA))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      sha.alias("ends_sha256"))


def conversation_trie(df: DataFrame, group: int = 5, spread: int = 9, **columns: str) -> DataFrame:
    """The trie of the conversations of a table of turns, each rebuilt with the opening of its group's first one.

    Nulls, ties, repeated rows and missing ids: see `ordered_turns`; further columns are not looked at; an empty table
    has no nodes. Tables of the result's last join stay in the checkpoint folder.
    """
    placed = Stage(ordered_turns(df, **columns), "placed")
    convs, turns = rebuilt(placed.read(), group, spread)
    convs, turns = Stage(convs, "conversations"), Stage(turns, "rebuilt")
    placed.drop()
    return trie(convs.read(), turns.read())
