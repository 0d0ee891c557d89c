"""Shared parts of the similarity joins: shingle sets, candidate links through common tokens, exact verification.

A node is a class of equal shingle sets. Nodes with the same tokens and size form a group, named by its smallest
node. Candidates are groups that share a token. All pairs of a long list of groups are never formed at first: every
group is paired with a few hubs of each of its lists, links found are contracted to components, and a last look is at
all pairs that lie in different components, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.components import connected_components
from tidegate.llm.staging import Stage
from tidegate.llm.words import Words, mixed

HUBS = 2
#: Pairs a posting that may be looked at without hubs, and the longest list of which all pairs are: a bound that does not
#: grow with the tables, whose lists do.
PAIRS_AT_ONCE = 16
SHORT = 64
PRINTS = ("print0", "print1", "print2", "print3")


@dataclass(frozen=True)
class Threshold:
    """Similar: whole * intersection >= part * union."""

    part: int
    whole: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Tokens to index of a set of n, so that similar sets share one, in any order common to all sets."""
        return np.where(n > 0, n + (-self.part * n) // self.whole + 1, 0)

    def sizes_allow(self, m: Column, n: Column) -> Column:
        """Whether different sets of these sizes can be similar: at best the smaller lies in the larger one; of equal
        sizes, all members but one are common."""
        common = F.when(m == n, n - 1).otherwise(F.least(m, n))
        return common * self.whole >= (m + n - common) * self.part

    def prints_allow(self, x: str, y: str, m: Column, n: Column) -> Column:
        """Whether two fingerprints (the columns PRINTS below x and y) differ in no more bits than similar sets in
        members."""
        differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PRINTS), F.lit(0))
        return differ * (self.whole + self.part) <= (m + n) * (self.whole - self.part)

    def least_size(self) -> int:
        """Smallest set that can be similar to a different one."""
        return -(-self.part // (self.whole - self.part))

    def met(self, common: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.whole * common >= self.part * (m + n - common)

    def difference(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of similar sets."""
        return (m + n) * (self.whole - self.part) // (self.whole + self.part)


def shingle_sets(found: Words, width: int, starts: np.ndarray, stops: np.ndarray, rank=None):
    """Distinct shingles of stretches of words, sorted within each by (rank, hash).

    Returns (shingles, owner). A stretch of fewer words is one shingle; an empty one has none.
    """
    h = np.pad(found.hashes, (0, width))
    n = len(found.hashes)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + h[k: n + k]
    size = stops - starts
    each = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(starts)), each)
    ends = np.cumsum(each)
    at = np.repeat(starts - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    values = mixed(windows[at])
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():
        whole = 0
        for x in found.hashes[starts[i]: stops[i]].tolist():
            whole = (whole * 0xA0761D6478BD642F + x + 1) & (2 ** 64 - 1)
        values[ends[i] - 1] = mixed(np.array([whole ^ int(size[i])], np.uint64))[0]
    keys = (values, owner) if rank is None else (values, rank(values), owner)
    order = np.lexsort(keys)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its members."""
    return (mixed(summed(mixed(values + np.uint64(1)), offsets)).view(np.int64),
            mixed(summed(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), offsets)).view(np.int64))


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the numbers of members by hash; two bitmaps differ in no more bits than the sets in members."""
    bits = 512
    while bits < min(len(values), 1 << 15):
        bits *= 2
    return np.packbits(np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1,
                       bitorder="little").tobytes()


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Parities of the numbers of members by hash, in one 64-bit word for each of PRINTS; no set may be empty."""
    if len(offsets) < 2:
        return [np.zeros(0, np.int64) for _ in PRINTS]
    bits, word = np.uint64(1) << (values & np.uint64(63)), (values >> np.uint64(6)) % np.uint64(len(PRINTS))
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bits, np.uint64(0)), offsets[:-1]).view(np.int64)
            for k in range(len(PRINTS))]


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """A larger bitmap as the bitmap of fewer bits: members' places modulo the new size."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def _may_be_similar(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            allowed = threshold.difference(m, n)
            keep = np.zeros(len(m), bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                differ = int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum())
                keep[i] = differ <= allowed[i]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])
    return run


def _similar(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep[i] = threshold.met(common, len(p), len(q))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])
    return run


@dataclass(frozen=True)
class Sets:
    """What is known of the nodes' sets: node, n, bits (see `bitmap`) of all; the sets themselves of chosen nodes.

    `fetch` takes a frame of nodes and returns node, shingles (sorted, 8 bytes each); a row may come out twice.
    """

    outlines: DataFrame
    fetch: Callable[[DataFrame], DataFrame]


def verified(pairs: DataFrame, sets: Sets, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are fetched only for pairs that sizes and bitmaps leave open."""
    left, right = (sets.outlines.select(F.col("node").alias(x), F.col("n").alias(y), F.col("bits").alias(z))
                   for x, y, z in (("a", "m", "x"), ("b", "n", "y")))
    first = pairs.join(left, "a").join(right, "b").filter(threshold.sizes_allow(F.col("m"), F.col("n")))
    likely = Stage(first.select("a", "b", "m", "n", "x", "y").mapInArrow(
        _may_be_similar(threshold), "a long, b long"), "likely")
    nodes = likely.read().select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = Stage(sets.fetch(nodes).select("node", "shingles"), "sets")
    both = (likely.read()
            .join(whole.read().select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(whole.read().select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    out = Stage(both.select("a", "b", "x", "y").mapInArrow(_similar(threshold), "a long, b long"), "links")
    likely.drop()
    whole.drop()
    return out.read()


def shared_tokens(postings: DataFrame) -> DataFrame:
    """Postings (token, gid, n, pos) of tokens that two groups or more have, and how many have the token (among)."""
    common = postings.groupBy("token").agg(
        F.min("gid").alias("low"), F.max("gid").alias("high"), F.count(F.lit(1)).alias("among")).filter("low < high")
    return postings.join(common.select("token", "among"), "token")


def linked_components(groups: DataFrame, shared: DataFrame, sets: Sets, threshold: Threshold,
                      positions: bool, hubs: int = HUBS, at_once: int = 0) -> DataFrame:
    """(node, component) of all nodes that are similar to another one.

    `groups`: (node, gid) of the nodes of groups of several; `shared`: postings of common tokens, with fingerprints of
    the sets (columns PRINTS) if groups are single nodes. With `positions`, tokens are prefixes in a common order, and what can still match behind a token is bounded by its position.
    With `at_once`, groups must be single nodes: the shortest lists, of up to SHORT postings and up to `at_once` pairs a
    posting of all lists together, have all their pairs looked at; only longer ones have hubs and a last look.
    """
    few, longer = _few(shared, at_once) if at_once else (0, True)
    if few > SHORT:  # lengths go by powers of two: some list is longer
        few, longer = SHORT, True
    inside = groups.filter("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    long_lists = shared.filter(F.col("among") > few) if few else shared
    found = None
    for last in (False, True) if longer else (False,):
        if last:
            now, members = _labelled(groups, long_lists, found)
            pairs = _node_pairs(now, threshold, positions) if at_once else _all_pairs(now, members, threshold, positions)
        else:
            pairs = inside
            if few:
                short = shared.filter(F.col("among") <= few)
                pairs = pairs.unionByName(short.alias("l").join(short.alias("r"), _may_link(short, threshold, positions)).select(
                    F.col("l.gid").alias("a"), F.col("r.gid").alias("b")))
            if longer:
                pairs = pairs.unionByName(_hub_pairs(long_lists, threshold, hubs))
        pairs = Stage(pairs.distinct(), "pairs")
        if pairs.read().isEmpty():
            pairs.drop()
            continue
        links = verified(pairs.read(), sets, threshold)
        if found is not None:  # components so far, as stars
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = Stage(connected_components(links), "components").read()
        pairs.drop()
    if found is None:
        return groups.sparkSession.createDataFrame([], "node long, component long")
    return found


def _hub_pairs(postings: DataFrame, threshold: Threshold, hubs: int) -> DataFrame:
    """Each group of a list with its hubs: the ends of the order, then others by a hash."""
    marks = [c for c in PRINTS if c in postings.columns]
    whole = F.struct("gid", "n", *marks)
    chosen = [F.min(whole), F.max(whole), *[F.min_by(whole, F.xxhash64("gid", F.lit(k))) for k in range(2, hubs)]]
    hub = postings.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("hubs"))
    met = postings.join(hub, "token").select("gid", "n", *marks, F.explode("hubs").alias("hub")).filter(
        "gid <> hub.gid").filter(threshold.sizes_allow(F.col("n"), F.col("hub.n")))
    if marks:
        met = met.withColumn("own", F.struct(*marks)).filter(threshold.prints_allow("own", "hub", F.col("n"), F.col("hub.n")))
    return met.select(F.least("gid", "hub.gid").alias("a"), F.greatest("gid", "hub.gid").alias("b"))


def _few(shared: DataFrame, at_once: int) -> tuple[int, bool]:
    """The length (a power of two) up to which lists together make at most `at_once` pairs a posting; whether some are longer."""
    lengths = shared.groupBy(F.ceil(F.log2("among")).cast("int").alias("power")).agg(
        F.count(F.lit(1)).alias("postings"), F.sum((F.col("among") - 1) / 2).alias("pairs")).orderBy("power").collect()
    few, pairs, most = 0, 0, at_once * sum(r.postings for r in lengths)
    for r in lengths:
        pairs += r.pairs
        if pairs > most:
            return few, True
        few = 1 << r.power
    return few, False


def _labelled(groups: DataFrame, shared: DataFrame, found: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Postings with the smallest and largest component of the group (label, high), and nodes with their label."""
    if found is None:
        now = shared.withColumns({"label": F.col("gid"), "high": F.col("gid")})
        return now, groups.withColumn("label", F.col("node"))
    label = found.select("node", F.col("component").alias("label"))
    members = groups.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_group = members.groupBy("gid").agg(F.min("label").alias("low_"), F.max("label").alias("high_"))
    own = label.withColumnsRenamed({"node": "gid", "label": "own"})
    now = shared.join(own, "gid", "left").join(of_group, "gid", "left").select(
        *shared.columns, F.coalesce("low_", "own", "gid").alias("label"), F.coalesce("high_", "own", "gid").alias("high"))
    open_ = now.groupBy("token").agg(F.min("label").alias("low_"), F.max("high").alias("high_")).filter("low_ < high_")
    return Stage(now.join(open_.select("token"), "token"), "open").read(), members


def _may_link(postings: DataFrame, threshold: Threshold, positions: bool) -> Column:
    """Whether two postings l and r of a token, the smaller group first, can be of similar sets."""
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.gid") < F.col("r.gid"))
    same &= threshold.sizes_allow(F.col("l.n"), F.col("r.n"))
    if set(PRINTS) <= set(postings.columns):
        same &= threshold.prints_allow("l", "r", F.col("l.n"), F.col("r.n"))
    if positions:
        rest = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
        total = F.col("l.n") + F.col("r.n")
        same &= rest * (threshold.whole + threshold.part) >= total * threshold.part
    return same


def _node_pairs(now: DataFrame, threshold: Threshold, positions: bool) -> DataFrame:
    """All pairs of single nodes in different components that share a token."""
    return now.alias("l").join(now.alias("r"), _may_link(now, threshold, positions) & (F.col("l.label") != F.col("r.label"))).select(
        F.col("l.gid").alias("a"), F.col("r.gid").alias("b"))


def _all_pairs(now: DataFrame, members: DataFrame, threshold: Threshold, positions: bool) -> DataFrame:
    """All pairs of nodes in different components whose groups share a token or are the same."""
    left, right = now.alias("l"), now.alias("r")
    same = _may_link(now, threshold, positions) & ~(
        (F.col("l.label") == F.col("r.high")) & (F.col("l.high") == F.col("r.label")))
    pairs = left.join(right, same).select(F.col("l.gid").alias("g"), F.col("r.gid").alias("h")).distinct()
    # groups of one node stand for themselves
    nodes = members.select("gid", "node", "label")
    names = now.select("gid", F.col("gid").alias("node"), "label").distinct().join(
        members.select("gid").distinct(), "gid", "left_anti")
    nodes = nodes.unionByName(names)
    a = nodes.select(F.col("gid").alias("g"), F.col("node").alias("a"), F.col("label").alias("la"))
    b = nodes.select(F.col("gid").alias("h"), F.col("node").alias("b"), F.col("label").alias("lb"))
    across = pairs.join(a, "g").join(b, "h").filter("la <> lb").select("a", "b")
    inner = members.alias("l").join(members.alias("r"), (F.col("l.gid") == F.col("r.gid")) & (
        F.col("l.node") < F.col("r.node")) & (F.col("l.label") != F.col("r.label"))).select(
        F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inner)
