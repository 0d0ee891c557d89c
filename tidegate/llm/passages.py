"""Passages of PASSAGE words or more that an earlier document has as well, wherever they stand in sentences.

A gram is GRAM consecutive words. Of each stretch of PASSAGE words the gram of the smallest hash is an anchor, so a
passage of that length has an anchor wherever it stands. An anchor that a document of a smaller id has too is repeated;
from there the texts of both are compared word by word in both directions. Anchors that follow each other in both
documents with the same words between them need no comparison: a hash of these words is compared instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegate.llm.heavy import lookup
from tidegate.llm.staging import Stage
from tidegate.llm.words import NOT_ALNUM, Words, mixed, slices

GRAM = 20
PASSAGE = 50
#: Words compared on either side of an anchor. The next anchor of a passage is at most 31 words away, the one after it 62.
REACH = 64
PLACES = "array<struct<pos:int,hash:long,stop:int,before:binary,after:binary>>"


class Grams:
    """Hashes of stretches of words of some texts."""

    def __init__(self, found: Words):
        self.found = found
        power, self.inverse = Words._power(len(found.hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * power[: len(found.hashes)])])

    def hashed(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        h = (self.sums[stops] - self.sums[starts]) * self.inverse[starts]
        return mixed(h ^ ((stops - starts).astype(np.uint64) << np.uint64(40))).view(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors, in order."""
        bounds, width = self.found.bounds, PASSAGE - GRAM + 1
        n = len(self.found.hashes) - GRAM + 1
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n)
        grams = self.hashed(at, at + GRAM)
        order = grams.view(np.uint64)
        least = _slid(order, width, np.minimum)
        whole = np.zeros(len(least), bool)  # stretches within one text
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            whole[a: max(a, b - PASSAGE + 1)] = True
        least = np.where(whole, least, np.uint64(0))
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero((_slid(padded, width, np.maximum) == order) & (order > 0))
        same = grams[chosen]
        # a gram that overlaps itself again and again is kept once every GRAM words, and at the last of them
        new = np.ones(len(chosen), bool)
        new[1:] = (same[1:] != same[:-1]) | (np.diff(chosen) > GRAM)
        run = np.cumsum(new) - 1
        bucket = (chosen - chosen[new][run]) // GRAM if len(chosen) else chosen
        keep = new.copy()
        keep[1:] |= bucket[1:] != bucket[:-1]
        keep[:-1] |= new[1:]
        keep[-1:] = True
        return chosen[keep], same[keep]


def _slid(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each `width` consecutive values."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:n], values[width - size: width - size + n])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            found = Words(texts[a:b], NOT_ALNUM)
            grams = Grams(found)
            at, hashes = grams.anchors()
            owner = np.searchsorted(found.bounds, at, "right") - 1
            following = np.append(at[1:], 0) if len(at) else at
            last = np.append(owner[1:] != owner[:-1], True) if len(at) else np.zeros(0, bool)
            following = np.where(last, at, following)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a).take(pa.array(owner)),
                pa.array((at - found.bounds[owner]).astype(np.int32)), pa.array(hashes),
                pa.array((following - at).astype(np.int32)),
                pa.array(np.where(last, 0, grams.hashed(at + GRAM, following + GRAM)))],
                ["doc", "pos", "hash", "step", "gap"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes on one side of wanted anchors, nearest first."""
    for batch in batches:
        texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            found = Words(texts[a:b], NOT_ALNUM)
            grams = Grams(found)
            out: list[tuple] = []
            for i in range(b - a):
                low, high = int(found.bounds[i]), int(found.bounds[i + 1])
                for w in wanted[a + i]:
                    at = low + w["pos"]
                    if not stands(grams, at, high, w["hash"]):
                        continue
                    words = (found.hashes[max(low, at - REACH): at][::-1] if w["before"]
                             else found.hashes[at + GRAM: min(high, at + GRAM + REACH)])
                    out.append((w["hash"], w["before"], short(words).tobytes()))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()),
                pa.array([x[2] for x in out], pa.binary())], ["hash", "before", "words"])


def short(hashes: np.ndarray) -> np.ndarray:
    """What is kept of the words around an anchor, which are alike word by word: half of each hash."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def stands(grams: Grams, at: int, high: int, value: int) -> bool:
    """Whether the gram of this hash is at a place (rows of equal ids may have other texts)."""
    return at + GRAM <= high and int(grams.hashed(np.array([at]), np.array([at + GRAM]))[0]) == value


def mark(covered: np.ndarray, grams: Grams, low: int, high: int, places: list[dict]) -> None:
    """Marks the words of repeated passages of one text, which are those from low to high."""
    hashes = grams.found.hashes
    for p in places:
        at = low + p["pos"]
        if not stands(grams, at, high, p["hash"]):
            continue
        before = after = 0
        if p["before"]:
            before = _equal(short(hashes[max(low, at - REACH): at][::-1]), np.frombuffer(p["before"], np.uint32))
        if p["after"]:
            after = _equal(short(hashes[at + GRAM: min(high, at + GRAM + REACH)]), np.frombuffer(p["after"], np.uint32))
        covered[at - before: max(at + GRAM + after, low + p["stop"])] = True


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def repeated_passages(rows: DataFrame) -> DataFrame:
    """(doc, places) for rows (doc, body): anchors that a document with a smaller id has too, see `mark`."""
    posted = Stage(rows.mapInArrow(_posted, "doc long, pos int, hash long, step int, gap long"), "anchors")
    anchors = posted.read()
    heads = anchors.groupBy("hash").agg(
        F.min(F.struct("doc", "pos", "step", "gap")).alias("head"), F.max("doc").alias("last"),
        F.count(F.lit(1)).alias("rows")).filter("head.doc < last")
    heads = Stage(heads.select("hash", "head", "rows"), "heads")
    matched = Stage(lookup(anchors, heads.read(), ["hash"], "rows", ["head"]).filter("head.doc < doc"), "found")
    posted.drop()
    heads.drop()
    order = Window.partitionBy("doc").orderBy("pos")
    followed = (F.col("step") > 0) & (F.col("step") == F.col("head.step")) & (F.col("gap") == F.col("head.gap"))
    holder = F.col("head.doc")
    linked = F.col("followed") & (F.lead(holder).over(order) == holder)  # the next anchor is compared instead
    joined = matched.read().withColumn("followed", followed).withColumn("linked", F.coalesce(linked, F.lit(False))).select(
        "doc", "pos", "hash", F.col("head.doc").alias("holder"), F.col("head.pos").alias("at"),
        (F.col("pos") + GRAM + F.when(F.col("followed"), F.col("step")).otherwise(0)).cast("int").alias("stop"),
        ~F.coalesce(F.lag(F.col("linked")).over(order) & (
            F.lag(F.col("pos") + F.col("step")).over(order) == F.col("pos")), F.lit(False)).alias("x"),
        ~F.col("linked"))
    joined = Stage(joined.toDF("doc", "pos", "hash", "holder", "at", "stop", "left", "right"), "matched")
    matched.drop()
    sides = F.explode(F.filter(F.array(F.when(F.col("left"), True), F.when(F.col("right"), False)), lambda x: x.isNotNull()))
    edges = joined.read().select("holder", "at", "hash", sides.alias("before"))
    wanted = edges.distinct().groupBy("holder").agg(
        F.collect_list(F.struct(F.col("at").alias("pos"), "hash", "before")).alias("wanted"))
    words = rows.join(wanted, F.col("doc") == F.col("holder")).select("body", "wanted").mapInArrow(
        _contexts, "hash long, before boolean, words binary").dropDuplicates(["hash", "before"])
    uses = edges.groupBy("hash", "before").agg(F.count(F.lit(1)).alias("rows"))
    words = Stage(words.join(uses, ["hash", "before"]), "contexts")

    whole = joined.read()
    for side, flag, name in ((True, "left", "before"), (False, "right", "after")):
        own = words.read().filter(F.col("before") == F.lit(side)).select("hash", "rows", F.col("words").alias(name))
        compared = lookup(whole.filter(F.col(flag)), own, ["hash"], "rows", [name], "left")
        whole = compared.unionByName(whole.filter(~F.col(flag)).withColumn(name, F.lit(None).cast("binary")))
    places = Stage(whole.groupBy("doc").agg(F.collect_list(F.struct(
        "pos", "hash", "stop", "before", "after")).cast(PLACES).alias("places")), "passages")
    joined.drop()
    words.drop()
    return places.read()
