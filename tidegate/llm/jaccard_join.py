"""Grouped prefix join: documents linked by the Jaccard similarity of their word shingles, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.similarity import (
    Sets, Threshold, bitmap, linked_components, set_hashes, shared_tokens, shingle_sets, summed)
from tidegate.llm.staging import Stage
from tidegate.llm.words import WHITE, Words, mixed, slices

WIDTH = 4
JACCARD = Threshold(85, 100)
#: Counters of the common order: shingles share them by hash, 4 bytes each, whatever the number of documents.
SLOTS = 1 << 20
FAN_IN = 16
SIGNATURE = "doc_id long, n long, h1 long, h2 long, hp long, bits binary, prefix binary"


def _sets(texts: list[str], width: int, rank=None):
    found = Words(texts, WHITE)
    values, owner = shingle_sets(found, width, found.bounds[:-1], found.bounds[1:], rank)
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def counted_shingles(rows: DataFrame, width: int, slots: int) -> np.ndarray:
    """Number of documents for each slot of shingle hashes.

    The counts only set the order of tokens: shingles of rare slots first. Any common order gives the same links; this
    one keeps what many documents share out of their prefixes. Each task counts its documents; counters are added up
    FAN_IN at a time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                values, _ = _sets(texts[a:b], width)
                counts += np.bincount((values % np.uint64(slots)).astype(np.int64), minlength=slots).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"id": [TaskContext.get().partitionId()], "counts": [counts.tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.uint32) for c in parts["counts"]], axis=0, dtype=np.uint32)
        return pd.DataFrame({"id": [int(parts["id"].iloc[0]) // FAN_IN], "counts": [total.tobytes()]})

    staged = Stage(rows.mapInArrow(count, "id long, counts binary"), "counts")
    while staged.read().count() > 1:
        grouped = staged.read().groupBy(F.floor(F.col("id") / FAN_IN)).applyInPandas(add, "id long, counts binary")
        following = Stage(grouped, "counts")
        staged.drop()
        staged = following
    found = staged.read().first()
    staged.drop()
    return np.frombuffer(found["counts"], np.uint32) if found else np.zeros(slots, np.uint32)


def _rank(counts: np.ndarray):
    return lambda values: counts[(values % np.uint64(len(counts))).astype(np.int64)]


def signatures(rows: DataFrame, counts: np.ndarray, width: int, threshold: Threshold) -> DataFrame:
    """Per document: set size, hashes of the set, and its prefix in the common order with the prefix's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _rank(counts)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                values, offsets = _sets(texts[a:b], width, rank)
                n = np.diff(offsets)
                h1, h2 = set_hashes(values, offsets)
                cut = offsets[:-1] + threshold.prefix(n)
                prefixes = [values[x:y] for x, y in zip(offsets[:-1], cut, strict=True)]
                flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int64)
                hp = mixed(summed(mixed(flat), ends)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n), pa.array(h1), pa.array(h2), pa.array(hp),
                    pa.array([bitmap(values[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                    pa.array([p.astype("<i8").tobytes() for p in prefixes], pa.binary())],
                    ["doc_id", "n", "h1", "h2", "hp", "bits", "prefix"])

    return rows.mapInArrow(run, SIGNATURE)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [np.frombuffer(p, "<i8") for p in batch.column(2).to_pylist()]
        each = np.array([len(t) for t in tokens], np.int64)
        own = pa.array(np.repeat(np.arange(len(each)), each))
        ends = np.cumsum(each)
        pos = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - each, each)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])), batch.column(0).take(own),
            batch.column(1).take(own), pa.array(pos.astype(np.int32))], ["token", "gid", "n", "pos"])


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a document meet here
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for a, b in slices(texts):
                values, offsets = _sets(texts[a:b], width)
                h1, h2 = set_hashes(values, offsets)
                same = (h1 == batch.column(1).slice(a, b - a).to_numpy()) & (h2 == batch.column(2).slice(a, b - a).to_numpy())
                new = [i for i in np.flatnonzero(same).tolist() if nodes[a + i] not in seen]
                new = list({nodes[a + i]: i for i in new}.values())
                seen.update(nodes[a + i] for i in new)
                yield pa.RecordBatch.from_arrays([
                    pa.array([nodes[a + i] for i in new], pa.int64()),
                    pa.array([values[offsets[i]: offsets[i + 1]].tobytes() for i in new], pa.binary())],
                    ["node", "shingles"])
    return run


def jaccard_components(docs: DataFrame, width: int = WIDTH, threshold: Threshold = JACCARD,
                       slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by similar sets of `width`-word shingles.

    Returns a row per input row: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest
    id reachable by links, itself included). Words are runs of non-white characters, A-Z in lower case; a document of
    fewer words is one shingle; empty and null texts have an empty set and are linked with nothing. Rows without an id
    cannot name a component: they get null. Rows with equal ids and sets share theirs. Shingles are compared by 64-bit
    hashes, sets by 128 bits.

    1. Equal sets are one class; classes with equal prefix and size one group (`linked_components` says how groups
       find each other and how members are verified).
    2. Prefixes are indexed in a common order of shingles, those that few documents have first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    order = counted_shingles(rows, width, slots)
    signed = Stage(signatures(rows, order, width, threshold), "signatures").read()
    usable = signed.filter("n > 0 and doc_id is not null")
    classes = Stage(usable.groupBy("n", "h1", "h2", "hp").agg(F.min("doc_id").alias("node")), "classes").read()
    grouped = classes.groupBy("n", "hp").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("size"))
    groups = Stage(grouped, "groups").read()
    named = signed.select("doc_id", "n", "hp", "h1", "prefix").join(
        groups.select(F.col("gid").alias("doc_id"), F.col("n"), F.col("hp")), ["doc_id", "n", "hp"])
    leaders = named.select("doc_id", "n", "prefix")
    postings = leaders.mapInArrow(_tokens, "token long, gid long, n long, pos int")
    shared = Stage(shared_tokens(postings).distinct(), "shared").read()
    several = Stage(classes.join(groups.filter("size > 1").select("n", "hp", "gid"), ["n", "hp"]).select("node", "gid"),
                    "several").read()
    outlines = signed.select(F.col("doc_id").alias("node"), "n", "h1", "h2", "bits").join(
        classes.select("node", "h1", "h2"), ["node", "h1", "h2"])
    outlines = Stage(outlines.groupBy("node", "n").agg(F.min("bits").alias("bits")), "outlines").read()

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node").select("node", "h1", "h2")
        texts = rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "h1", "h2", "body")
        return texts.mapInArrow(_whole_sets(width), "node long, shingles binary")

    found = linked_components(several, shared, Sets(outlines, fetch), threshold, positions=True)
    named_classes = classes.select("n", "h1", "h2", F.col("node").alias("class_id"))
    return (
        signed.select("doc_id", "n", "h1", "h2").join(named_classes, ["n", "h1", "h2"], "left")
        .join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that name their component, with all columns, whatever their names; rows without id stay, rows of
    equal ids stay or go together, empty tables give empty ones."""
    later = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("later")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"))
    return row.join(later, F.col(f"row.{id_col}") == F.col("later"), "left_anti").select("row.*")
