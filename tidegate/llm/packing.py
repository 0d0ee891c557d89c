"""Sum-of-squares packing of token pieces into training sequences.

Pieces come in turn. A piece of length s goes into an open sequence with gap g >= s, or opens a new one, so that the
sum over gaps of (number of open sequences with this gap) squared becomes smallest. With N(g) such sequences, the
move from gap g to gap g - s changes the sum by 2 (N(g - s) - N(g)) + 2; filling g up by 1 - 2 N(g); opening a new
one by 2 N(capacity - s) + 1. Only these counts matter, so a step costs one pass over at most `capacity` counters.

The decisions need the pieces one after the other. Rows are dealt evenly by a hash to groups of about `group_pieces`
pieces; each group is packed by itself in one task and leaves a few sequences unfilled, a share that does not grow
with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.staging import Stage
from tidegate.llm.tokens import default_tokenizer, encoder
from tidegate.llm.words import slices

CAPACITY = 2048
GROUP_PIECES = 250_000
PIECES = "doc_id long, piece long, start long, length long, ids binary"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece in turn: the number of its sequence and its place there. Lengths are 1 to capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        here = counts[s:]
        change = 2 * (counts[: capacity + 1 - s] - here) + 2  # from gap g = s + index to gap index
        change[0] = 1 - 2 * counts[s]  # a full sequence has no gap any more
        change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        new = 2 * counts[capacity - s] + 1 if s < capacity else 0
        if new < change[best]:
            gap, bin_ = capacity, used
            used += 1
        else:
            gap = s + best
            bin_ = open_by_gap[gap].pop()
            counts[gap] -= 1
        bins[i], places[i] = bin_, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            open_by_gap[gap - s].append(bin_)
    return bins, places


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Whole texts as token ids with the end id, cut into pieces of `capacity` ids; ids as 4 little-endian bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, offsets = encode.encode(texts[a:b])
                ids = np.insert(flat, offsets[1:], end_id).astype("<u4")
                ends = offsets[1:] + np.arange(1, b - a + 1)
                sizes = np.diff(ends, prepend=0)
                each = -(-sizes // capacity)
                owner = np.repeat(np.arange(b - a), each)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                begin = piece * capacity
                length = np.minimum(capacity, sizes[owner] - begin)
                at = (ends - sizes)[owner] + begin
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, b - a).take(pa.array(owner)), pa.array(piece), pa.array(begin), pa.array(length),
                    pa.array([ids[x: x + n].tobytes() for x, n in zip(at, length, strict=True)], pa.binary()),
                ], ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
                   group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack token pieces of all documents into sequences of at most `capacity` ids.

    Returns a row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids (4 bytes
    each, little-endian), ids_crc32, sequence_id, offset (its place in the sequence; a sequence has no gaps). Only
    documents longer than `capacity` are cut. A null text is empty and still takes its end id; rows with equal or
    null ids are packed each for itself; without rows the result is empty.
    """
    cut = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col)
    staged = Stage(cut.withColumn("row", F.monotonically_increasing_id()).withColumn("ids_crc32", F.crc32("ids")),
                   "pieces").read()
    groups = max(1, -(-staged.count() // group_pieces))
    plan = (
        staged.select("row", F.col("length").cast("int").alias("length"),
                      F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
        .groupBy("group").applyInPandas(_packed(capacity), "row long, sequence_id long, offset long")
    )
    return staged.join(plan, "row").drop("row")


def _packed(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # longest first: what fills gaps comes last; a hash mixes equal lengths of long and short documents
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, places = sum_of_squares(rows["length"].to_numpy(), capacity)
        # numbers of different groups never meet
        return pd.DataFrame({"row": rows["row"], "sequence_id": bins * (1 << 24) + rows["group"], "offset": places})

    return pack


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (pieces in order of offset), n_pieces, n_tokens."""
    in_order: Column = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.unhex(F.concat_ws("", F.transform(in_order, lambda p: p["ids"]))).alias("ids"),
        F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"),
    )
