"""Substring deduplication by paragraphs: MinHash bands find candidates, exact Jaccard decides, components cluster.

Paragraphs are lines, blocks of lines between blank ones where a text has such, and the sentences of a line joined to
BLOCK words or more.
Those of MIN_WORDS words or more are compared; equal ones are merged before they are banded. Of a component of similar
paragraphs those of the smallest document id stay. Passages that are repeated word by word, wherever they stand in
paragraphs, are found by `passages`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidegate.llm.passages import Grams, mark, repeated_passages
from tidegate.llm.similarity import (
    PAIRS_AT_ONCE, PRINTS, Sets, Threshold, bitmap, fingerprints, linked_components, set_hashes, shared_tokens, shingle_sets)
from tidegate.llm.staging import Stage
from tidegate.llm.words import BYTES, NOT_ALNUM, WHITE, Words, mixed, slices

WIDTH = 5
#: Sentences are joined to blocks of so many words or more.
BLOCK = 50
STOP, LINE_END = np.isin(BYTES, list(b".!?")), np.isin(BYTES, [10])
#: What is neither of a word nor a line end.
GAPS = bytes(np.flatnonzero(NOT_ALNUM & ~LINE_END).astype(np.uint8))
JACCARD = Threshold(80, 100)
RECALL = 0.998
MAX_BANDS = 8
#: Candidates that all of a long list meet, before all pairs of what is left are looked at.
HUBS = 8
#: Sets of so few members have their fingerprints for bitmaps.
PRINTED = 256
#: Paragraphs of so many words are compared, and runs of so many words go.
MIN_WORDS = 20


def tuned_bands(similarity: float, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that still find so many similar pairs."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands <= max_bands:
            best = bands, rows
    if best is None:
        raise ValueError(f"{max_bands} bands cannot find {recall} of the pairs of similarity {similarity}")
    return best


def _stretches(stops: np.ndarray) -> np.ndarray:
    return np.stack([np.concatenate([[0], stops[:-1]]), stops], axis=1).astype(np.int64)


def _joined(ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sentences joined up to BLOCK words or more within each stretch between borders."""
    out, start = [], 0
    border = set(borders.tolist())
    first = 0  # of the blocks of this stretch
    for end in ends.tolist():
        if end in border:
            if end - start < BLOCK and len(out) > first:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
            start, first = end, len(out)
        elif end - start >= BLOCK:
            out.append((start, end))
            start = end
    return np.array(out, np.int64).reshape(-1, 2)


class Paragraphs:
    """Paragraphs of some texts: first and last word, text, place in the text; shingle sets of those long enough.

    Lines come with the other paragraphs of a text, in the order of their words; `line` marks them.
    """

    def __init__(self, texts: list[str], width: int, least: int = MIN_WORDS):
        self.words = found = Words(texts, NOT_ALNUM)
        a = np.frombuffer(found.raw, np.uint8)
        after = np.append(found.starts[1:], len(a)) if len(found.starts) else np.zeros(0, np.int64)
        line_ends = self._between(LINE_END, after)
        sentence_ends = self._between(STOP, after) & self._between(WHITE, after)
        line_ends[found.bounds[1:][np.diff(found.bounds) > 0] - 1] = True
        lines, others = self._blocks(line_ends, line_ends | sentence_ends, after)
        both = np.concatenate([lines, others])
        both, once = np.unique(both, axis=0, return_index=True)
        self.starts, self.stops, self.line = both[:, 0], both[:, 1], once < len(lines)
        self.owner = np.searchsorted(found.bounds, self.starts, "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.index = np.arange(len(self.starts)) - self.first[self.owner]
        self.sizes = self.stops - self.starts
        self.long = np.flatnonzero(self.sizes >= max(width, least))
        self.width = width

    def _between(self, chosen: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether one of the chosen bytes stands between each word and the next."""
        passed = np.concatenate([[0], np.cumsum(chosen[np.frombuffer(self.words.raw, np.uint8)])])
        return passed[after] > passed[self.words.ends]

    def _blocks(self, line_ends: np.ndarray, sentence_ends: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of lines; and of blocks of lines up to a blank one and of sentences joined to BLOCK words or
        more within a line, what is left at its end going to the last of these."""
        a = np.frombuffer(self.words.raw, np.uint8)
        stops = np.flatnonzero(line_ends) + 1
        if not len(stops):
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        # a blank line: two line ends with nothing but white space between the words around them
        passed = np.concatenate([[0], np.cumsum(LINE_END[a])])
        blank = passed[after[stops - 1]] - passed[self.words.ends[stops - 1]] >= 2
        texts = np.isin(stops, self.words.bounds)
        joined = _joined(np.flatnonzero(sentence_ends) + 1, stops)
        blocks = _stretches(stops[blank | texts])
        # a text without blank lines has its lines for paragraphs
        whole = np.isin(blocks[:, 0], self.words.bounds) & np.isin(blocks[:, 1], self.words.bounds)
        return _stretches(stops), np.concatenate([blocks[~whole], joined])

    @cached_property
    def _shingles(self) -> tuple[np.ndarray, np.ndarray]:
        values, of = shingle_sets(self.words, self.width, self.starts[self.long], self.stops[self.long])
        return values, np.searchsorted(of, np.arange(len(self.long) + 1))

    @property
    def values(self) -> np.ndarray:
        return self._shingles[0]

    @property
    def offsets(self) -> np.ndarray:
        return self._shingles[1]

    def bytes_of(self, text: int) -> tuple[np.ndarray, int]:
        """Where the words of a text start in it, and its length, in bytes."""
        own = slice(self.words.bounds[text], self.words.bounds[text + 1])
        begin = self.words.text_starts[text]
        return self.words.starts[own] - begin, int(self.words.text_starts[text + 1] - 1 - begin)

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Hashes of the bands of each set's MinHash signature, one row a band."""
        out = np.zeros((bands, len(self.long)), np.uint64)
        for band in range(bands):
            for row in range(rows):
                # members are mixed hashes; times an odd number they are in another order
                seed = np.uint64(((band * rows + row + 1) * 0x9E3779B97F4A7C15 | 1) & (2 ** 64 - 1))
                if len(self.long):
                    least = np.minimum.reduceat(self.values * seed, self.offsets[:-1])
                    out[band] = mixed(out[band] * np.uint64(31) ^ least ^ seed)
        return out


def _listed(width: int, least: int, bands: int, rows: int):
    """Paragraphs to compare: document, number in it, hash of the set, its size, fingerprint and bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = Paragraphs(texts[a:b], width, least)
                node, _ = set_hashes(found.values, found.offsets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(found.owner[found.long])),
                    pa.array(found.index[found.long].astype(np.int32)), pa.array(node),
                    pa.array(np.diff(found.offsets).astype(np.int32)),
                    *[pa.array(x) for x in fingerprints(found.values, found.offsets)],
                    *[pa.array(keys.view(np.int64)) for keys in found.bands(bands, rows)]],
                    ["doc", "index", "node", "n", *PRINTS, *[f"k{i}" for i in range(bands)]])
    return run


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, bits from the words of a fingerprint, which are a bitmap of 256 bits (see `similarity.bitmap`)."""
    for batch in batches:
        words = np.stack([batch.column(2 + k).to_numpy() for k in range(len(PRINTS))], axis=1).astype("<i8")
        bits = pa.Array.from_buffers(pa.binary(8 * len(PRINTS)), len(words), [None, pa.py_buffer(words.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits.cast(pa.binary())], ["node", "n", "bits"])


def _sets(width: int, least: int, outline: bool):
    """Of the wanted nodes of each text: node, n, bits; or node, shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = Paragraphs(texts[a:b], width, least)
                node, _ = set_hashes(found.values, found.offsets)
                own = [set(w) for w in wanted[a:b]]
                rows: dict[int, np.ndarray] = {}
                for i, (text, number) in enumerate(zip(found.owner[found.long].tolist(), node.tolist(), strict=True)):
                    if number in own[text]:
                        rows[number] = found.values[found.offsets[i]: found.offsets[i + 1]]
                nodes = pa.array(list(rows), pa.int64())
                if outline:
                    yield pa.RecordBatch.from_arrays([
                        nodes, pa.array([len(v) for v in rows.values()], pa.int64()),
                        pa.array([bitmap(v) for v in rows.values()], pa.binary())], ["node", "n", "bits"])
                else:
                    yield pa.RecordBatch.from_arrays([
                        nodes, pa.array([v.tobytes() for v in rows.values()], pa.binary())], ["node", "shingles"])
    return run


CUT = ("n_paragraphs long, n_removed_paragraphs long, n_bytes long, n_removed long, "
       "spans array<struct<start:long,stop:long>>, kept string")


def _lines(text: bytes) -> int:
    """Lines with a word."""
    return sum(map(bool, text.translate(None, GAPS).split(b"\n")))


def _cut(width: int, min_words: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marked, places = (batch.column(carried + k).to_pylist() for k in range(3))
            rows: list = [None] * len(texts)
            touched = [i for i in range(len(texts)) if marked[i] or places[i]]
            for i in set(range(len(texts))).difference(touched):  # texts of which nothing goes
                whole = texts[i].encode()
                rows[i] = _lines(whole), 0, len(whole), 0, [], texts[i]
            for a, b in slices([texts[i] for i in touched]):
                chosen_texts = touched[a:b]
                found = Paragraphs([texts[i] for i in chosen_texts], width, min_words)
                grams = Grams(found.words)
                covered = np.zeros(len(found.words.hashes), bool)
                for i, row in enumerate(chosen_texts):
                    starts, size = found.bytes_of(i)
                    low, high = int(found.words.bounds[i]), int(found.words.bounds[i + 1])
                    own = slice(found.first[i], found.first[i + 1])
                    chosen = np.array(marked[row] or [], np.int64)
                    chosen = found.first[i] + chosen[chosen < own.stop - own.start]
                    for x, y in zip(found.starts[chosen].tolist(), found.stops[chosen].tolist(), strict=True):
                        covered[x:y] = True
                    mark(covered, grams, low, high, places[row] or [])
                    turns = np.flatnonzero(np.diff(covered[low:high], prepend=False, append=False)).reshape(-1, 2)
                    turns = turns[turns[:, 1] - turns[:, 0] >= min_words]
                    ends = np.append(starts, size)
                    spans = [(int(starts[x]), int(ends[y])) for x, y in turns]
                    gone = np.zeros(high - low + 1, np.int64)
                    for x, y in turns:
                        gone[x + 1: y + 1] = 1
                    gone = np.cumsum(gone)
                    removed = gone[found.stops[own] - low] - gone[found.starts[own] - low] == found.sizes[own]
                    whole = texts[row].encode()
                    kept, at = [], 0
                    for x, y in spans:
                        kept.append(whole[at:x])
                        at = y
                    kept.append(whole[at:])
                    rows[row] = (
                        int(found.line[own].sum()), int((removed & found.line[own]).sum()), size, sum(y - x for x, y in spans),
                        [{"start": x, "stop": y} for x, y in spans], b"".join(kept).decode())
            out = list(zip(*rows, strict=True)) or [()] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = [pa.int64()] * 4 + [span, pa.string()]
            names = ["n_paragraphs", "n_removed_paragraphs", "n_bytes", "n_removed", "spans", "kept"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(carried)] + [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                [batch.schema.names[k] for k in range(carried)] + names)
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body")).filter(
        "doc is not null and body is not null")


def repeated_paragraphs(docs: DataFrame, width: int = WIDTH, threshold: Threshold = JACCARD, recall: float = RECALL,
                        max_bands: int = MAX_BANDS, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, indexes): paragraphs, by number in their document, similar to one of a document with a smaller id."""
    rows = _rows(docs, id_col, text_col)
    bands, per_band = tuned_bands(threshold.part / threshold.whole, recall, max_bands)
    keys = [f"k{i}" for i in range(bands)]
    listed = Stage(rows.mapInArrow(_listed(width, min_words, bands, per_band), "doc long, index int, node long, n int, "
                                   + ", ".join(f"{k} long" for k in (*PRINTS, *keys))), "paragraphs")
    # equal sets are one node, held by the first document that has it
    nodes = Stage(listed.read().groupBy("node").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in (
        "n", *PRINTS, *keys)]), "nodes")
    large = nodes.read().filter(F.col("n") >= threshold.least_size())  # smaller sets are similar to equal ones only
    posted = large.select(F.explode(F.array(*keys)).alias("token"), F.col("node").alias("gid"), "n", *PRINTS)
    shared = Stage(shared_tokens(posted), "shared")
    needed = shared.read().select(F.col("gid").alias("node")).distinct()
    holders = Stage(nodes.read().select("node", "doc", "n", *PRINTS).join(needed, "node"), "holders")
    nodes.drop()

    def sets(nodes: DataFrame, outline: bool, schema: str) -> DataFrame:
        wanted = nodes.groupBy("doc").agg(F.collect_list("node").alias("wanted"))
        return rows.join(wanted, "doc").select("body", "wanted").mapInArrow(_sets(width, min_words, outline), schema)

    # the sets themselves are made again from the texts when asked for; kept, they would be larger than the texts
    kinds = "node long, n long, bits binary"
    printed = holders.read().filter(F.col("n") <= PRINTED).select("node", F.col("n").cast("long"), *PRINTS).mapInArrow(_printed, kinds)
    wide = sets(holders.read().filter(F.col("n") > PRINTED), True, kinds).dropDuplicates(["node"])
    outlines = Stage(printed.unionByName(wide), "outlines")
    known = Sets(outlines.read(), lambda nodes: sets(
        holders.read().join(nodes, "node"), False, "node long, shingles binary").dropDuplicates(["node"]))
    none = shared.read().filter("false").select(F.col("gid").alias("node"), "gid")
    found = linked_components(none, shared.read(), known, threshold, positions=False, hubs=HUBS,
                              at_once=PAIRS_AT_ONCE)
    labelled = listed.read().select("doc", "index", "node").join(found, "node", "left").select(
        "doc", "index", F.coalesce("component", "node").alias("label"))
    first = labelled.groupBy("label").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    later = labelled.join(first.select("label", "first"), "label").filter("first < doc")
    repeated = Stage(later.groupBy("doc").agg(F.collect_list("index").alias("indexes")), "repeated")
    for done in (listed, shared, holders, outlines):
        done.drop()
    return repeated.read()


def remove_paragraphs(docs: DataFrame, width: int = WIDTH, threshold: Threshold = JACCARD, min_words: int = MIN_WORDS,
                      recall: float = RECALL, max_bands: int = MAX_BANDS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Cut runs of `min_words` words or more of paragraphs and passages that a document with a smaller id has as well.

    A passage of 50 words or more that is repeated word by word is found wherever it stands in sentences and widened
    to all words in common with its first holder (see `passages`); the length rule holds for the widened stretch.

    Returns the columns of `docs` (but for those of the names below) with n_paragraphs (lines with a word),
    n_removed_paragraphs (those that go whole), n_bytes, n_removed (bytes), spans (removed runs in bytes) and kept (the remaining text). Every row comes out once.
    A null text counts as empty; rows without an id stay whole and are no source; rows of equal ids are no source for
    each other. Paragraphs of fewer words than `min_words` are not compared. Sets are named by 64-bit hashes.
    """
    marked = repeated_paragraphs(docs, width, threshold, recall, max_bands, id_col, text_col, min_words)
    passages = repeated_passages(_rows(docs, id_col, text_col))
    added = [part.split()[0] for part in CUT.split(", ")]
    kept = [c for c in docs.columns if c not in added]
    found = marked.join(passages, "doc", "full").select("doc", F.struct("indexes", "places").alias("found"))
    # the row as one struct: none of its names can meet one of those joined to it
    row = docs.select(F.struct(*docs.columns).alias("row"))
    joined = row.join(found, F.col(f"row.{id_col}").cast("long") == F.col("doc"), "left").select(
        *[F.col(f"row.`{c}`") for c in kept], F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")),
        "found.indexes", "found.places")
    names = [*kept, *[f"_{k}_" for k in range(3)]]
    added = docs.sparkSession.createDataFrame([], CUT).schema
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *added.fields])
    return joined.toDF(*names).mapInArrow(_cut(width, min_words, len(kept)), schema)
