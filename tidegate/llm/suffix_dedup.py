"""Removal of repeated byte strings: what also starts in a document with a smaller id goes, the first copy stays.

A string of SPAN bytes that two documents share has the same smallest K-byte gram (by hash) at the same place in it,
so only suffixes near such anchors are compared; there are about 2 / (SPAN - K + 2) anchors a byte, and the strings
around an anchor lie in a context of 2 * SPAN - K bytes.

1. Anchors meet by the hashes of their gram and context. A context that an earlier document has too is repeated whole.
2. The first holders of contexts whose gram occurs in other contexts as well may share a part of them. Their contexts
   form a text whose sampled suffixes are put in order. Previous and next smaller document numbers in suffix order,
   with the smallest common prefix on the way, give the longest previous factor of each suffix; SPAN bytes or more
   mark a repeated string.
3. Marked stretches are united for each document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.staging import Stage
from tidegate.llm.words import BASE, mixed, powers

SPAN = 50
GRAM = 24
BLOCK_BYTES = 4_000_000
#: Text bytes whose anchors, and contexts of one gram, that meet in one task.
TASK_BYTES = 16_000_000
TASK_CONTEXTS = 100_000
#: Grams of more anchors than FREQUENT_ROWS, found on one document in SAMPLED, are dealt by context; at most FREQUENT.
SAMPLED = 32
FREQUENT_ROWS = 32_000
FREQUENT = 1_000

_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = powers(BASE, n), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)
    return _POWERS


def sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of `width` values."""
    n = 1
    while n * 2 <= width:
        values = take(values[:-n], values[n:])
        n *= 2
    return values if n == width else take(values[: len(values) - (width - n)], values[width - n:])


def anchors(texts: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, place, hash of the gram, hash of the context) of all anchors."""
    sizes = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(a) < span:
        return none, none, none, none
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    power, inverse = _power(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a + np.uint64(1)) * power[: len(a)])])
    n = len(a) - gram + 1
    key = mixed((sums[gram:] - sums[:-gram]) * inverse[:n])
    highest = np.uint64(2 ** 64 - 1)
    key = np.where(owner[:n] == owner[gram - 1:], np.minimum(key, highest - np.uint64(1)), highest)
    width = span - gram + 1
    least = sliding(key, width, np.minimum)
    least = np.where(owner[: len(least)] == owner[span - 1:], least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero((sliding(np.concatenate([edge, least, edge]), width, np.maximum) == key) & (key < highest))
    of = owner[chosen]
    low = np.maximum(chosen - (span - gram), first[of])
    high = np.minimum(chosen + span, first[of] + sizes[of])
    context = mixed((sums[high] - sums[low]) * inverse[low] ^ mixed(
        ((chosen - low) * (4 * span) + (high - low)).astype(np.uint64)))
    return of, chosen - first[of], key[chosen].view(np.int64), context.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of consecutive rows with an id, about BLOCK_BYTES together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not text:
                continue
            ids.append(i)
            texts.append(text)
            held += len(text)
            if held >= BLOCK_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _block_anchors(ids: np.ndarray, texts: list[bytes], span: int, gram: int):
    """Anchors sorted by (gram, context, id), and whether the block's first holder of the context has this id."""
    of, pos, h, c = anchors(texts, span, gram)
    doc = ids[of] if len(of) else of
    order = np.lexsort((doc, c, h))
    doc, pos, h, c = doc[order], pos[order], h[order], c[order]
    return doc, pos, h, c, doc == _leaders(doc, _new(h, c))


def _new(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _leaders(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the value of the first row of its run."""
    starts = np.flatnonzero(new)
    return np.repeat(values[starts], np.diff(np.append(starts, len(values)))) if len(values) else values


ANCHOR = "h long, c long, doc long, pos int, stop int"
MARK = "doc long, pos int, h long, stop int"
STRETCH = "doc long, start int, stop int"
#: In `stop`: the row is an anchor, not a stretch from `pos` to `stop`.
OPEN = -1


def _sent(span: int, gram: int):
    """Of equal contexts of a block the anchors of its first document, and the stretches of all others, which go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            doc, pos, h, c, lead = _block_anchors(ids, texts, span, gram)
            yield _rows(ANCHOR, h[lead], c[lead], doc[lead], pos[lead], np.full(int(lead.sum()), OPEN))
            doc, start, stop = united(doc[~lead], pos[~lead] - (span - gram), pos[~lead] + span)
            # dealt evenly: these meet nothing
            yield _rows(ANCHOR, mixed(doc.astype(np.uint64) * BASE + start.astype(np.uint64)).view(np.int64),
                        np.zeros(len(doc), np.int64), doc, start, stop)
    return run


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(kinds[t])) for x, t in zip(columns, types, strict=True)], list(names))


def united(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each document with those that meet joined, in order."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], np.maximum(start[order], 0), stop[order]
    if not len(doc):
        return doc, start, stop
    shift = int(stop.max()) + 2
    number = np.cumsum(_new(doc)) - 1
    reach = np.maximum.accumulate(stop + number * shift) - number * shift
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(begins)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _stretches(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    doc, start, stop = united(doc, start, stop)
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)),
                                       pa.array(stop.astype(np.int32))], ["doc", "start", "stop"])


def _meet(span: int, gram: int, frequent: list[int]):
    """All anchors of some grams: repeated contexts, and first holders of contexts that may share a part.

    Anchors of a frequent gram meet by context; such a gram is taken to have several contexts.
    """
    often = np.array(frequent, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        h, c, doc, pos, stop = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5))
        held.clear()
        known = stop != OPEN
        yield _rows(MARK, doc[known], pos[known], np.zeros(int(known.sum()), np.int64), stop[known])
        h, c, doc, pos = h[~known], c[~known], doc[~known], pos[~known]
        if not len(h):
            return
        order = np.lexsort((doc, c, h))
        h, c, doc, pos = h[order], c[order], doc[order], pos[order]
        first = _leaders(doc, _new(h, c))
        starts = np.flatnonzero(_new(h))
        low, high = np.minimum.reduceat(first, starts), np.maximum.reduceat(first, starts)
        differ = np.repeat((low < high) | np.isin(h[starts], often), np.diff(np.append(starts, len(h))))
        whole = doc > first
        yield _rows(MARK, doc[whole], pos[whole] - (span - gram), np.zeros(int(whole.sum()), np.int64),
                    pos[whole] + span)
        part = differ & ~whole
        yield _rows(MARK, doc[part], pos[part], h[part], np.full(int(part.sum()), OPEN))
    return run


def _frequent(rows: DataFrame, span: int, gram: int) -> list[int]:
    """The grams with the most anchors by a sample of the documents; it decides where anchors meet, not the result.

    At most FREQUENT grams, so any other one has hardly more than one anchor in as many.
    """
    some = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).mapInArrow(_sent(span, gram), ANCHOR)
    counts = some.filter(F.col("stop") == OPEN).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    most = counts.filter(F.col("n") > FREQUENT_ROWS // SAMPLED).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return [row.h for row in most.collect()]


def _contexts(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for p in places:
                    low = max(0, p["pos"] - (span - gram))
                    for column, value in zip(out, (p["h"], doc, p["pos"], p["pos"] - low,
                                                   text[low: p["pos"] + span]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["h", "doc", "pos", "before", "context"])
    return run


def repeated_suffixes(contexts: list[bytes], docs: np.ndarray, lasts: np.ndarray, span: int):
    """Suffixes of the contexts (number, start up to `lasts`) whose longest previous factor is `span` or more.

    The text is the contexts one after the other; suffixes are ordered by their first `span` bytes, those of fewer
    bytes left out. A previous factor must be of a smaller document.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts) + bytes(span), np.uint8)
    each = np.maximum(0, np.minimum(lasts + 1, sizes - span + 1))
    number = np.repeat(np.arange(len(contexts)), each)
    start = np.arange(len(number)) - np.repeat(np.cumsum(each) - each, each)
    at = (np.cumsum(sizes) - sizes)[number] + start
    if not len(at):
        return number, start
    rows = np.lib.stride_tricks.sliding_window_view(text, span)[at]
    pad = -span % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")
    order = np.lexsort(words.T[::-1])
    words, doc = words[order], docs[number[order]]
    # common prefix of neighbours, as far as it matters: all of the span or less
    same = np.zeros(len(order), bool)
    same[1:] = (words[1:] == words[:-1]).all(1)
    found = _smaller(doc, same) | _smaller(doc[::-1], np.append(False, same[1:][::-1]))[::-1]
    hit = order[found]
    return number[hit], start[hit]


def _smaller(doc: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether the nearest smaller number before each place is reached without leaving equal prefixes.

    All places move at once, each over what its present place has passed already.
    """
    at = np.arange(len(doc)) - 1
    joined = same.copy()
    active = np.flatnonzero(joined & (doc[np.maximum(at, 0)] >= doc))
    while len(active):
        via = at[active]
        joined[active] &= joined[via]
        at[active] = at[via]
        active = active[joined[active] & (doc[np.maximum(at[active], 0)] >= doc[active])]
    return joined


def _compare(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # contexts come sorted by gram; a piece holds whole grams
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TASK_CONTEXTS // 2:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield _compared(table.slice(0, cut), span)
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield _compared(pa.Table.from_batches(held), span)
    return run


def _compared(table: pa.Table, span: int) -> pa.RecordBatch:
    doc, pos, before = (table.column(k).to_numpy().astype(np.int64) for k in ("doc", "pos", "before"))
    number, start = repeated_suffixes(table.column("context").to_pylist(), doc, before, span)
    begin = pos[number] - before[number] + start
    return _stretches(doc[number], begin, begin + span)


def _crowded(contexts: DataFrame, span: int) -> DataFrame:
    """The same for grams with very many contexts, by smallest document of each string; no task sees a whole gram."""
    last = F.least("before", F.octet_length("context") - span)
    strings = contexts.filter(last >= 0).select(
        "doc", "pos", "before", F.explode(F.sequence(F.lit(0), last)).alias("k"), "context").select(
        "doc", (F.col("pos") - F.col("before") + F.col("k")).alias("start"),
        F.substring("context", F.col("k") + 1, F.lit(span)).alias("string"))
    first = strings.groupBy("string").agg(F.min("doc").alias("first"))
    return strings.join(first, "string").filter("first < doc").select(
        "doc", "start", (F.col("start") + span).alias("stop"))


CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        texts = batch.column(1).to_pylist()
        for text, found in zip(texts, batch.column(2).to_pylist(), strict=True):
            own, out, at = [], [], 0
            if found:
                start, stop = (np.array([s[k] for s in found], np.int64) for k in ("start", "stop"))
                _, start, stop = united(np.zeros(len(start), np.int64), start, np.minimum(stop, len(text)))
                own = [(int(a), int(b)) for a, b in zip(start, stop, strict=True) if b > a]
            for a, b in own:
                out.append(text[at:a])
                at = b
            out.append(text[at:])
            spans.append([{"start": a, "stop": b} for a, b in own])
            removed.append(sum(b - a for a, b in own))
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Cut every byte that lies in a string of `span` bytes which also starts in a document with a smaller id.

    Returns a row per input row: doc_id, n_bytes, n_removed, spans (maximal removed runs, start and stop in bytes),
    kept (the remaining bytes). Strings are judged on the input; rows of equal ids are no source for each other. A
    null text counts as empty. Rows without an id stay whole and are no source. Strings are first compared by 64-bit
    hashes of grams and contexts, parts of contexts by their bytes.
    """
    body = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), body.alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    frequent = _frequent(rows, span, gram)
    key = F.when(F.col("h").isin(frequent), F.xxhash64("h", "c")).otherwise(F.col("h")) if frequent else F.col("h")
    met = rows.mapInArrow(_sent(span, gram), ANCHOR).repartition(tasks, key).mapInArrow(_meet(span, gram, frequent), MARK)
    marked = Stage(met, "marks")
    marks = marked.read()
    places = marks.filter(F.col("stop") == OPEN).groupBy("doc").agg(
        F.collect_list(F.struct("pos", "h")).alias("places"))
    held = Stage(
        rows.join(places, "doc").select("doc", "body", "places").mapInArrow(
            _contexts(span, gram), "h long, doc long, pos int, before int, context binary"), "contexts")
    contexts = held.read()
    crowded = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_CONTEXTS).select("h")
    crowds = Stage(crowded, "crowded")
    crowded = crowds.read()
    groups = max(1, -(-contexts.count() // TASK_CONTEXTS))
    compared = contexts.join(crowded, "h", "left_anti").repartition(groups, "h").sortWithinPartitions("h").mapInArrow(
        _compare(span), STRETCH)
    found = compared.unionByName(marks.filter(F.col("stop") != OPEN).select("doc", F.col("pos").alias("start"), "stop"))
    if not crowded.isEmpty():
        found = found.unionByName(_crowded(contexts.join(crowded, "h", "left_semi"), span))
    by_doc = Stage(found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found")), "repeats").read()
    for stage in (marked, held, crowds):
        stage.drop()
    return rows.join(by_doc, "doc", "left").select("doc", "body", "found").mapInArrow(_cut, CUT)
