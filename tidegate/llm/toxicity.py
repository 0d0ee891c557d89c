"""Toxic spans by a linear-chain conditional random field over the words of a text.

Two labels, clean and toxic. A word's evidence for toxic is a sum of weights of hashed features (the word, its first
bytes); neighbours are tied by transition weights. Both are fitted by maximum likelihood on labelled words of a
bounded sample of labelled documents; the words' labels come from the documents': a word of a toxic document is toxic
if a feature of it occurs almost only in toxic documents. Forward-backward gives each word's marginal probability; a
logistic curve over the densest stretch, the largest marginal and the rate of offending words gives the document's score.
None of these grows with the length of a clean text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.words import NOT_ALNUM, Words, mixed, slices

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
#: Labelled documents of each class that a fit takes, by a hash of their ids; whole texts.
SAMPLE_DOCS = {1: 1500, 0: 3000}
CHUNK = 64
STEPS = 40
#: A feature marks toxic words if its share of clean documents is so many times smaller than that of toxic ones, and if
#: so few features would be in as many documents, all of them toxic, by chance.
MARK_CLEAN, MARK_CHANCE = 0.02, 1e-5
#: Words of a stretch, and how many numbers the curve sees of a text.
STRETCH = 32
SUMMARY = 4
THRESHOLD = 0.7
LIMIT = 15.0


def features(found: Words) -> np.ndarray:
    """Buckets of each word's features, one row a feature: the word and its first 4, 5 and 6 bytes."""
    rows = [found.hashes]
    for n in PREFIXES:
        rows.append(mixed(found.hashed(found.starts, np.minimum(found.ends, found.starts + n)) + np.uint64(n)))
    return (np.stack(rows) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    """Weights of features, log transition weights [from][to], log start weights, curve over document sums."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    curve: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, transition=self.transition, start=self.start, curve=self.curve)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as parts:
            return cls(*(parts[k] for k in ("weights", "transition", "start", "curve")))

    def evidence(self, found: Words) -> np.ndarray:
        return np.clip(self.weights[features(found)].sum(0), -LIMIT, LIMIT)

    def marginals(self, found: Words) -> np.ndarray:
        """Probability of toxic for each word, by forward-backward over each text."""
        n = len(found.hashes)
        if not n:
            return np.zeros(0)
        e = np.exp(self.evidence(found))
        t, s = np.exp(self.transition), np.exp(self.start[1] - self.start[0])
        bounds = np.unique(found.bounds)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[bounds[:-1]] = True
        last[bounds[1:] - 1] = True
        forward = ratio_scan(e, first, t[0, 1], t[1, 1], t[0, 0], t[1, 0], s)
        backward = ratio_scan(e[::-1], last[::-1], t[1, 0], t[1, 1], t[0, 0], t[0, 1], 1.0)[::-1]
        odds = forward * backward / e
        return odds / (1 + odds)

    def summaries(self, found: Words, marginals: np.ndarray) -> np.ndarray:
        """What the curve sees of each text: constant, squared marginals of the densest STRETCH words, the largest
        marginal, squared marginals of a hundred words. Squares, as all clean words together must count for little."""
        n = np.diff(found.bounds)
        sums = np.concatenate([[0.0], np.cumsum(marginals ** 2)])
        total = sums[found.bounds[1:]] - sums[found.bounds[:-1]]
        most, dense = np.zeros(len(n)), np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            at = np.arange(len(marginals))
            stop = np.minimum(at + STRETCH, np.repeat(found.bounds[1:], n))
            most[some] = np.maximum.reduceat(marginals, found.bounds[:-1][some])
            dense[some] = np.maximum.reduceat(sums[stop] - sums[at], found.bounds[:-1][some])
        return np.stack([np.ones(len(n)), np.log1p(np.maximum(dense, 0)), most, np.log1p(100 * total / np.maximum(n, 1))], 1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, Words, np.ndarray]:
        """Scores of texts, with their words and the words' marginals."""
        found = Words(texts, NOT_ALNUM)
        marginals = self.marginals(found)
        x = self.summaries(found, marginals) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), found, marginals


def ratio_scan(e: np.ndarray, reset: np.ndarray, a: float, b: float, c: float, d: float, s: float) -> np.ndarray:
    """y[t] = e[t] (a + b y[t-1]) / (c + d y[t-1]), and e[t] s where `reset`; the odds of a two-label chain.

    The steps are maps of the form (top / bottom) of a 2 x 2 matrix. The sequence is cut into lanes that advance
    together: once to compose each lane's map, once with the right start of each lane.
    """
    n = len(e)
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    e = np.concatenate([e, np.ones(pad)]).reshape(lanes, steps).T.copy()
    reset = np.concatenate([reset, np.ones(pad, bool)]).reshape(lanes, steps).T.copy()
    top, bottom = np.array([[1.0], [0.0]]).repeat(lanes, 1), np.array([[0.0], [1.0]]).repeat(lanes, 1)
    constant = np.array([[0.0], [1.0]])
    for t in range(steps):
        top, bottom = np.where(reset[t], constant * s, b * top + a * bottom) * e[t], np.where(
            reset[t], constant, d * top + c * bottom)
        if t % 8 == 7:
            scale = np.maximum(top.max(0), bottom.max(0))
            top, bottom = top / scale, bottom / scale
    y = np.zeros(lanes)
    for k in range(lanes - 1):
        y[k + 1] = (top[0, k] * y[k] + top[1, k]) / (bottom[0, k] * y[k] + bottom[1, k])
    out = np.empty((steps, lanes))
    for t in range(steps):
        y = e[t] * np.where(reset[t], s, (a + b * y) / (c + d * y))
        out[t] = y
    return out.T.reshape(-1)[:n]


def copy_groups(found: Words) -> np.ndarray:
    """A number for each text that copies and near copies mostly share: of its smallest hash of five words."""
    h = np.pad(found.hashes, (0, 4))
    n = len(found.hashes)
    windows = mixed(sum((h[k: n + k] * np.uint64(2 * k + 3) for k in range(5)), np.zeros(n, np.uint64)))
    owner = found.owner()
    windows[: max(0, n - 4)][owner[: max(0, n - 4)] != owner[4:]] = np.uint64(2 ** 64 - 1)
    windows[max(0, n - 4):] = np.uint64(2 ** 64 - 1)
    least = np.zeros(len(found.bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(found.bounds))
    if len(some):
        least[some] = np.minimum.reduceat(windows, found.bounds[:-1][some])
    return np.unique(least, return_inverse=True)[1]


def word_labels(found: Words, feats: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the sample's words from the labels of its documents; copies of a document count once."""
    owner, group = found.owner(), copy_groups(found)
    marked = np.zeros(len(owner), bool)
    n_groups = int(group.max()) + 1 if len(group) else 1
    of_class = [max(1, len(np.unique(group[toxic == y]))) for y in (0, 1)]
    least = np.log(MARK_CHANCE) / np.log(of_class[1] / sum(of_class))
    for row in feats:
        seen = []
        for y in (0, 1):
            here = toxic[owner] == y
            pairs = np.unique(row[here].astype(np.int64) * n_groups + group[owner[here]])
            seen.append(np.bincount(pairs // n_groups, minlength=BUCKETS))
        good, bad = seen
        marks = (bad >= least) & (good / of_class[0] <= MARK_CLEAN * bad / of_class[1])
        marked |= marks[row]
    return (marked & (toxic[owner] == 1)).astype(np.int64)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Maximum likelihood by full-batch ascent with step sizes per weight; then the curve by Newton's method.

    Every third text of each class is left to the curve, which so sees marginals of words that the chain has not seen.
    """
    turn = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        turn[toxic == y] = np.arange(int((toxic == y).sum()))
    aside = np.flatnonzero(turn % 3 == 2)
    learnt = np.flatnonzero(turn % 3 != 2)
    found = Words([texts[i] for i in learnt], NOT_ALNUM)
    feats = features(found)
    labels = word_labels(found, feats, toxic[learnt])
    model = Model(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.zeros(SUMMARY))
    if not labels.any():
        model.weights[:] = -1.0
    else:
        _fit_chain(model, found, feats, labels)
    held = [texts[i] for i in aside]
    x = np.concatenate([np.zeros((0, SUMMARY)), *(model.summaries(w, model.marginals(w)) for w in (
        Words(held[a:b], NOT_ALNUM) for a, b in slices(held)))])
    # rows without words are clean; they hold the curve down at zero
    x = np.concatenate([x, np.eye(SUMMARY)[[0]].repeat(20, 0)])
    y = np.concatenate([toxic[aside], np.zeros(20)]).astype(float)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(SUMMARY)
        model.curve += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * model.curve)
    return model


def _fit_chain(model: Model, found: Words, feats: np.ndarray, labels: np.ndarray) -> None:
    # sequences of at most CHUNK words, ends filled up with words that count for nothing
    starts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)])
    ends = np.minimum(starts + CHUNK, found.bounds[np.searchsorted(found.bounds, starts, "right")])
    places = starts[:, None] + np.arange(CHUNK)
    there = places < ends[:, None]
    places = np.where(there, places, 0)
    gold = np.where(there, labels[places], 0)
    used = np.unique(feats)
    seen, gold_seen = (np.zeros(BUCKETS), np.zeros(BUCKETS))
    for row in feats:
        gold_seen += np.bincount(row, labels, BUCKETS)
        seen += np.bincount(row, minlength=BUCKETS)
    pairs = there[:, 1:]
    gold_pairs = np.array([[(pairs & (gold[:, :-1] == i) & (gold[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    gold_start = np.bincount(gold[:, 0], minlength=2)
    squares = {"w": np.full(BUCKETS, 1e-8), "t": np.full((2, 2), 1e-8), "s": np.full(2, 1e-8)}
    n = len(starts)
    for _ in range(STEPS):
        e = np.clip(model.weights[feats].sum(0), -LIMIT, LIMIT)
        emit = np.stack([np.ones_like(e), np.exp(e)], -1)[places] * 1.0
        t, s = np.exp(model.transition), np.exp(model.start)
        alpha, beta = np.empty((CHUNK, n, 2)), np.ones((CHUNK, n, 2))
        alpha[0] = s * emit[:, 0]
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for k in range(1, CHUNK):
            alpha[k] = (alpha[k - 1] @ t) * emit[:, k]
            alpha[k] /= alpha[k].sum(1, keepdims=True)
        for k in range(CHUNK - 2, -1, -1):
            step = (beta[k + 1] * emit[:, k + 1]) @ t.T
            step /= step.sum(1, keepdims=True)
            beta[k] = np.where(there[:, k + 1, None], step, 0.5)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        p = np.zeros(len(labels))
        p[places[there]] = gamma[:, :, 1].T[there]
        xi = alpha[:-1, :, :, None] * t * (beta[1:] * emit.transpose(1, 0, 2)[1:])[:, :, None, :]
        xi /= xi.sum((2, 3), keepdims=True)
        grad_t = gold_pairs - np.einsum("knij,nk->ij", xi, pairs.astype(float))
        grad_s = gold_start - gamma[0].sum(0)
        grad_w = gold_seen.copy()
        for row in feats:
            grad_w -= np.bincount(row, p, BUCKETS)
        grad_w -= 0.1 * model.weights
        grad_t = grad_t - 0.1 * model.transition
        for key, target, grad in (("w", model.weights, grad_w), ("t", model.transition, grad_t),
                                  ("s", model.start, grad_s)):
            squares[key] += grad ** 2
            target += 0.5 * grad / np.sqrt(squares[key])
    unseen = np.ones(BUCKETS, bool)
    unseen[used] = False
    model.weights[unseen] = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: checksum of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents that are not held out, in one task.

    Of each class the `sample` documents with the smallest hashes of their ids are taken, with their whole texts. Rows
    without id or label are left out; of several labels of a document the largest counts. Without any toxic document
    in the sample, every score is near 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = None
    for toxic, n in (sample or SAMPLE_DOCS).items():
        part = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).dropna()
        .join(F.broadcast(chosen), "id")  # as many rows as the sample at most
        .groupBy("id", "toxic").agg(F.min("body").alias("body"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda r: r["id"])
        model = fit([r["body"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))
        yield pa.RecordBatch.from_pydict({"model": [model.to_bytes()]})

    found = texts.repartition(1).mapInArrow(run, "model binary").first()
    return Model.from_bytes(found["model"]) if found else fit([], np.zeros(0, np.int64))


def offending(found: Words, marginals: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Places of words with marginals of a half or more; of toxic texts without such, of those with the largest."""
    cut = np.full(len(toxic), 0.5)
    some = np.flatnonzero(np.diff(found.bounds))
    if len(some):
        most = np.maximum.reduceat(marginals, found.bounds[:-1][some])
        cut[some] = np.where(toxic[some], np.minimum(0.5, most), 0.5)
    return np.flatnonzero(marginals >= cut[found.owner()])


RESULT = "doc_id long, score double, predicted int, spans array<struct<start:long,stop:long,p:double>>"


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Score whole texts; a row per input row.

    Returns doc_id, score (0 to 1), predicted (1 from `threshold` on), spans (offending words, with marginals of at
    least one half, or the largest one of a toxic text where none has: start and stop in characters of the text). A
    null text is scored as an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                score, found, marginals = model.scores(texts[a:b])
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                text, at, before = -1, 0, 0
                for i in offending(found, marginals, score >= threshold).tolist():
                    k = int(np.searchsorted(found.bounds, i, "right")) - 1
                    if k != text:  # characters are counted on from the word before
                        text, at, before = k, found.text_starts[k], 0
                    before += len(found.raw[at: found.starts[i]].decode())
                    at = found.starts[i]
                    spans[k].append({"start": before, "stop": before + len(found.text(i)), "p": float(marginals[i])})
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "score": pa.array(score, pa.float64()),
                    "predicted": pa.array((score >= threshold).astype(np.int32)),
                    "spans": pa.array(spans, pa.list_(pa.struct([
                        ("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))),
                })

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, RESULT)


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, whole and with all their columns, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            keep = np.ones(len(texts), bool)
            for a, b in slices(texts):
                keep[a:b] = model.scores(texts[a:b])[0] < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
