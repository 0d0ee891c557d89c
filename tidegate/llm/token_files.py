"""Token shards: ids of documents in a row, with Elias-Fano coded document boundaries and ids.

A shard file is

    ids        token ids in a row, little-endian, 2 bytes each if the vocabulary allows it, else 4
    sections   the parts of two Elias-Fano lists: boundaries (documents + 1 values), document ids
    trailer    JSON that says where each part lies
    8 bytes    length of the trailer, then the 8 bytes of MAGIC

Boundaries count ids from the start of the shard; `start` of a shard in the manifest counts the ids before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegate.llm.staging import Stage
from tidegate.llm.tokens import default_tokenizer, encoder
from tidegate.llm.words import slices
from tidegate.session import scratch_path

MAGIC = b"TGTOKEN1"
SAMPLE = 256
READ_IDS = 1_000_000
MANIFEST = "shard long, path string, n_docs long, n_null long, n_tokens long"


class EliasFano:
    """A non-decreasing list of numbers from 0 in about 2 + log2(largest / n) bits each.

    The low bits of a value are packed; the high bits stand in a bit row where one number i sets bit
    (value >> low) + i. `samples` holds the place of every SAMPLE-th set bit in 4 bytes, so that `select` reads one
    stretch of the row, whatever the length of the list.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        row = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        row[places] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8), bitorder="little"),
                   np.packbits(row, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, stop: int) -> np.ndarray:
        if not self.low:
            return np.zeros(stop - first, np.uint64)
        a, b = first * self.low, stop * self.low
        bits = np.unpackbits(self.lows[a // 8: -(-b // 8)], bitorder="little")[a % 8: a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return bits.reshape(-1, self.low).astype(np.uint64) @ weights

    def range(self, first: int, stop: int) -> np.ndarray:
        """Values number first to stop - 1: from the sampled place before the first on."""
        stop = min(stop, self.n)
        if first >= stop:
            return np.zeros(0, np.int64)
        place = int(self.samples[first // SAMPLE])
        last = (stop - 1) // SAMPLE + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.highs) * 8
        bits = np.unpackbits(self.highs[place // 8: -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits) + place // 8 * 8
        ones = ones[ones >= place][first % SAMPLE: first % SAMPLE + stop - first]
        high = (ones - np.arange(first, stop)).astype(np.uint64)
        return ((high << np.uint64(self.low)) | self._lows(first, stop)).astype(np.int64)

    def select(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def parts(self) -> list[tuple[str, np.ndarray]]:
        return [("lows", self.lows), ("highs", self.highs), ("samples", self.samples)]


def _store(path: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[5:7] != "//" else path)


class ShardWriter:
    def __init__(self, folder: str, name: str, width: int):
        self.store, folder = _store(folder)
        self.store.create_dir(folder, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = self.store.open_output_stream(self.path)
        self.dtype = np.dtype(f"<u{width}")
        self.ends, self.keys, self.n_null, self.tokens, self.place = [np.zeros(1, np.int64)], [], 0, 0, 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents with their keys (nulls left out; they come first), ids in a row and where each ends."""
        self._write(ids.astype(self.dtype).tobytes())
        self.ends.append(ends + self.tokens)
        self.keys.append(keys)
        self.n_null += len(ends) - len(keys)
        self.tokens += len(ids)

    def close(self) -> tuple[int, int, int]:
        ends = np.concatenate(self.ends)
        keys = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        base = int(keys[0]) if len(keys) else 0
        head = {"width": self.dtype.itemsize, "base": base, "n_null": self.n_null, "lists": {}}
        for name, values in (("bounds", ends), ("keys", keys.astype(np.uint64) - np.uint64(base % (1 << 64)))):
            coded = EliasFano.of(values)
            head["lists"][name] = {"n": coded.n, "low": coded.low}
            for part, data in coded.parts():
                head["lists"][name][part] = [self.place, len(data)]
                self._write(data.tobytes())
        trailer = json.dumps(head).encode()
        self._write(trailer + len(trailer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return len(ends) - 1, self.n_null, self.tokens


class ShardReader:
    """Random access to a shard: only the lists are held in memory."""

    def __init__(self, path: str):
        store, inner = _store(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        end = self._read(size - 16, 16)
        if end[8:] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        length = int.from_bytes(end[:8], "little")
        head = json.loads(self._read(size - 16 - length, length))
        self.dtype = np.dtype(f"<u{head['width']}")
        self.base, self.n_null = head["base"], head["n_null"]
        self.bounds, self.keys = (self._list(head["lists"][k]) for k in ("bounds", "keys"))
        self.n_docs = self.bounds.n - 1

    def _read(self, place: int, length: int) -> bytes:
        return self.file.read_at(length, place)

    def _list(self, x: dict) -> EliasFano:
        def part(name: str, dtype) -> np.ndarray:
            place, n = x[name]
            return np.frombuffer(self._read(place, n * np.dtype(dtype).itemsize), dtype)

        return EliasFano(x["n"], x["low"], part("lows", np.uint8), part("highs", np.uint8), part("samples", np.uint32))

    def ids(self, first: int, stop: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self._read(first * width, (stop - first) * width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Token ids of document number i of the shard."""
        first, stop = self.bounds.range(i, i + 2)
        return self.ids(int(first), int(stop))

    def key(self, i: int) -> int | None:
        return None if i < self.n_null else self.keys.select(i - self.n_null) + self.base


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them as shard files in ascending order of their ids; return the manifest.

    One file per range of document ids, one row of the manifest per file: shard (ascending), path, n_docs, n_null
    (documents without id, which come first), n_tokens, start (ids in all shards before). Only files in the manifest
    count: a task that is run again writes under a new name. Texts with equal ids are ordered by text; a null text
    counts as empty. Rows without documents give an empty manifest. `folder` must be reachable from all executors
    (default: below spark.checkpoint.dir).
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    tokenizer = tokenizer or default_tokenizer()
    rows = (
        docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
        .withColumn("tie", F.xxhash64("body"))
        # equal rows are interchangeable: their place in the input spreads them over shards
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(F.col("key").asc_nulls_first(), "tie", "place")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "place")
        .select("key", "body")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if max(encode.vocabulary - 1, end_id) < 1 << 16 else 4
        context = TaskContext.get()
        shard, writer = context.partitionId(), None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                writer = writer or ShardWriter(folder, f"shard-{shard:06d}-{uuid.uuid4().hex}.tok", width)
                flat, offsets = encode.encode(texts[a:b])
                ends = offsets[1:] + np.arange(1, b - a + 1)
                ids = np.insert(flat, offsets[1:], end_id)
                writer.add(keys.slice(a, b - a).drop_null().to_numpy(), ids, ends)
        if writer:
            n_docs, n_null, n_tokens = writer.close()
            path = f"{folder}/{writer.path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs],
                                              "n_null": [n_null], "n_tokens": [n_tokens]})

    manifest = Stage(rows.mapInArrow(write, MANIFEST), "token-manifest").read()
    # one short row per file
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of a manifest's files: doc_id, start, n_tokens, ids (4 bytes each, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _documents(ShardReader(shard["path"]), shard["start"])

    spread = manifest.select("path", "start").repartition(F.col("path"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(file: ShardReader, start: int) -> Iterator[pa.RecordBatch]:
    i = 0
    while i < file.n_docs:
        bounds = file.bounds.range(i, i + 4097)
        n = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
        n = min(n, len(bounds) - 1)
        bounds = bounds[: n + 1]
        ids = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
        places = bounds - bounds[0]
        null = max(0, min(n, file.n_null - i))
        keys = file.keys.range(i + null - file.n_null, i + n - file.n_null) + file.base if n > null else []
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([None] * null + list(keys), pa.int64()),
            "start": pa.array(bounds[:-1] + start, pa.int64()),
            "n_tokens": pa.array(np.diff(bounds), pa.int64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary()),
        })
        i += n
