"""A stream source that follows growing log files.

`path` may be a glob. A file is known by its identity: where the file system has inode numbers by these, and by a
checksum of its first line. The offset holds, for each file, the byte behind the last whole line that was read. So a
renamed file goes on from where it was, a new file under the old name starts at its beginning, and a file that became
shorter than its offset, or whose first line changed, is read anew. A file that was cut and has grown past its offset
between two looks, with the same first line, cannot be told from one that only grew. Lines without their end wait.

The driver looks at names, sizes and the first and last lines of files; lines are read in tasks, in ranges of bytes.
"""

from __future__ import annotations

import glob as globbing
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_log"
SCHEMA = "value string, part int, source string, position long"
RANGE_BYTES = 64 << 20
BLOCK = 1 << 16
ROWS = 10_000
HEAD_BYTES = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, stop) of a file; `first`: a line begins at start."""

    path: str
    part: int
    source: str
    start: int
    stop: int
    first: bool


def identity(path: str) -> str | None:
    """None while the file has no whole line."""
    with open(path, "rb") as file:
        head = file.readline(HEAD_BYTES)
        number = os.fstat(file.fileno()).st_ino
    return f"{number}-{zlib.crc32(head)}" if head.endswith(b"\n") or len(head) == HEAD_BYTES else None


def whole_lines(path: str) -> int:
    """The byte behind the last line end."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - BLOCK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class FollowReader(DataSourceStreamReader):
    def __init__(self, path: str, from_end: bool):
        self.path, self.from_end = path, from_end

    def _files(self) -> list[tuple[str, str]]:
        """(path, identity) of all files that have a line, oldest first."""
        found = []
        for path in globbing.glob(self.path):
            try:
                if os.path.isfile(path) and (name := identity(path)) is not None:
                    found.append((os.stat(path).st_mtime_ns, path, name))
            except FileNotFoundError:  # moved since it was listed
                continue
        return [(path, name) for _, path, name in sorted(found)]

    def _ends(self) -> dict:
        ends = {}
        for path, name in self._files():
            try:
                ends[name] = whole_lines(path)
            except FileNotFoundError:
                continue
        return dict(sorted(ends.items()))

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges: list[InputPartition] = []
        for part, (path, name) in enumerate(self._files()):
            if name not in end:
                continue
            begin = start.get(name, 0)
            if begin > end[name]:  # cut short: all of it is new
                begin = 0
            for at in range(begin, end[name], RANGE_BYTES):
                ranges.append(Range(path, part, name, at, min(at + RANGE_BYTES, end[name]), at == begin))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as file:
            if partition.first:
                file.seek(partition.start)
            else:  # a line that began before belongs to the range before
                file.seek(partition.start - 1)
                file.readline()
            values, places, at = [], [], file.tell()
            while at < partition.stop and (line := file.readline()):
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at = file.tell()
                if len(values) == ROWS:
                    yield self._batch(partition, values, places)
                    values, places = [], []
            if values:
                yield self._batch(partition, values, places)

    @staticmethod
    def _batch(partition: Range, values: list[str], places: list[int]) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array([partition.part] * n, pa.int32()),
             pa.array([partition.source] * n, pa.string()), pa.array(places, pa.int64())],
            ["value", "part", "source", "position"])


class GrowingLog(DataSource):
    """Options: `path` (a file or glob that driver and executors all see), `from_end` (skip what is there at the start)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options["path"].removeprefix("file://"), self.options.get("from_end", "false") == "true")


def follow(spark: SparkSession, path: str, from_end: bool = False):
    """Stream of (value, part, source, position): lines, files in the order of their last change, first bytes of lines."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(FORMAT).option("from_end", str(from_end).lower()).load(path)
