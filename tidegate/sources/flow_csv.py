"""Raw flow CSV files: any number of files, headers with blanks and repeats, two encodings."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidegate.operators.cleaning import quoted
from tidegate.schemas import LABEL

BYTES_AS_TEXT = "ISO-8859-1"
GLOB = "*.[cC][sS][vV]"
FILES_PER_TASK = 64
#: Bytes read at once until the first line has ended.
HEAD_BYTES = 16_384


def discover(spark: SparkSession, raw_dir: str, glob: str = GLOB) -> DataFrame:
    """path and length of all matching files below a folder. File contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(raw_dir).select("path", "length")
    )


def _first_line(path: str) -> bytes | None:
    """Up to the first line break; None if this path's file system cannot be opened from Python."""
    try:
        if urlparse(path).scheme in ("", "file"):
            system, place = fs.LocalFileSystem(), unquote(urlparse(path).path)
        else:
            system, place = fs.FileSystem.from_uri(path)
        with system.open_input_stream(place, compression=None) as stream:
            line = b""
            while not (b"\n" in line or b"\r" in line):
                more = stream.read(HEAD_BYTES)
                if not more:
                    break
                line += more
    except (OSError, pa.ArrowException):
        return None
    return line.replace(b"\r", b"\n").split(b"\n", 1)[0]


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [_first_line(path) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.binary())], ["path", "line"])


def headers(files: DataFrame) -> DataFrame:
    """One row per different header line: line (bytes), paths (sorted). Tasks read the first lines, 64 files each."""
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    lines = files.select("path").repartition(tasks).mapInArrow(_first_lines, "path string, line binary")
    return lines.groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def header_names(line: str) -> list[str]:
    """Column names of a header line: repeats numbered, then blanks cut, empty names replaced."""
    seen: dict[str, int] = defaultdict(int)
    names = []
    for position, raw in enumerate(next(csv.reader([line]), [])):
        name = raw if raw.strip() else f"Unnamed: {position}"
        repeat = seen[name]
        seen[name] += 1
        names.append((f"{name}.{repeat}" if repeat else name).strip())
    return names


def decoded_line(line: bytes) -> str:
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        text = line.decode(BYTES_AS_TEXT)
    return text.lstrip("\ufeff")


def read_header(spark: SparkSession, path: str) -> bytes:
    """The first line of a file, read on the driver through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    stream = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(location)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, BYTES_AS_TEXT))
    try:
        return (reader.readLine() or "").encode(BYTES_AS_TEXT)
    finally:
        reader.close()


def header_groups(spark: SparkSession, raw_dir: str, glob: str = GLOB) -> dict[tuple[str, ...], list[str]]:
    """Column names of all files below a folder, each with the paths that have them.

    One job reads the headers. Only on file systems that Python cannot open does the driver read them.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for row in headers(discover(spark, raw_dir, glob)).collect():
        known = [(row.line, row.paths)] if row.line is not None else [(read_header(spark, p), [p]) for p in row.paths]
        for line, paths in known:
            groups[tuple(header_names(decoded_line(bytes(line))))] += paths
    return {names: sorted(paths) for names, paths in sorted(groups.items(), key=lambda g: min(g[1]))}


def decoded(column: Column) -> Column:
    """Text that was read byte by byte: UTF-8 where the bytes are valid UTF-8, else Latin-1."""
    as_utf8 = F.encode(column, BYTES_AS_TEXT).cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(column)


def load_raw(spark: SparkSession, raw_dir: str, glob: str = GLOB) -> DataFrame:
    """All files stacked by column name; a column a file lacks is null there. All columns are text.

    Files with the same header are read by one scan with a schema given by position.
    """
    groups = header_groups(spark, raw_dir, glob)
    if not groups:
        raise FileNotFoundError(f"no CSV files below {raw_dir}")
    frames = []
    for names, files in groups.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        frame = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("encoding", BYTES_AS_TEXT).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).csv(files)
        )
        if LABEL in names:
            frame = frame.withColumn(LABEL, decoded(quoted(LABEL)))
        frames.append(frame)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
