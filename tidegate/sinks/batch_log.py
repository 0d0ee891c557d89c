"""Tables that a stream appends to batch by batch, each batch committed as a whole and at most once.

A batch first writes its folders, then commits by moving one small state file into place. Readers look at the newest
state only, so folders of a batch that was never committed are not seen, and a batch that comes again after its commit
changes nothing. Folders of a table are merged in tiers, FAN_IN of one tier to one of the next, so their number grows
with the logarithm of the batches, and a row is rewritten as many times at most.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN_IN = 10
ROWS_PER_FILE = 200_000
#: Commits after which folders that a merge has replaced are deleted: readers may still hold the state before it.
GRACE = 2
KEPT_STATES = 5


@dataclass(frozen=True)
class Table:
    """How a table is stored; `replaced`: each batch's rows take the place of all before."""

    name: str
    schema: StructType
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    replaced: bool = False


class BatchLog:
    """Committed folders below `root`; `source` names the run that numbers the batches (a checkpoint's id)."""

    def __init__(self, spark: SparkSession, root: str, source: str = "batch"):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    # ------------------------------------------------------------------ state
    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The newest committed state: last batch by source, facts, folders by table, folders to delete."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "batches": {}, "facts": {}, "tables": {}, "replaced": []}
        stream = self._fs.open(self._path(f"{self.root}/_log/{numbers[-1]:020d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        state["number"] += 1
        number, ready = state["number"], [f for f in state["replaced"] if f["since"] + GRACE <= state["number"]]
        state["replaced"] = [f for f in state["replaced"] if f not in ready]
        target = self._path(f"{self.root}/_log/{number:020d}.json")
        draft = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"state {number} of {self.root} has another writer")
        for old in ready:
            self._fs.delete(self._path(f"{self.root}/{old['path']}"), True)
        for old in self._numbers()[:-KEPT_STATES]:
            self._fs.delete(self._path(f"{self.root}/_log/{old:020d}.json"), False)

    def has(self, batch: int) -> bool:
        return self.state()["batches"].get(self.source, -1) >= batch

    # ------------------------------------------------------------------ tables
    def write(self, batch: int, rows: list[tuple[Table, tuple[DataFrame, int]]], facts: dict | None = None) -> bool:
        """Commits a batch: pairs of a table and (its rows, their number). False if it was committed before."""
        state = self.state()
        if state["batches"].get(self.source, -1) >= batch:
            return False
        for table, (df, count) in rows:
            folder = f"{table.name}/{self.source[:8]}-{batch:010d}"
            # a shuffle, so that few rows out of a large frame do not make one task read all of it
            self._save(table, df.repartition(max(1, math.ceil(count / ROWS_PER_FILE))), count, folder)
            held = state["tables"].get(table.name, [])
            if table.replaced:
                state["replaced"] += [{"path": f["path"], "since": state["number"] + 1} for f in held if f["path"] != folder]
                held = []
            state["tables"][table.name] = held + [{"path": folder, "tier": 0, "rows": count}]
        state["batches"][self.source] = batch
        state["facts"] |= facts or {}
        self._commit(state)
        for table, _ in rows:
            if not table.replaced:
                self.merge(table)
        return True

    def _save(self, table: Table, df: DataFrame, count: int, folder: str) -> None:
        files = max(1, math.ceil(count / ROWS_PER_FILE))
        writer = df.coalesce(files).write.mode("overwrite").options(**table.options)
        writer.format(table.format).save(f"{self.root}/{folder}")

    def merge(self, table: Table) -> None:
        """Merges the oldest FAN_IN folders of each tier that has so many."""
        while True:
            state = self.state()
            held = state["tables"].get(table.name, [])
            full = [t for t in sorted({f["tier"] for f in held}) if sum(f["tier"] == t for f in held) >= FAN_IN]
            if not full:
                return
            tier = full[0]
            parts = [f for f in held if f["tier"] == tier][:FAN_IN]
            count = sum(f["rows"] for f in parts)
            folder = f"{table.name}/tier{tier + 1}-{state['number'] + 1:010d}"
            self._save(table, self._load(table, parts), count, folder)
            at = held.index(parts[0])
            rest = [f for f in held if f not in parts]
            state["tables"][table.name] = rest[:at] + [{"path": folder, "tier": tier + 1, "rows": count}] + rest[at:]
            state["replaced"] += [{"path": f["path"], "since": state["number"] + 1} for f in parts]
            self._commit(state)

    def _load(self, table: Table, parts: list[dict]) -> DataFrame:
        reader = self.spark.read.schema(table.schema).format(table.format).options(**table.options)
        return reader.load([f"{self.root}/{f['path']}" for f in parts])

    def read(self, table: Table) -> DataFrame:
        """All committed rows."""
        parts = self.state()["tables"].get(table.name, [])
        return self._load(table, parts) if parts else self.spark.createDataFrame([], table.schema)
