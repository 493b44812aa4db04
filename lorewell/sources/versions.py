"""Tables that change as one: a numbered manifest names the parts that count.

A change writes its parts beside those that are there and then one manifest. Readers follow the newest manifest, so a job that
is killed between its writes has changed nothing, and nobody sees half of a change. Two writers can't both make the same
version: a manifest's file is created, never overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class Versions:
    """The tables below ``path``. A manifest is {"tables": {name: [part, ...]}, ...} and whatever else its writer states."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> dict | None:
        """A version's manifest; None if its writer died while writing it."""
        stream = self._fs.open(self._at(f"{self.path}/_versions/{number:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) and "tables" in found else None

    def current(self) -> tuple[int, dict]:
        """The newest whole manifest and its number; 0 and an empty one where there is none."""
        for number in reversed(self._numbers()):
            if (found := self._read(number)) is not None:
                return number, found
        return 0, {"tables": {}}

    def commit(self, seen: int, manifest: dict) -> int:
        """Make ``manifest`` the version after ``seen``, the one it builds on. Fails if anybody was faster."""
        number = max([seen, *self._numbers()]) + 1
        if self.current()[0] != seen:
            raise Conflict(f"version {seen} is not the newest")
        target = self._at(f"{self.path}/_versions/{number:08d}.json")
        try:
            stream = self._fs.create(target, False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {number} exists") from None
            raise
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode("utf-8")))
        finally:
            stream.close()
        return number

    def part(self, df: DataFrame, table: str, *by: str) -> str:
        """Write ``df`` as a part of a table, which no manifest names yet."""
        name = f"{table}/{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        return name

    def read(self, manifest: dict, table: str, schema) -> DataFrame:
        """A table as a manifest has it; empty where it has no parts."""
        parts = [f"{self.path}/{p}" for p in manifest["tables"].get(table, [])]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = None
        for p in parts:  # each part has its own folders of partitions
            one = self.spark.read.schema(schema).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def sweep(self, keep: int = 2) -> int:
        """Delete the parts that none of the last ``keep`` whole versions names, and older manifests. For times without writers."""
        whole = [(n, m) for n in self._numbers() if (m := self._read(n)) is not None]
        named = {p for _, m in whole[-keep:] for parts in m["tables"].values() for p in parts}
        gone = 0
        for table in {t for _, m in whole for t in m["tables"]}:
            folder = self._at(f"{self.path}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{table}/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for n, _ in whole[:-keep]:
            self._fs.delete(self._at(f"{self.path}/_versions/{n:08d}.json"), False)
        return gone


def commit_together(versions: Versions, notes: DataFrame, events: DataFrame) -> int:
    """Append notes and the events that tell of them as one change: both are there afterwards, or neither."""
    number, manifest = versions.current()
    tables = dict(manifest["tables"])
    for name, df in (("notes", notes), ("events", events)):
        tables[name] = [*tables.get(name, []), versions.part(df, name)]
    return versions.commit(number, manifest | {"tables": tables})
