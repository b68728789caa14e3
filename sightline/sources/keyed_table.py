"""Stored tables with a key: insert if absent, upsert, replace by key, and fold a batch in.

Rows live in Parquet folders, one for each bucket of the key's hash and commit; a manifest names the folders of
every bucket. A commit writes new folders for the buckets that its rows touch and then creates the next
manifest, in one step. Until then readers see the table as it was, so a commit that dies half-way changes
nothing; and a batch that a manifest has counted already is passed over, so a batch may run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BUCKET = "_bucket"
#: Inserts add a folder to a bucket; one with so many folders is written anew as one.
MOST_FOLDERS = 16
#: Versions of the manifest whose folders vacuum() keeps by default.
KEPT_VERSIONS = 2

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer committed first: nothing was changed, and the commit may be tried again."""


class KeyedTable:
    """A table at ``path``, which all executors share; ``create`` first, then open it by path alone.

    Keys may be null and count as equal then. All rows of a key are in one bucket, so a commit reads and writes only the buckets
    of its own keys. A bucket should hold what one task can write; their number is fixed when the table is
    created.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._file = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._latest()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """Makes an empty table, or opens the one that is there (whose schema and keys must then be these)."""
        table = cls(spark, path)
        shape = {"schema": spark.createDataFrame([], schema).schema.jsonValue(), "keys": keys}
        if not table.state:
            table._commit({"version": 0, **shape, "n_buckets": buckets, "folders": {}, "batches": {}})
        elif any(table.state[c] != v for c, v in shape.items()):
            raise ValueError(f"{path} has another schema or other keys")
        return table

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.state["schema"])

    @property
    def version(self) -> int:
        return self.state["version"]

    def read(self) -> DataFrame:
        return self._rows(sorted(self.state["folders"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets of these keys are read."""
        keys = keys.select(*(F.col(c).alias(f"_{c}") for c in self.state["keys"])).distinct()
        buckets = [str(r[0]) for r in keys.select(self._bucket("_")).distinct().collect()]
        there = self._rows(buckets)
        return there.join(keys, self._same(there, keys), "left_semi")

    def insert(self, rows: DataFrame, order: list[str] = [], batch: tuple[str, int] | None = None) -> bool:  # noqa: B006
        """For keys that the table lacks, adds the first row by ``order``; of the table only keys are read. False if ``batch`` was done before."""

        def fresh(there: DataFrame, given: DataFrame) -> DataFrame:
            first = F.row_number().over(Window.partitionBy(*self.state["keys"]).orderBy(*(order or self.state["keys"])))
            new = given.withColumn("_turn", first).filter("_turn = 1").drop("_turn")
            return self._without(new, there.select(*self.state["keys"]))

        return self._change(rows, rows, fresh, batch, adds=True)

    def upsert(self, rows: DataFrame, order: list[str] = [], batch: tuple[str, int] | None = None) -> bool:  # noqa: B006
        """The last given row by ``order`` takes the place of its key's row."""

        def newest(there: DataFrame, given: DataFrame) -> DataFrame:
            last = F.row_number().over(Window.partitionBy(*self.state["keys"]).orderBy(*(F.desc(c) for c in order or self.state["keys"])))
            new = given.withColumn("_turn", last).filter("_turn = 1").drop("_turn")
            return self._without(there, new.select(*self.state["keys"])).unionByName(new)

        return self._change(rows, rows, newest, batch)

    def replace(self, keys: DataFrame, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """All rows of ``keys`` go and ``rows``, whose keys must be among them, come; a key without rows is emptied."""
        keys = keys.select(*self.state["keys"]).distinct()
        return self._change(keys, rows, lambda there, given: self._without(there, keys).unionByName(given), batch)

    def merge(self, rows: DataFrame, merged: Merge, batch: tuple[str, int] | None = None) -> bool:
        """``merged`` makes the touched buckets' new rows from their rows and the given ones; it must keep rows of other keys."""
        return self._change(rows, rows, merged, batch)

    def vacuum(self, keep: int = KEPT_VERSIONS) -> int:
        """Deletes the folders that none of the last ``keep`` manifests names, and older manifests; no commit may be under way."""
        versions = self._versions()
        live = {folder for v in versions[-keep:] for found in self._manifest(v)["folders"].values() for folder in found}
        gone = 0
        for commit in self._list("data"):
            used = {f.split("/", 1)[1] for f in live if f.startswith(f"{commit}/")}
            for bucket in self._list(f"data/{commit}"):
                if bucket.startswith(BUCKET) and bucket not in used:
                    gone += self._fs.delete(self._file(f"{self.path}/data/{commit}/{bucket}"), True)
            if not used:
                self._fs.delete(self._file(f"{self.path}/data/{commit}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._file(f"{self.path}/versions/{v:012d}.json"), False)
        return gone

    def _change(self, touching: DataFrame, rows: DataFrame, merged: Merge, batch: tuple[str, int] | None, adds: bool = False) -> bool:
        self.state = self._latest()
        if batch and self.state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        rows = rows.select(*self.schema.names)
        touched = [str(r[0]) for r in touching.select(self._bucket()).distinct().collect()]  # numbers of buckets
        full = [b for b in touched if len(self.state["folders"].get(b, [])) >= MOST_FOLDERS]
        commit = uuid.uuid4().hex
        written = self._write(merged(self._rows(touched), rows), commit)
        if not set(written) <= set(touched):
            raise ValueError("there are rows of keys that the commit is not about")
        if adds and full:  # what the buckets held is written as one folder beside what is new
            written |= {b: [*found, *written.get(b, [])] for b, found in self._write(self._rows(full), f"{commit}-whole").items()}
        folders = dict(self.state["folders"])
        for b in touched:
            before = folders.pop(b, []) if adds and b not in full else folders.pop(b, []) and []
            if now := [*before, *written.get(b, [])]:
                folders[b] = now
        batches = self.state["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit(self.state | {"version": self.version + 1, "folders": folders, "batches": batches})
        return True

    def _bucket(self, prefix: str = "") -> Column:
        return F.pmod(F.xxhash64(*(f"{prefix}{c}" for c in self.state["keys"])), F.lit(self.state["n_buckets"])).cast("int").alias(BUCKET)

    def _same(self, rows: DataFrame, keys: DataFrame) -> Column:
        return reduce(and_, (rows[c].eqNullSafe(keys[f"_{c}"]) for c in self.state["keys"]))

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        keys = keys.select(*(F.col(c).alias(f"_{c}") for c in self.state["keys"])).distinct()
        return rows.join(keys, self._same(rows, keys), "left_anti")

    def _rows(self, buckets: list[str]) -> DataFrame:
        folders = [f"{self.path}/data/{f}" for b in buckets for f in self.state["folders"].get(b, [])]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, commit: str) -> dict[str, list[str]]:
        """Folders by bucket; a bucket that got no row has none. REBALANCE lets a large bucket take several tasks."""
        out = rows.select(*self.schema.names, self._bucket()).hint("rebalance", F.col(BUCKET))
        out.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{commit}")
        return {x.split("=")[1]: [f"{commit}/{x}"] for x in self._list(f"data/{commit}") if x.startswith(f"{BUCKET}=")}

    def _list(self, folder: str) -> list[str]:
        at = self._file(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._list("versions") if x.endswith(".json") and x[0] != "."]

    def _manifest(self, version: int) -> dict[str, Any]:
        stream = self._fs.open(self._file(f"{self.path}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _latest(self) -> dict[str, Any]:
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {}

    def _commit(self, state: dict[str, Any]) -> None:
        """The manifest is written aside and renamed; a rename onto another writer's manifest fails."""
        name = f"{state['version']:012d}.json"
        aside, there = self._file(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._file(f"{self.path}/versions/{name}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if self._fs.exists(there) or not self._fs.rename(aside, there):
            self._fs.delete(aside, False)
            raise Conflict(f"version {state['version']} of {self.path} exists")
        self.state = state
