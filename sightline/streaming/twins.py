"""Streaming forms of the keyed state in ``operators.state``; each ends where its batch form does on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..sources.keyed_table import KeyedTable

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe(clips: DataFrame, keys: list[str], at: str, ttl: str = "24 hours") -> DataFrame:
    """The first row of each key within ``ttl`` of event time; ``insert_batches`` guards against later repeats."""
    return clips.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def insert_batches(table: KeyedTable, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the rows whose keys the table lacks; of the table only keys in the batch's own buckets are read."""
    return lambda batch, number: bool(table.insert(batch, order, ("insert_batches", number))) and None


class Prompts(StatefulProcessor):
    """A prompt's life by event time: created, answered (late or not), cancelled, or settled by a timer.

    State stays after the timer, since a late answer still counts.
    """

    def __init__(self, hours: float):
        self.life = timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prompt = handle.getValueState("prompt", "status string, value string, late boolean, created timestamp")

    def _now(self) -> tuple:
        return tuple(self.prompt.get()) if self.prompt.exists() else ("pending", None, False, None)

    def _shown(self, key) -> pd.DataFrame:
        status, value, late, _ = self._now()
        return pd.DataFrame({"prompt_id": [key[0]], "status": [status], "value": [value], "late": [late]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            status, value, late, created = self._now()
            if row.kind == "create" and created is None:
                created = row.at.to_pydatetime()
                self.handle.registerTimer(int((created + self.life).timestamp() * 1000))
            elif row.kind == "cancel" and status == "pending":
                status = "cancelled"
            elif row.kind == "answer" and status in ("pending", "auto_resolved"):
                late = status == "auto_resolved" or (created is not None and row.at.to_pydatetime() > created + self.life)
                status, value = "answered", row.value
            self.prompt.update((status, value, late, created))
        yield self._shown(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, value, late, created = self._now()
        if status == "pending":
            self.prompt.update(("auto_resolved", value, late, created))
            yield self._shown(key)

    def close(self) -> None:
        pass


def prompts(events: DataFrame, hours: float = 24, delay: str = "0 seconds") -> DataFrame:
    """prompt_id, status, value, late after each change, of events (prompt_id, at, kind, value): create, answer, cancel.

    Timers follow event time, so a quiet stream settles its last prompts when a newer event arrives. Needs the RocksDB store.
    """
    grouped = events.withWatermark("at", delay).groupBy("prompt_id")
    return grouped.transformWithStateInPandas(Prompts(hours), "prompt_id string, status string, value string, late boolean", "Update", "EventTime")


SURFACES = "company_id string, surface string, occurrences long, last struct<at:timestamp,clip_id:long,sku_id:string>, recent array<struct<at:timestamp,clip_id:long>>"


def surface_state(rows: DataFrame, samples: int = 5) -> DataFrame:
    """company_id, surface, occurrences, last (at, clip_id, sku_id), recent (the last clips): what merges of (…, sku_id, clip_id, at) need."""
    turn = F.row_number().over(Window.partitionBy("company_id", "surface").orderBy(F.desc("at"), F.desc("clip_id")))
    numbered = rows.withColumn("_turn", turn)
    recent = F.sort_array(F.collect_list(F.when(F.col("_turn") <= samples, F.struct("at", "clip_id"))), asc=False)
    return numbered.groupBy("company_id", "surface").agg(F.count("*").alias("occurrences"), F.max(F.struct("at", "clip_id", "sku_id")).alias("last"), recent.alias("recent"))


def merged_surfaces(before: DataFrame, batch: DataFrame, samples: int = 5) -> DataFrame:
    """Two states as one; a surface has one row in each."""
    both = before.unionByName(batch).groupBy("company_id", "surface")
    recent = F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, samples)
    return both.agg(F.sum("occurrences").alias("occurrences"), F.max("last").alias("last"), recent.alias("recent"))


def shown_surfaces(state: DataFrame) -> DataFrame:
    """The columns of ``operators.state.surface_counts``."""
    clips = F.transform(F.sort_array("recent"), lambda x: x["clip_id"])
    return state.select("company_id", "surface", "occurrences", F.col("last.sku_id").alias("suggested"), clips.alias("sample_clips"))


def count_batches(table: KeyedTable, samples: int = 5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch to the counts in a table of ``SURFACES`` by company_id and surface.

    Only the buckets of the batch's surfaces are read and written, and a batch that runs again adds nothing.
    """

    def count(batch: DataFrame, number: int) -> None:
        new = surface_state(batch, samples).select(*table.schema.names)
        table.merge(new, lambda there, given: merged_surfaces(there, given, samples), ("count_batches", number))

    return count


def counted(table: KeyedTable) -> DataFrame:
    return shown_surfaces(table.read())
