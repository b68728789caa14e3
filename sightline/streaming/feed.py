"""What each tenant sees live: the newest observations, and a stream of notices of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..sources.keyed_table import KeyedTable

MOST = 60
OUT = "company_id string, place int, observation_id string, created_at timestamp, body string"


def latest(observations: DataFrame, most: int = MOST) -> DataFrame:
    """company_id, place, observation_id, created_at, body: each tenant's newest, from place 1.

    Of several rows of an observation the newest counts, then the larger body; of equal times the larger id comes first. Rows without a tenant are in no feed.
    """
    seen = Window.partitionBy("company_id", "observation_id").orderBy(F.desc("created_at"), F.desc("body"))
    rows = observations.filter("company_id <> ''").withColumn("turn", F.row_number().over(seen)).filter("turn = 1")
    newest = Window.partitionBy("company_id").orderBy(F.desc("created_at"), F.desc("observation_id"))
    rows = rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
    return rows.select("company_id", "place", "observation_id", "created_at", "body")


class Feed(StatefulProcessor):
    """A tenant's list is its state, ``most`` rows at most; a snapshot may stand before the stream."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.feed = handle.getValueState("feed", "rows string")

    def _merged(self, rows: pd.DataFrame) -> list[list]:
        known = {r[0]: r for r in (json.loads(self.feed.get()[0]) if self.feed.exists() else [])}
        for observation_id, at, body in rows[["observation_id", "created_at", "body"]].itertuples(index=False):
            row = [observation_id, pd.Timestamp(at).value // 1000, None if pd.isna(body) else body]
            old = known.get(observation_id)
            if old is None or (row[1], row[2] or "") > (old[1], old[2] or ""):
                known[observation_id] = row
        now = sorted(known.values(), key=lambda r: (r[1], r[0]), reverse=True)[: self.most]
        self.feed.update((json.dumps(now),))
        return now

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._merged(initialState)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self._merged(pd.concat(list(rows)))
        yield pd.DataFrame({
            "company_id": key[0], "place": pd.Series(range(1, len(now) + 1), dtype="int32"), "observation_id": [r[0] for r in now],
            "created_at": pd.to_datetime([r[1] for r in now], unit="us"), "body": [r[2] for r in now],
        })

    def close(self) -> None:
        pass


def live(observations: DataFrame, snapshot: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The whole list of each tenant that a batch of the stream (company_id, observation_id, created_at, body) changes, as ``latest`` gives it.

    ``snapshot`` has rows of the same columns that count as seen before the stream begins. Needs the RocksDB store.
    """
    columns = ["company_id", "observation_id", "created_at", "body"]
    grouped = observations.filter("company_id <> ''").select(*columns).groupBy("company_id")
    before = None if snapshot is None else latest(snapshot, most).select(*columns).groupBy("company_id")
    return grouped.transformWithStateInPandas(Feed(most), OUT, "Update", "None", before)


def shown_in(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts each changed list in the place of the tenant's old one in a table keyed by company_id."""

    def show(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            table.replace(batch.select("company_id"), batch, ("feed", number))
        finally:
            batch.unpersist()

    return show


def notices(rows: DataFrame, kind: Column, *fields: str) -> DataFrame:
    """company_id, kind, payload (JSON of ``fields``, nulls left out): what a tenant's clients are told; rows without a tenant are told to no one."""
    return rows.filter("company_id <> ''").select("company_id", kind.alias("kind"), F.to_json(F.struct(*fields)).alias("payload"))


def fan_out(notices: DataFrame, path: str, checkpoint: str):
    """A folder of JSON lines for each tenant, so that a reader of one never opens another's; returns the stream's writer."""
    return notices.writeStream.format("json").partitionBy("company_id").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
