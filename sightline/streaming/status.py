"""The life of a clip: which status may follow which, what a log of changes comes to, and what it was refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What may follow each status, '' before the first: a clip that ended may be processed anew, and each attempt sets it to processing.
TRANSITIONS = {"": ["queued"], "queued": ["processing"], "processing": ["processing", "processed", "failed"], "processed": ["processing"], "failed": ["processing"]}
OUT = "clip_id string, at timestamp, before string, asked string, accepted boolean"


def may_follow(before: Column, asked: Column) -> Column:
    """Whether a change is in the table; never for a null or unknown status."""
    allowed = F.lit(False)
    for status, following in TRANSITIONS.items():
        allowed = allowed | ((F.coalesce(before, F.lit("")) == status) & asked.isin(*following))
    return F.coalesce(allowed, F.lit(False))


def status_log(changes: DataFrame) -> DataFrame:
    """clip_id, at, before, asked, accepted for each of the changes (clip_id, at, status), in order of ``at``, then status.

    A refused change leaves the status as it was; ``before`` is null until one was accepted. A clip's own changes, a handful,
    are folded as one array.
    """
    asked = F.array_sort(F.collect_list(F.struct("at", "status")))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<at:timestamp,before:string,asked:string,accepted:boolean>>").alias("log"))

    def step(state: Column, x: Column) -> Column:
        ok = may_follow(state["now"], x["status"])
        entry = F.struct(x["at"].alias("at"), state["now"].alias("before"), x["status"].alias("asked"), ok.alias("accepted"))
        return F.struct(F.when(ok, x["status"]).otherwise(state["now"]).alias("now"), F.array_append(state["log"], entry).alias("log"))

    folded = changes.groupBy("clip_id").agg(F.aggregate(asked, start, step)["log"].alias("log"))
    return folded.select("clip_id", F.inline("log"))


def current_status(log: DataFrame) -> DataFrame:
    """clip_id, status, at: the last accepted change of each clip; clips without one are left out."""
    return log.filter("accepted").groupBy("clip_id").agg(F.max_by("asked", F.struct("at", "asked")).alias("status"), F.max("at").alias("at"))


class Life(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clip = handle.getValueState("clip", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.clip.get()[0] if self.clip.exists() else None
        log = []
        for at, asked in sorted(pd.concat(list(rows))[["at", "status"]].itertuples(index=False), key=lambda x: (x[0], x[1] is not None, x[1])):
            ok = asked in TRANSITIONS.get(now or "", [])
            log.append((key[0], at, now, asked, ok))
            now = asked if ok else now
        if now is not None:
            self.clip.update((now,))
        yield pd.DataFrame(log, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def status_changes(changes: DataFrame) -> DataFrame:
    """The rows of ``status_log`` as a stream of changes gives rise to them; refused ones are those not ``accepted``. Needs the RocksDB store."""
    grouped = changes.select("clip_id", "at", "status").groupBy("clip_id")
    return grouped.transformWithStateInPandas(Life(), OUT, "Append", "None")
