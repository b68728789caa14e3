"""Jobs that are tried until they are done: attempts, growing pauses between them, and dead letters.

A job's state is its number of attempts. A failure that may pass sets a processing-time timer for the next attempt;
one that cannot, or the last attempt, makes the job a dead letter. State is checkpointed with the stream, so after a
restart a job goes on with the attempts that it has left; an attempt whose batch failed is made again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..sources.keyed_table import KeyedTable

ATTEMPTS, BACKOFF_MS = 3, 2000
#: How long a finished job is known, so that the same job is not done twice.
RETENTION_MS = 7 * 24 * 3600 * 1000
OUT = "job_id string, attempt int, status string, value string, error string, due timestamp"
KINDS = {"attempt": "int32", "due": "datetime64[ms]"}


class ProviderError(Exception):
    """A service refused: worth another try if it is overloaded (429) or broken (500 and above), or said no status."""

    def __init__(self, message: str, http_status: int | None = None):
        super().__init__(message)
        self.http_status = http_status


def retryable_error(error: Exception) -> bool:
    """Every error may pass but a provider's refusal of the request itself."""
    status = error.http_status if isinstance(error, ProviderError) else None
    return status is None or status == 429 or status >= 500


def retryable(by_provider: Column, http_status: Column) -> Column:
    """The same rule for failures that are rows."""
    return F.coalesce(~by_provider, F.lit(True)) | http_status.isNull() | (http_status == 429) | (http_status >= 500)


def pause_ms(attempt: int, backoff_ms: int) -> int:
    return backoff_ms * 2 ** (attempt - 1)


class Attempts(StatefulProcessor):
    def __init__(self, work: Callable[[str, int], str], most: int, backoff_ms: int, retention_ms: int):
        self.work, self.most, self.backoff_ms, self.retention_ms = work, most, backoff_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "payload string, attempts int, open boolean", self.retention_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        if not self.job.exists():  # else it is under way or done: the job was sent twice
            yield self._tried(key, given["payload"].iloc[0], 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists() and self.job.get()[2]:
            payload, attempts, _ = self.job.get()
            yield self._tried(key, payload, attempts, timerValues)

    def _tried(self, key, payload: str | None, attempts: int, timerValues) -> pd.DataFrame:
        attempt, due, value, error = attempts + 1, None, None, None
        try:
            value, status = self.work(payload, attempt), "done"
        except Exception as e:
            error, again = str(e), retryable_error(e) and attempt < self.most
            status = "waiting" if again else "dead"
            if again:
                due = timerValues.getCurrentProcessingTimeInMs() + pause_ms(attempt, self.backoff_ms)
                self.handle.registerTimer(due)
        self.job.update((payload, attempt, status == "waiting"))
        row = pd.DataFrame({"job_id": [key[0]], "attempt": [attempt], "status": [status], "value": [value], "error": [error], "due": [pd.NaT if due is None else pd.Timestamp(due, unit="ms")]})
        return row.astype(KINDS)

    def close(self) -> None:
        pass


def attempted(jobs: DataFrame, work: Callable[[str, int], str], most: int = ATTEMPTS, backoff_ms: int = BACKOFF_MS, retention_ms: int = RETENTION_MS) -> DataFrame:
    """job_id, attempt, status (done, waiting, dead), value, error, due: a row for each attempt at the jobs (job_id, payload) of a stream.

    ``work`` takes the payload and the number of the attempt and returns a value or raises. The pause after attempt
    n is ``backoff_ms`` times 2 to the n - 1. Of jobs with one id only the first is tried. Needs the RocksDB store.
    """
    processor = Attempts(work, most, backoff_ms, retention_ms)
    return jobs.select("job_id", "payload").groupBy("job_id").transformWithStateInPandas(processor, OUT, "Append", "ProcessingTime")


def routed(done: KeyedTable, dead: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: finished jobs go to one table by job_id, dead letters to another; a batch may run again."""

    def route(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            done.insert(batch.filter("status = 'done'"), ["attempt"], ("routed", number))
            dead.insert(batch.filter("status = 'dead'"), ["attempt"], ("routed", number))
        finally:
            batch.unpersist()

    return route


def settled_attempts(outcomes: DataFrame, most: int = ATTEMPTS, backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """job_id, attempts, status, due: where jobs stand after the outcomes (job_id, at, ok, by_provider, http_status) of a log, in order of ``at``.

    The first success, refusal or ``most``-th failure decides; what a log holds after that does not count.
    """
    turn = F.row_number().over(Window.partitionBy("job_id").orderBy("at"))
    rows = outcomes.withColumn("attempt", turn).filter(F.col("attempt") <= most)
    dead = ~F.col("ok") & (~retryable(F.col("by_provider"), F.col("http_status")) | (F.col("attempt") == most))
    rows = rows.withColumn("status", F.when(F.col("ok"), "done").when(dead, "dead").otherwise("waiting"))
    ended = F.min(F.when(F.col("status") != "waiting", F.struct("attempt", "at", "status")))
    found = rows.groupBy("job_id").agg(F.coalesce(ended, F.max(F.struct("attempt", "at", "status"))).alias("x"))
    pause = F.make_dt_interval(secs=F.lit(backoff_ms / 1000) * F.pow(F.lit(2), F.col("x.attempt") - 1))
    return found.select("job_id", F.col("x.attempt").alias("attempts"), "x.status", F.when(F.col("x.status") == "waiting", F.col("x.at") + pause).alias("due"))
