"""Fixed-size tables over a whole corpus (counts, Bloom filters), merged in Spark.

A task fills one dense array and emits it in chunks; chunks are merged within groups of tasks,
then over the groups. The size is a parameter and does not follow the input, which is what
makes the result safe to collect and to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 17
TASK_GROUPS = 64
SCHEMA = "chunk int, task int, part binary"


def dense(df: DataFrame, slots: int, dtype: type, fill: Callable[[pa.RecordBatch, np.ndarray], None], merge: np.ufunc = np.add) -> np.ndarray:
    """``fill`` puts a batch into a zeroed array of ``slots``; the arrays of all tasks are merged by ``merge``."""
    step = CHUNK_BYTES // np.dtype(dtype).itemsize

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype)
        for batch in batches:
            fill(batch, total)
        for at in range(0, slots, step):
            if total[at : at + step].any():
                yield pa.RecordBatch.from_pylist([_row(at // step, TaskContext.get().partitionId() % TASK_GROUPS, total[at : at + step])])

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for part in table.column("part"):
            got = np.frombuffer(part.as_buffer(), dtype)
            total = got.copy() if total is None else merge(total, got, out=total)
        return pa.Table.from_pylist([_row(table.column("chunk")[0].as_py(), table.column("task")[0].as_py(), total)])

    parts = df.mapInArrow(local, SCHEMA)
    parts = parts.groupBy("chunk", "task").applyInArrow(merged, SCHEMA)
    parts = parts.groupBy("chunk").applyInArrow(merged, SCHEMA)
    out = np.zeros(slots, dtype)
    for row in parts.select("chunk", "part").collect():  # slots * itemsize bytes at most
        got = np.frombuffer(row.part, dtype)
        out[row.chunk * step : row.chunk * step + len(got)] = got
    return out


def _row(chunk: int, task: int, part: np.ndarray) -> dict:
    return {"chunk": np.int32(chunk), "task": np.int32(task), "part": part.tobytes()}


BLOOM_PROBES = 3


def bloom_bits(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Positions of 64-bit hashes in a Bloom filter of 2**bits bits."""
    return [(values * np.uint64(2 * k + 0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for k in range(BLOOM_PROBES)]


def bloom(df: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter, as 2**bits / 8 bytes, of the only column of ``df``, a long."""

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in bloom_bits(values, bits):
            np.bitwise_or.at(total, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    return dense(df, (1 << bits) // 8, np.uint8, fill, np.bitwise_or)


def in_bloom(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``values`` may be in the filter (all that are, and few others)."""
    found = np.ones(len(values), bool)
    for at in bloom_bits(values, bits):
        found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found
