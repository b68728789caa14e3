"""Intermediate tables in the folder that driver and executors share, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.scratch import clear, made_for, shared_dir
from ..sources.scratch import written as materialize

__all__ = ["clear", "made_for", "materialize", "row_key", "shared_dir"]


def row_key() -> list[Column]:
    """(row_a, row_b): a 128-bit digest of doc_id and text, nulls told apart; equal for equal rows only."""
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "row_a"), (2, "row_b"))]
