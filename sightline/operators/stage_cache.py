"""Results of a stage kept by the content of what went in: only inputs never seen before are worked out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.compat import stable_hash
from ..sources.keyed_table import KeyedTable


def stage_key(stage: str, version: str, *inputs: str) -> Column:
    """Name, version and the digest of the inputs: another version of a stage finds nothing of the one before."""
    return F.concat_ws(".", F.lit(stage), F.lit(version), stable_hash(*inputs))


def open_cache(spark: SparkSession, path: str, buckets: int = 256) -> KeyedTable:
    return KeyedTable.create(spark, path, "key string, value string", ["key"], buckets)


def through_cache(cache: KeyedTable, rows: DataFrame, stage: str, version: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame], value: StructType | str) -> DataFrame:
    """``rows`` with ``value`` and ``cached``: whether the stage's result for these inputs was there before.

    ``compute`` gets the distinct inputs that have no result yet, with their ``key``, and returns key and value, a struct of
    that schema, for those that it can do; the others have a null value and are tried again the next time. Inputs that are equal,
    nulls included, are worked out once. Results are JSON and appear in one commit, or not at all.
    """
    keyed = rows.withColumn("_key", stage_key(stage, version, *inputs))
    known = cache.lookup(keyed.select(F.col("_key").alias("key"))).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    missing = keyed.join(known, "_key", "left_anti").dropDuplicates(["_key"]).select(F.col("_key").alias("key"), *inputs)
    if not missing.isEmpty():
        cache.insert(compute(missing).filter("value is not null").select("key", F.to_json("value").alias("value")))
    now = cache.lookup(keyed.select(F.col("_key").alias("key"))).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    found = keyed.join(now, "_key", "left").join(known.select("_key", F.lit(True).alias("_cached")), "_key", "left")
    return found.select(*rows.columns, F.from_json("_value", value).alias("value"), F.coalesce("_cached", F.lit(False)).alias("cached"))
