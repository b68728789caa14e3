"""What each stage saw and made of a clip, as JSON by day, without binary content; failed clips as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType


def redacted(value: Column, kind: DataType) -> Column:
    """A value of any type in which each binary, however deep, is its size in words; nulls stay, and so does all else."""
    if isinstance(kind, BinaryType):
        return F.when(value.isNotNull(), F.concat(F.lit("<"), F.octet_length(value).cast("string"), F.lit(" bytes>")))
    if not _holds_binary(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(F.transform_keys(value, lambda k, v: redacted(k, kind.keyType)), lambda k, v: redacted(v, kind.valueType))
    return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))


def _holds_binary(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_binary(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_binary(kind.keyType) or _holds_binary(kind.valueType)
    return any(_holds_binary(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, BinaryType)


def without_binaries(rows: DataFrame) -> DataFrame:
    return rows.select(*(redacted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))


def traces(entries: DataFrame) -> DataFrame:
    """day, clip_id, traced_at, total_ms, failed, stages: one row a clip of entries (clip_id, traced_at, seq, stage, ms, cached, input, output, error).

    Stages stand in order of ``seq``; inputs and outputs are any types; a clip with an error in any stage has failed.
    """
    step = F.struct("seq", "stage", "ms", "cached", "input", "output", "error")
    by_clip = without_binaries(entries).groupBy("clip_id").agg(F.max("traced_at").alias("traced_at"), F.sum("ms").alias("total_ms"), F.max(F.col("error").isNotNull()).alias("failed"), F.collect_list(step).alias("stages"))
    in_order = F.array_sort("stages", lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    return by_clip.select(F.to_date("traced_at").alias("day"), "clip_id", "traced_at", "total_ms", "failed", F.transform(in_order, lambda s: s.dropFields("seq")).alias("stages"))


def write_traces(entries: DataFrame, path: str, batch: int = 0) -> None:
    """Adds the traces of a batch, a folder for each day and batch; a batch that runs again takes the place of what it wrote."""
    rows = traces(entries).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)
