"""Clips as clients send them: checked row by row, with every reason why one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024
#: A time in UTC, as clients write it.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"


def checked(uploads: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Uploads with ``audio`` (binary), ``reasons`` (empty for good ones), defaults put in, and ``recorded_at`` as a timestamp.

    Columns are client_uuid, audio_base64, mime_type, source, lat, lng, declared_outlet_id, recorded_at (text); others stay.
    Content that is not base64 is a reason like any other and no failure of the read. A place needs both numbers.
    """
    audio, size = F.try_to_binary("audio_base64", F.lit("base64")), F.octet_length(F.col("audio"))
    rows = uploads.withColumns({"audio": audio, "mime_type": F.coalesce("mime_type", F.lit("audio/webm")), "source": F.coalesce("source", F.lit("voice"))})
    length = F.char_length("client_uuid")
    at = F.try_to_timestamp("recorded_at")
    given = F.coalesce(F.col("audio_base64"), F.lit("")) != ""
    faults: list[tuple[Column, str]] = [
        (length.isNull() | (length < 8) | (length > 128), "client_uuid must have 8 to 128 characters"),
        (~given, "audio_base64 is missing"),
        (given & F.col("audio").isNull(), "audio_base64 is not base64"),
        (given & (size == 0), "audio is empty"),
        (size > most_bytes, "audio is too large"),
        (~F.col("source").isin("voice", "photo"), "source must be voice or photo"),
        (F.col("lat").isNull() != F.col("lng").isNull(), "a place needs lat and lng"),
        (F.coalesce(~F.col("recorded_at").rlike(ISO_TIME) | at.isNull(), F.lit(True)), "recorded_at must be a time in UTC"),
    ]
    reasons = F.array_compact(F.array(*(F.when(fault, reason) for fault, reason in faults)))
    return rows.withColumn("reasons", reasons).withColumn("recorded_at", at).drop("audio_base64")


def parted(uploads: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(good, refused): good rows with their audio, refused ones with ``reasons`` and without it. In a stream, write both from one foreachBatch."""
    rows = checked(uploads, most_bytes)
    return rows.filter(F.size("reasons") == 0).drop("reasons"), rows.filter(F.size("reasons") > 0).drop("audio")
