"""Catalogue files: CSV read with checks on each row; bad rows are reported, good ones upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.compat import parse_bool, split_list
from .scratch import written

# The wording of reasons.
EMPTY_TEXT = "String must contain at least 1 character(s)"
NOT_NUMBERS = "lat/lng is not a number"
TOO_SMALL, TOO_LARGE = "Number must be greater than or equal to", "Number must be less than or equal to"
LIMITS = {"lat": 90, "lng": 180}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text, null never, and ``row``: the record's place in its file, from 2 behind the header.

    Quoted fields may hold commas, quotes (doubled) and line ends; a byte order mark is no part of the first
    name; short records end in empty fields; records whose fields are all empty do not count. Places
    are counted per file, so a file is the unit of work: catalogues, not logs.
    """
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    names = raw.columns
    rows = raw.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    filled = rows.filter(F.concat_ws("", *(F.col(f"`{c}`") for c in names)) != "")
    return filled.withColumn("row", F.row_number().over(Window.partitionBy("_file").orderBy("_at")) + 1).drop("_file", "_at")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``row``: their place by ``key``, from 2 as behind a header. Ranges are sorted by tasks, and only their counts are gathered."""
    sorted_rows = written(rows.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # one row a task
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("row", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 2).drop("_at", "_part", "before")


def require_headers(rows: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in rows.columns]
    if missing:
        found = [c for c in rows.columns if c != "row"]
        raise ValueError(f"CSV is missing required column(s): {', '.join(missing)}. Found: {', '.join(found)}")


def _cell(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit("")


def _optional(rows: DataFrame, name: str) -> Column:
    return F.nullif(_cell(rows, name), F.lit(""))


def _reasons(texts: dict[str, Column], numbers: dict[str, Column] | None = None) -> Column:
    """What is wrong with a row, '; ' between issues; '' if nothing is."""
    issues = [F.when(c == "", f"{name}: {EMPTY_TEXT}") for name, c in texts.items()]
    for name, c in (numbers or {}).items():
        most = LIMITS[name]
        issues += [F.when(c < -most, f"geo.{name}: {TOO_SMALL} -{most}"), F.when(c > most, f"geo.{name}: {TOO_LARGE} {most}")]
    return F.concat_ws("; ", *issues)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, skipped (row, reason)) of rows with a ``reason``."""
    return rows.filter("reason = ''").drop("reason"), rows.filter("reason <> ''").select("row", "reason")


def sku_rows(rows: DataFrame, company: str) -> tuple[DataFrame, DataFrame]:
    """Products (skuId, name, brand, pack, manufacturer, isCompetitor, active); not a competitor and active unless stated."""
    require_headers(rows, ["skuId", "name", "brand"])
    return _split(
        rows.select(
            "row",
            F.lit(company).alias("company_id"),
            F.col("skuId").alias("sku_id"),
            "name",
            "brand",
            _optional(rows, "pack").alias("pack"),
            _optional(rows, "manufacturer").alias("manufacturer"),
            parse_bool(_cell(rows, "isCompetitor"), False).alias("is_competitor"),
            parse_bool(_cell(rows, "active"), True).alias("active"),
            _reasons({c: F.col(c) for c in ("skuId", "name", "brand")}).alias("reason"),
        )
    )


def outlet_rows(rows: DataFrame, company: str) -> tuple[DataFrame, DataFrame]:
    """Outlets (outletId, name, lat, lng, territoryId, address, active); a blank lat or lng is no number."""
    require_headers(rows, ["outletId", "name", "lat", "lng"])
    place = {c: F.expr(f"try_cast({c} as double)") for c in ("lat", "lng")}
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    bad = ~(finite(place["lat"]) & finite(place["lng"]))
    reason = F.when(bad, NOT_NUMBERS).otherwise(_reasons({c: F.col(c) for c in ("outletId", "name")}, place))
    return _split(
        rows.select(
            "row",
            F.lit(company).alias("company_id"),
            F.col("outletId").alias("outlet_id"),
            "name",
            place["lat"].alias("lat"),
            place["lng"].alias("lng"),
            _optional(rows, "territoryId").alias("territory_id"),
            _optional(rows, "address").alias("address"),
            parse_bool(_cell(rows, "active"), True).alias("active"),
            reason.alias("reason"),
        )
    )


def rep_rows(rows: DataFrame, company: str) -> tuple[DataFrame, DataFrame]:
    """Reps (repId, name, phone, territoryId, brandPortfolio, active); the portfolio is a list of brands."""
    require_headers(rows, ["repId", "name"])
    return _split(
        rows.select(
            "row",
            F.lit(company).alias("company_id"),
            F.col("repId").alias("rep_id"),
            "name",
            _optional(rows, "phone").alias("phone"),
            _optional(rows, "territoryId").alias("territory_id"),
            split_list(_cell(rows, "brandPortfolio")).alias("brand_portfolio"),
            parse_bool(_cell(rows, "active"), True).alias("active"),
            _reasons({c: F.col(c) for c in ("repId", "name")}).alias("reason"),
        )
    )


def report(good: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: parsed, imported, and skipped as an array of (row, reason) in file order."""
    counts = good.agg(F.count("*").alias("imported"))
    listed = skipped.agg(F.array_sort(F.collect_list(F.struct("row", "reason"))).alias("skipped"))
    return counts.crossJoin(listed).select((F.col("imported") + F.size("skipped")).alias("parsed"), "imported", "skipped")  # one row each


def upserted(existing: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the imported rows in place of theirs; of one key the last row counts, and columns that the file lacks keep their values."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("row")))
    new = good.withColumn("_turn", last).filter("_turn = 1").drop("_turn", "row")
    both = existing.join(new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_is_new")), keys, "full")
    value = lambda c: F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in new.columns and c not in keys else F.col(c)
    return both.select(*(value(c).alias(c) for c in existing.columns))
