"""Tenant- and time-scoped aggregations over observations and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.compat import distinct_with_null, half_even, half_up, map_mean

# Lower edges of the confidence bands.
BANDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)
BANDS_END = 1.01


def scoped(observations: DataFrame, company: str, start: str, end: str) -> DataFrame:
    """Rows of a tenant, not discarded (a null status stays), recorded from ``start`` to ``end`` inclusive."""
    return observations.filter((F.col("company_id") == company) & ~F.col("status").eqNullSafe("discarded") & F.col("recorded_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def count_distinct_values(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Per key, how many distinct values each column has, null counted as one: {column: name}.

    Values are made distinct as (key, column, value) rows in one pass with a partial aggregation, where several
    count_distinct in one aggregate would copy every row once a column.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")) for c in columns))
    seen = rows.groupBy(*keys, *columns).agg(F.lit(1).alias("_one")).select(*keys, F.inline(cells)).distinct()
    counts = [count_where(F.col("_column") == c).alias(n) for c, n in columns.items()]
    return seen.groupBy(*keys).agg(*counts) if keys else seen.agg(*counts)


def summary(rows: DataFrame) -> DataFrame:
    """One row; all zero for no rows."""
    plain = rows.agg(
        F.count("*").alias("observations"),
        count_where(F.col("status") == "needs_clarification").alias("needs_clarification"),
        count_where(F.col("severity") == "high").alias("high_severity"),
    )
    distinct = count_distinct_values(rows, [], {"clip_id": "clip_count", "rep_id": "active_reps", "outlet_id": "outlets_covered"})
    both = plain.crossJoin(distinct)  # one row each
    return both.select("observations", "clip_count", "active_reps", "outlets_covered", "needs_clarification", "high_severity")


def share_of_voice(rows: DataFrame) -> DataFrame:
    voiced = rows.filter(F.col("competitor_brand").isNotNull()).groupBy("competitor_brand")
    counted = voiced.agg(F.count("*").alias("mentions"), distinct_with_null("outlet_id").alias("outlet_count"), count_where(F.col("severity") == "high").alias("high_severity"))
    return counted.orderBy(F.desc("mentions"), "competitor_brand")


def stock_outs(rows: DataFrame) -> DataFrame:
    out = rows.filter(F.col("type") == "stock_out").groupBy("outlet_id", "sku_id").agg(F.count("*").alias("occurrences"), F.max("recorded_at").alias("last_seen"))
    return out.orderBy(F.desc("occurrences"), "outlet_id", "sku_id")


def price_erosion(rows: DataFrame) -> DataFrame:
    priced = rows.filter(F.col("price_delta").isNotNull()).groupBy("sku_id", "competitor_brand")
    found = priced.agg(half_even(F.avg("price_delta"), 2).alias("avg_delta"), F.min("price_delta").alias("min_delta"), F.count("*").alias("reports"), distinct_with_null("outlet_id").alias("outlet_count"))
    return found.orderBy("avg_delta", "sku_id", "competitor_brand")


def rep_coverage(rows: DataFrame) -> DataFrame:
    """Per rep; confidence is the mean of each row's mean, rows without scores aside."""
    scored = rows.withColumn("_mean", map_mean("field_confidence")).groupBy("rep_id")
    found = scored.agg(
        F.count("*").alias("observations"),
        count_where(F.col("status") == "needs_clarification").alias("flagged"),
        half_even(F.avg("_mean"), 3).alias("avg_confidence"),
    )
    distinct = count_distinct_values(rows, ["rep_id"], {"clip_id": "clip_count", "outlet_id": "outlet_count"}).withColumnRenamed("rep_id", "_rep")
    joined = found.join(distinct, F.col("rep_id").eqNullSafe(F.col("_rep")))
    return joined.select("rep_id", "observations", "clip_count", "outlet_count", "flagged", "avg_confidence").orderBy(F.desc("observations"), "rep_id")


def type_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type", "severity").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type", "severity")


def trend(observations: DataFrame, company: str, as_of: str, days: int = 14) -> DataFrame:
    """Per UTC day of the ``days`` that end at ``as_of``, days without rows as zeros."""
    spine = observations.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).alias("day"))
    first, end = (F.date_add(F.lit(as_of).cast("date"), d).cast("timestamp") for d in (1 - days, 1))
    rows = scoped(observations, company, "1970-01-01", "9999-01-01").filter((F.col("recorded_at") >= first) & (F.col("recorded_at") < end)).groupBy(F.to_date("recorded_at").alias("day"))
    counts = rows.agg(F.count("*").alias("observations"), count_where(F.col("status") == "needs_clarification").alias("flagged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), zero("observations"), zero("flagged"))


def confidence_bands(rows: DataFrame) -> DataFrame:
    """Rows by band of their mean confidence; null and out-of-range means are 'other'; no empty bands."""
    mean = map_mean("field_confidence")
    band = F.lit("other")
    for low, high in zip(BANDS, (*BANDS[1:], BANDS_END), strict=True):
        band = F.when((mean >= low) & (mean < high), f"{low:.1f}").otherwise(band)
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("count")).orderBy("band")


def processed(clips: DataFrame, company: str, start: str, end: str) -> DataFrame:
    return clips.filter((F.col("company_id") == company) & (F.col("status") == "processed") & F.col("recorded_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def clip_counts(clips: DataFrame) -> DataFrame:
    """A clip without a source counts as voice."""
    photo = F.col("source").eqNullSafe("photo")
    return clips.agg(F.count("*").alias("clips"), count_where(~photo).alias("voice"), count_where(photo).alias("photo"), count_where(F.col("simulated") & F.col("extractor").isNotNull()).alias("simulated"))


def extractor_counts(clips: DataFrame) -> DataFrame:
    """``simulated`` is that of a pair's first clip by time, then id."""
    found = clips.filter(F.col("extractor").isNotNull()).groupBy("extractor", "extractor_model")
    return found.agg(F.count("*").alias("clips"), F.min_by("simulated", F.struct("recorded_at", "clip_id")).alias("simulated")).orderBy(F.desc("clips"), "extractor", "extractor_model")


def first_llm(clips: DataFrame) -> DataFrame:
    return clips.filter(F.col("llm_model").isNotNull()).agg(F.min_by("llm_model", F.struct("recorded_at", "clip_id")).alias("llm_model"))


def extraction_confidence(clips: DataFrame) -> DataFrame:
    return clips.agg(half_up(F.avg("extraction_confidence"), 3).alias("extraction_confidence"))


def stage_latency(clips: DataFrame) -> DataFrame:
    """Per stage: rounded mean, and p95 as the value at place floor(0.95 n) of n sorted ones.

    Equal times are counted first, then times are summed by their whole part; only the part in which the
    place falls is ranked, so no window holds all times of a stage.
    """
    times = clips.select(F.explode("timings").alias("stage", "ms"))
    by_value = times.groupBy("stage", "ms").agg(F.count("*").alias("n")).withColumn("part", F.floor("ms"))
    parts = by_value.groupBy("stage", "part").agg(F.sum("n").alias("n"), F.sum(F.col("ms") * F.col("n")).alias("sum"))
    stage = Window.partitionBy("stage")
    upto = F.sum("n").over(stage.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumns({"upto": upto, "total": F.sum("n").over(stage), "mean": F.sum("sum").over(stage) / F.sum("n").over(stage)})
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.95))
    edge = parts.withColumn("place", place).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    edge = edge.select("stage", "part", "mean", "total", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))
    inside = by_value.join(edge, ["stage", "part"]).withColumn("upto", F.sum("n").over(stage.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.filter(F.col("upto") > F.col("place")).groupBy("stage", "mean", "total").agg(F.min("ms").alias("p95_ms"))
    return found.select("stage", half_up("mean").alias("avg_ms"), "p95_ms", F.col("total").alias("n")).orderBy("stage")


def pipeline_stats(clips: DataFrame) -> DataFrame:
    """One row: the counts, first model and mean extraction confidence of processed clips, and per extractor and stage arrays."""
    extractors = extractor_counts(clips).agg(F.array_sort(F.collect_list(F.struct(F.negative("clips").alias("order"), "extractor", "extractor_model", "clips", "simulated"))).alias("extractors"))
    stages = stage_latency(clips).agg(F.array_sort(F.collect_list(F.struct("stage", "avg_ms", "p95_ms", "n"))).alias("stages"))  # a row a stage
    extractors = extractors.select(F.transform("extractors", lambda x: x.dropFields("order")).alias("extractors"))
    parts = (first_llm(clips), extraction_confidence(clips), extractors, stages)  # a row and a column each
    return clip_counts(clips).select("*", *(x.scalar().alias(x.columns[0]) for x in parts))


def window_or_default(start: str, end: str, now: Column, days: int = 30) -> list[Column]:
    """(start_at, end_at) from two texts; both ends fall back together, to the ``days`` before ``now``, if one cannot be read."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    ok = a.isNotNull() & b.isNotNull()
    return [F.when(ok, a).otherwise(now - F.expr(f"interval {days} days")).alias("start_at"), F.when(ok, b).otherwise(now).alias("end_at")]


def feed(rows: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    """The latest rows, of a status if one is given; the limit is held between 1 and 500."""
    some = rows.filter(F.col("status") == status) if status else rows
    return some.orderBy(F.desc("recorded_at"), "observation_id").limit(max(1, min(500, limit)))


def pending_prompts(prompts: DataFrame, at: str, key: str, limit: int = 20) -> DataFrame:
    return prompts.orderBy(at, key).limit(limit)


def on_day(rows: DataFrame, day: str, at: str = "recorded_at") -> DataFrame:
    """Rows of one day of the session's time zone, as a range that a scan can skip by."""
    start = F.lit(day).cast("date")
    return rows.filter((F.col(at) >= start.cast("timestamp")) & (F.col(at) < F.date_add(start, 1).cast("timestamp")))


def day_counters(clips: DataFrame) -> DataFrame:
    """One row: clips, seconds and sent ones of (seconds, status)."""
    return clips.agg(F.count("*").alias("clips"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), count_where(F.col("status") == "sent").alias("sent"))


def trace_totals(clips: DataFrame) -> DataFrame:
    """clip_id, total_ms over the stages of ``timings``, flagged: rows of ``observations`` with flags."""
    total = F.aggregate(F.map_values("timings"), F.lit(0.0), lambda a, v: a + v)
    return clips.select("clip_id", total.alias("total_ms"), F.size(F.filter("observations", lambda o: F.size(o["flagged_fields"]) > 0)).alias("flagged"))
