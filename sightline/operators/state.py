"""Keyed state as batch folds: idempotent inserts, replacement, upserts, status, counters, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` and, for keys it lacks, the first incoming row by ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = incoming.join(existing.select(*keys), keys, "left_anti").withColumn("_place", first).filter("_place = 1").drop("_place")
    return existing.unionByName(fresh)


def replace_for_keys(existing: DataFrame, incoming: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of ``keys`` go, whatever is incoming stays in their place: processing twice changes nothing."""
    return existing.join(keys.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", last).filter("_place = 1").drop("_place")


def latest_status(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def surface_counts(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Per (company_id, surface) of (…, sku_id, clip_id, at): occurrences, latest suggestion, last clips in order.

    The sample comes from ranked rows, so that a frequent surface is never gathered whole.
    """
    late = Window.partitionBy("company_id", "surface").orderBy(F.desc("at"), F.desc("clip_id"))
    sample = rows.withColumn("_place", F.row_number().over(late)).filter(F.col("_place") <= samples).groupBy("company_id", "surface")
    sample = sample.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "clip_id"))), lambda x: x["clip_id"]).alias("sample_clips"))
    counts = rows.groupBy("company_id", "surface").agg(F.count("*").alias("occurrences"), F.max_by("sku_id", F.struct("at", "clip_id")).alias("suggested"))
    return counts.join(sample, ["company_id", "surface"])


def fold_prompts(events: DataFrame) -> DataFrame:
    """State of each prompt after its events (prompt_id, at, kind, value): create, timeout, answer, cancel.

    The first answer counts, even after a timeout (then it is late); one after a cancellation, or a
    second one, does not. A timeout settles a pending prompt and keeps its guess.
    """
    when = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    answer = F.min(F.when(F.col("kind") == "answer", F.struct("at", "value")))
    found = events.groupBy("prompt_id").agg(when("create").alias("created"), when("timeout").alias("timed_out"), when("cancel").alias("cancelled"), answer.alias("answer"))
    answered = F.col("answer").isNotNull() & (F.col("cancelled").isNull() | (F.col("answer.at") < F.col("cancelled")))
    timed = F.col("timed_out").isNotNull()
    cancelled = F.col("cancelled").isNotNull() & ~answered & (~timed | (F.col("cancelled") < F.col("timed_out")))
    status = F.when(answered, "answered").when(cancelled, "cancelled").when(timed, "auto_resolved").otherwise("pending")
    late = answered & timed & (F.col("answer.at") > F.col("timed_out"))
    return found.select("prompt_id", status.alias("status"), F.when(answered, F.col("answer.value")).alias("value"), F.coalesce(late, F.lit(False)).alias("late"))


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str], at: str = "updated_at") -> DataFrame:
    """Rows with the last patch of each field put in: patches are (key, field, value text, at); ``updated_at`` is the last patch's time."""
    last = patches.groupBy(key, "field").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    by_key = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_patch"), F.max("at").alias("_at"))  # one entry a field
    out = rows.join(by_key, key, "left")
    set_ = lambda c: F.when(F.map_contains_key(F.coalesce("_patch", F.create_map().cast("map<string,string>")), c), F.col("_patch")[c].cast(rows.schema[c].dataType)).otherwise(F.col(c))
    return out.select(*((set_(c) if c in fields else F.coalesce("_at", c) if c == at else F.col(c)).alias(c) for c in rows.columns))


def patch_reps(reps: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all reps, the patched ones after it): patches are (company_id, rep_id, territory_id, brand_portfolio, active), null for unchanged.

    A patch of another tenant's rep changes nothing. Reps must have one patch each.
    """
    keys, fields = ["company_id", "rep_id"], ["territory_id", "brand_portfolio", "active"]
    given = patches.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    both = reps.join(given, keys, "left")
    rows = both.select(*((F.coalesce(f"_{c}", c) if c in fields else F.col(c)).alias(c) for c in reps.columns), "_hit")
    return rows.drop("_hit"), rows.filter("_hit").drop("_hit")


def one_row(rows: DataFrame, **key: object) -> DataFrame:
    """The row with these values, or none: a point lookup."""
    for c, v in key.items():
        rows = rows.filter(F.col(c) == F.lit(v))
    return rows.limit(1)
