"""Questions about flagged fields, what answers and corrections do, and which spellings to learn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.keyed_table import KeyedTable
from .assemble import FIELDS
from .quantities import shown

# The fields that may be asked about, and what each question is about.
KINDS = {"outletId": "outlet", "skuId": "sku", "competitorBrand": "competitor_brand", "quantity": "quantity"}
# The wording of questions.
QUESTIONS = {"outlet": "কোন দোকান?", "sku": "কোন পণ্য?", "competitor_brand": "কোন কোম্পানির?", "quantity": "কতটা?"}
EITHER = "নাকি"


def _option(value: Column, label: Column, score: Column) -> Column:
    return F.struct(value.cast("string").alias("value"), label.alias("label"), score.alias("score"))


def options(field: str, observation: Column, outlet: Column, skus: Column, quantities: Column, most: int = 3) -> Column:
    """What may be chosen for a field: array of (value, label, score)."""
    if field == "outletId":
        return F.transform(F.slice(outlet["candidates"], 1, most), lambda c: _option(c["outlet_id"], c["name"], c["score"]))
    if field == "quantity":
        first = F.filter(quantities, lambda q, i: ~F.exists(F.slice(quantities, 1, i), lambda p: p["value"] == q["value"]))
        label = lambda q: F.concat_ws(" ", shown(q["value"]), q["unit"])
        return F.transform(F.slice(first, 1, most), lambda q: _option(shown(q["value"]), label(q), q["confidence"]))
    rival = field == "competitorBrand"
    current = observation["competitor_brand" if rival else "sku_id"]
    holding = F.get(F.filter(skus, lambda a: F.exists(a["candidates"], lambda c: c["sku_id"] == current)), F.lit(0))
    any_fit = F.get(F.filter(skus, lambda a: F.exists(a["candidates"], lambda c: c["is_competitor"] == rival)), F.lit(0))
    fitting = F.filter(F.coalesce(holding, any_fit)["candidates"], lambda c: c["is_competitor"] == rival)
    return F.transform(F.slice(fitting, 1, most), lambda c: _option(c["sku_id"], c["name"], c["score"]))


def question(field: str, choices: Column) -> Column:
    """Names both if there are exactly two outlets or quantities to choose between."""
    plain = F.lit(QUESTIONS[KINDS[field]])
    if field not in ("outletId", "quantity"):
        return plain
    both = F.concat(F.get(choices, F.lit(0))["label"], F.lit(f" {EITHER} "), F.get(choices, F.lit(1))["label"], F.lit("?"))
    return F.when(F.size(choices) == 2, both).otherwise(plain)


def clarifications(observations: DataFrame, clips: DataFrame, now: str, timeout_hours: int = 24, most: int = 3) -> DataFrame:
    """clip_id, place, field, kind, question, options, current_value, confidence, status, created_at, expires_at.

    One for each flagged field that may be asked about and has two options or more; all others stay flagged.
    """
    rows = observations.join(clips.select("clip_id", "outlet", "skus", "quantities"), "clip_id")
    columns = {name: column for column, name in FIELDS.items()}
    asked = []
    for field, kind in KINDS.items():
        choices = F.coalesce(options(field, F.col("observation"), F.col("outlet"), F.col("skus"), F.col("quantities"), most), F.array().cast("array<struct<value:string,label:string,score:double>>"))
        value = F.col("observation")[columns[field]]
        value = shown(value) if field == "quantity" else value.cast("string")
        prompt = F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), question(field, choices).alias("question"), choices.alias("options"), value.alias("current_value"), F.coalesce(F.col("field_confidence")[field], F.lit(0.0)).alias("confidence"))
        asked.append(F.when(F.array_contains("flagged_fields", field) & (F.size(choices) >= 2), prompt))
    rows = rows.select("clip_id", "place", F.explode(F.array_compact(F.array(*asked))).alias("p")).select("clip_id", "place", "p.*")
    created = F.lit(now).cast("timestamp")
    return rows.withColumns({"status": F.lit("pending"), "created_at": created, "expires_at": created + F.expr(f"interval {timeout_hours} hours")})


def prompt_id() -> Column:
    """One prompt for a field of an observation, however often it is built."""
    return F.substring(F.sha2(F.concat_ws("/", "clip_id", "place", "field"), 256), 1, 24)


def insert_prompts(table: KeyedTable, events: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of ``clarifications``: adds new prompts to a table keyed by prompt_id and arms their timers.

    A timer is armed by a ``create`` event (prompt_id, at, kind, value) in the folder that the stream of ``twins.prompts`` reads. A batch that
    runs again adds neither a prompt nor an event: prompts are known by their id, and a batch's events have one place.
    """

    def insert(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("prompt_id", prompt_id()).dropDuplicates(["prompt_id"]).persist()
        try:
            known = table.lookup(rows.select("prompt_id")).filter(F.col("batch") != number).select("prompt_id")
            new = rows.join(known, "prompt_id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
            made = new.select("prompt_id", F.col("created_at").alias("at"), F.lit("create").alias("kind"), F.lit(None).cast("string").alias("value"))
            table.insert(new, batch=("prompts", number))
            made.write.mode("overwrite").parquet(f"{events.rstrip('/')}/batch={number}")
        finally:
            rows.unpersist()

    return insert


def public(prompts: DataFrame) -> DataFrame:
    """What a client may see of a prompt."""
    return prompts.select("clip_id", "place", "field", "kind", "question", "options", "current_value", "status", "expires_at")


def may_answer(status: Column, choices: Column, value: Column) -> Column:
    """Whether a prompt still takes an answer, and the value is one of those offered."""
    return ~status.isin("answered", "cancelled") & F.exists(choices, lambda o: o["value"] == value.cast("string"))


def with_entry(m: Column, key: str, value: Column) -> Column:
    """A map with one entry set, whatever it held."""
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), value))


def settled(rows: DataFrame, field: str, value: Column | None, where: Column) -> DataFrame:
    """Observations in which a prompt about ``field`` is over: the flag goes, and the row is confirmed if no other is left.

    With a value (an answer, late or not) the field takes it, with confidence 1; without one (a timeout) the guess stays.
    """
    column = {name: column for column, name in FIELDS.items()}[field]
    left = F.when(where, F.array_remove("flagged_fields", field)).otherwise(F.col("flagged_fields"))
    out = rows.withColumns({"flagged_fields": left, "status": F.when(where, F.when(F.size(left) == 0, "confirmed").otherwise("needs_clarification")).otherwise(F.col("status"))})
    if value is None:
        return out
    changed = F.col("observation").withField(column, value.cast(rows.schema["observation"].dataType[column].dataType))
    sure = F.when(where, with_entry(F.col("field_confidence"), field, F.lit(1.0))).otherwise(F.col("field_confidence"))
    return out.withColumns({"observation": F.when(where, changed).otherwise(F.col("observation")), "field_confidence": sure})


def corrected(rows: DataFrame, patch: dict[str, Column]) -> DataFrame:
    """Observations after a correction by hand: patched fields are sure and not flagged; an empty patch only sets the status."""
    columns = {name: column for column, name in FIELDS.items()}
    out = rows
    for field, value in patch.items():
        kind = rows.schema["observation"].dataType[columns[field]].dataType
        out = out.withColumns({"observation": F.col("observation").withField(columns[field], value.cast(kind)), "field_confidence": with_entry(F.col("field_confidence"), field, F.lit(1.0)), "flagged_fields": F.array_remove("flagged_fields", field)})
    return out.withColumn("status", F.lit("corrected"))


def to_learn(mentions: DataFrame, min_score: float = 0.5, ambiguous_below: float = 0.2) -> DataFrame:
    """company_id, surface, sku_id, clip_id, at of the mentions whose spelling a person should judge: (company_id, clip_id, at, skus).

    Those that are weak or ambiguous, but not hopeless, not blank and not approved already.
    """
    rows = mentions.select("company_id", "clip_id", "at", F.explode("skus").alias("m")).withColumn("top", F.get("m.candidates", F.lit(0)))
    open_ = F.col("top.via_alias").isNull() & (F.col("top.score") >= min_score)
    unsure = (F.col("top.score") < min_score + 0.25) | (F.col("m.margin") < ambiguous_below)
    rows = rows.filter(F.col("top").isNotNull() & open_ & unsure & (F.trim("m.raw") != ""))
    return rows.select("company_id", F.trim("m.raw").alias("surface"), "top.sku_id", "clip_id", "at")


def reviewed(candidates: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with status and sku_id, approved aliases): reviews are (company_id, surface, verdict, sku_id).

    An approval takes the suggestion, or the review's own sku_id; a rejection gives no alias; others stay pending.
    Only the first review of a candidate counts, so reviews must have one row each.
    """
    keys = ["company_id", "surface"]
    r = reviews.select(*keys, "verdict", F.col("sku_id").alias("_other"))
    rows = candidates.join(r, keys, "left")
    approved = F.coalesce(F.col("verdict") == "approve", F.lit(False))
    status = F.when(approved, "approved").when(F.col("verdict") == "reject", "rejected").otherwise("pending")
    rows = rows.withColumns({"status": status, "sku_id": F.when(approved, F.coalesce("_other", "suggested"))}).drop("verdict", "_other")
    return rows, rows.filter("status = 'approved'").select("company_id", "sku_id", "surface")


def approval_queue(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Pending spellings, the most frequent first, then the latest seen."""
    return candidates.filter("status = 'pending'").orderBy(F.desc("occurrences"), F.desc("last_seen"), "company_id", "surface").limit(limit)
