"""Observations from the annotations of a clip, locks on what they may hold, and confidence per field.

A clip has (clip_id, text, words, outlet, skus, quantities): what the resolvers give and an array
of (s, e, value, unit, basis, confidence). An observation has (type, outlet_id, sku_id, competitor_brand, quantity,
unit, price_delta, severity, verbatim).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import clamp01, half_up, trimmed
from ..functions.text import transcript_words
from .matching import overlap_confidence

QUANTITY_EPSILON = 1e-6
# Names of an observation's fields, in order, as confidences and flags call them.
FIELDS = {"type": "type", "outlet_id": "outletId", "sku_id": "skuId", "competitor_brand": "competitorBrand", "quantity": "quantity", "unit": "unit", "price_delta": "priceDelta", "severity": "severity", "verbatim": "verbatimBn"}
CRITICAL = ("outlet_id", "sku_id", "quantity", "competitor_brand")
OBSERVATION = "type string, outlet_id string, sku_id string, competitor_brand string, quantity double, unit string, price_delta double, severity string, verbatim string"


def field_name(name: str) -> str:
    """outlet_id, outlet and outletId all mean outletId; likewise for skuId; other names in camel case."""
    head, *rest = name.split("_")
    camel = head + "".join(x[:1].upper() + x[1:] for x in rest)
    return {"sku": "skuId", "outlet": "outletId"}.get(camel, camel)


def annotated(clips: DataFrame, outlets: DataFrame, skus: DataFrame, quantities: DataFrame) -> DataFrame:
    """clips with outlet, skus and quantities (doc_id is the clip_id), each by clip_id; clips without quantities get none."""
    part = F.struct("s", "e", "value", "unit", "basis", "confidence")
    gathered = quantities.groupBy(F.col("doc_id").alias("clip_id")).agg(F.array_sort(F.collect_list(part)).alias("quantities"))
    none = F.array().cast("array<struct<s:int,e:int,value:double,unit:string,basis:string,confidence:double>>")
    joined = clips.join(outlets, "clip_id").join(skus, "clip_id").join(gathered, "clip_id", "left")
    return joined.withColumn("quantities", F.coalesce("quantities", none))


def vocabulary(outlet: Column, skus: Column) -> Column:
    """(outlet_ids, sku_ids, competitor_brands): what this clip's annotations offer, in first-seen order."""
    every = F.flatten(F.transform(skus, lambda a: a["candidates"]))
    ids = lambda which: F.array_distinct(F.transform(F.filter(every, which), lambda c: c["sku_id"]))
    return F.struct(
        F.transform(outlet["candidates"], lambda c: c["outlet_id"]).alias("outlet_ids"),
        ids(lambda c: ~c["is_competitor"]).alias("sku_ids"),
        ids(lambda c: c["is_competitor"]).alias("competitor_brands"),
    )


def identity_allowed(observation: Column, words: Column) -> Column:
    """Whether each identity is null or one that the vocabulary offers; an empty vocabulary allows only null."""
    pairs = (("outlet_id", "outlet_ids"), ("sku_id", "sku_ids"), ("competitor_brand", "competitor_brands"))
    allowed = F.lit(True)
    for field, offered in pairs:
        allowed = allowed & (observation[field].isNull() | F.array_contains(words[offered], observation[field]))
    return allowed


def spoken_number(value: Column, quantities: Column) -> Column:
    return F.exists(quantities, lambda q: F.abs(q["value"] - value) < QUANTITY_EPSILON)


def locked_numbers(observation: Column, quantities: Column) -> Column:
    """(observation, rejected): numbers that no quantity of the clip states become null, and a quantity takes its unit along.

    A price delta may have the other sign. ``rejected`` lists (field, value, reason).
    """
    bad_quantity = observation["quantity"].isNotNull() & ~spoken_number(observation["quantity"], quantities)
    bad_price = observation["price_delta"].isNotNull() & ~spoken_number(F.abs(observation["price_delta"]), quantities)
    clean = observation.withField("unit", F.when(~bad_quantity, observation["unit"]))
    clean = clean.withField("quantity", F.when(~bad_quantity, observation["quantity"])).withField("price_delta", F.when(~bad_price, observation["price_delta"]))
    rejected = lambda field, name: F.struct(F.lit(name).alias("field"), observation[field].alias("value"), F.lit("not present in parsed quantities").alias("reason"))
    listed = F.array_compact(F.array(F.when(bad_quantity, rejected("quantity", "quantity")), F.when(bad_price, rejected("price_delta", "priceDelta"))))
    return F.struct(clean.alias("observation"), listed.alias("rejected"))


def said(outlet: Column, skus: Column, quantities: Column, text: Column) -> Column:
    """array of observations that annotations amount to, without a model.

    The first own product is a demand signal with the first quantity that is not money; the first competitor is a
    promotion whose price delta is minus the first money; with neither, a text that is not blank is a complaint.
    """
    place = F.get(outlet["candidates"], F.lit(0))["outlet_id"]
    words = vocabulary(outlet, skus)
    own, rival = F.get(words["sku_ids"], F.lit(0)), F.get(words["competitor_brands"], F.lit(0))
    money = lambda q: q["unit"].eqNullSafe(F.lit("BDT"))
    goods = F.get(F.filter(quantities, lambda q: ~money(q)), F.lit(0))
    paid = F.get(F.filter(quantities, money), F.lit(0))
    text = trimmed(text)

    def row(kind: str, severity: str, **fields: Column) -> Column:
        given = {"type": F.lit(kind), "outlet_id": place, "severity": F.lit(severity), "verbatim": text, **fields}
        kinds = dict(x.split() for x in OBSERVATION.split(", "))
        return F.struct(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds))

    demand = F.when(own.isNotNull(), row("demand_signal", "medium", sku_id=own, quantity=goods["value"], unit=goods["unit"]))
    promo = F.when(rival.isNotNull(), row("competitor_promo", "high", competitor_brand=rival, price_delta=-paid["value"]))
    complaint = F.when(own.isNull() & rival.isNull() & (text != ""), row("retailer_complaint", "low"))
    return F.array_compact(F.array(demand, promo, complaint))


def assembled(clips: DataFrame) -> DataFrame:
    """clip_id, place, observation of annotated clips, as ``said`` makes them."""
    return clips.select("clip_id", F.posexplode(said(F.col("outlet"), F.col("skus"), F.col("quantities"), F.col("text"))).alias("place", "observation"))


def margin_factor(margin: Column, saturates_at: float = 0.3, floor: float = 0.55) -> Column:
    return floor + (1 - floor) * F.least(F.greatest(margin, F.lit(0.0)) / saturates_at, F.lit(1.0))


def with_confidences(rows: DataFrame, model_only: float = 0.9, saturates_at: float = 0.3, floor: float = 0.55) -> DataFrame:
    """Rows of (observation, words, outlet, skus, quantities) with ``sure``: each field's confidence, not yet rounded, null for null fields.

    What several fields need is a column of its own, so that it is worked out once. Where ``words`` are null, rows have a ``text`` whose words are
    equally sure, and those of a mention alone are looked at.
    """
    o, factor = F.col("observation"), lambda m: margin_factor(m, saturates_at, floor)
    mention = lambda value: F.get(F.filter("skus", lambda a: F.exists(a["candidates"], lambda c: c["sku_id"] == value)), F.lit(0))
    stated = lambda value: F.get(F.filter("quantities", lambda q: F.abs(q["value"] - F.abs(value)) < QUANTITY_EPSILON), F.lit(0))
    span = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    rows = rows.withColumns({"_own": mention(o["sku_id"]), "_rival": mention(o["competitor_brand"]), "_amount": stated(o["quantity"]), "_price": stated(o["price_delta"]), "_shop": span(F.col("outlet"))})
    chosen = lambda m, value: F.get(F.filter(F.col(m)["candidates"], lambda c: c["sku_id"] == value), F.lit(0))
    rows = rows.withColumns({"_own_pick": chosen("_own", o["sku_id"]), "_rival_pick": chosen("_rival", o["competitor_brand"])})


    def overlap(s: Column, e: Column) -> Column:
        whole = overlap_confidence(F.col("words"), s, e)
        return F.when(F.col("words").isNotNull(), whole).otherwise(overlap_confidence(transcript_words(F.col("text").substr(s + 1, e - s)), F.lit(0), e - s)) if "text" in rows.columns else whole

    heard = lambda m: F.when(F.col(m)["s"].isNotNull(), overlap(F.col(m)["s"], F.col(m)["e"]))
    rows = rows.withColumns({f"{m}_heard": heard(m) for m in ("_own", "_rival", "_amount", "_price", "_shop")})

    def product(m: str, value: Column) -> Column:
        asr, pick = F.col(f"{m}_heard"), F.col(f"{m}_pick")
        rank = F.when(F.get(F.col(m)["candidates"], F.lit(0))["sku_id"] == value, 1.0).otherwise(0.85)
        by_score = clamp01(asr * factor(F.col(m)["margin"]) * pick["score"] * rank)
        return F.when(F.col(m).isNull(), 0.0).when(pick["via_alias"].isNotNull(), clamp01(asr * 0.95 + 0.05)).otherwise(by_score)

    def number(m: str) -> Column:
        return F.when(F.col(m).isNull(), 0.0).otherwise(clamp01(F.col(f"{m}_heard") * F.col(m)["confidence"]))

    top = F.get("outlet.candidates", F.lit(0))
    inferred = F.when(F.col("outlet.s").isNull(), top["score"]).otherwise(F.col("_shop_heard"))
    place = F.when(F.col("outlet.declared"), 1.0).when(F.size("outlet.candidates") == 0, 0.0).otherwise(clamp01(inferred * factor(F.col("outlet.margin"))))
    rows = rows.withColumns({"_outlet_id": place, "_sku_id": product("_own", o["sku_id"]), "_competitor_brand": product("_rival", o["competitor_brand"]), "_quantity": number("_amount"), "_price_delta": number("_price")})
    found = {c: F.lit(model_only) for c in FIELDS} | {c: F.col(f"_{c}") for c in ("outlet_id", "sku_id", "competitor_brand", "quantity", "price_delta")}
    found["unit"] = F.when(o["quantity"].isNull(), model_only).otherwise(F.col("_quantity"))
    return rows.withColumn("sure", F.struct(*(F.when(o[c].isNotNull(), x).alias(c) for c, x in found.items())))


def scored(observations: DataFrame, clips: DataFrame, threshold: float = 0.8, critical: tuple[str, ...] = CRITICAL, **options) -> DataFrame:
    """clip_id, place, observation, field_confidence (map), flagged_fields, status of (clip_id, place, observation).

    Null fields have no confidence. A critical field below ``threshold``, before rounding, is flagged, and
    a row with flags needs clarification; nothing is dropped.
    """
    rows = observations.join(clips.select("clip_id", "words", "outlet", "skus", "quantities"), "clip_id")
    return flagged(rows, ["clip_id", "place", "observation"], threshold, critical, **options)


def flagged(rows: DataFrame, keep: list[str], threshold: float = 0.8, critical: tuple[str, ...] = CRITICAL, **options) -> DataFrame:
    """``keep`` columns, field_confidence, flagged_fields, status of rows that hold an observation and its clip's words and annotations."""
    watched = {field_name(c) for c in critical}
    rows = with_confidences(rows, **options).select(*keep, "sure")
    entries = F.array(*(F.struct(F.lit(name).alias("key"), F.col("sure")[c].alias("value")) for c, name in FIELDS.items()))
    rows = rows.withColumn("entries", F.filter(entries, lambda x: x["value"].isNotNull()))
    rounded = F.map_from_entries(F.transform("entries", lambda x: F.struct(x["key"].alias("key"), half_up(x["value"], 4).alias("value"))))
    low = F.transform(F.filter("entries", lambda x: x["key"].isin(*watched) & (x["value"] < threshold)), lambda x: x["key"])
    status = F.when(F.size("flagged_fields") > 0, "needs_clarification").otherwise("confirmed")
    return rows.select(*keep, rounded.alias("field_confidence"), low.alias("flagged_fields")).withColumn("status", status)


def valid_observation(observation: Column) -> Column:
    """Whether an observation holds to its contract: a known type and severity, a text, and finite numbers."""
    types = ("competitor_promo", "demand_signal", "stock_out", "retailer_complaint", "price_change")
    finite = lambda x: x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))
    known = observation["type"].isin(*types) & observation["severity"].isin("low", "medium", "high")
    return F.coalesce(known & observation["verbatim"].isNotNull() & finite(observation["quantity"]) & finite(observation["price_delta"]), F.lit(False))
