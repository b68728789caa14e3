"""Model replies as a table: prompts are built from annotations, replies looked up by their digest, parsed and locked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assemble import FIELDS, OBSERVATION, identity_allowed, locked_numbers, vocabulary
from .quantities import shown

SCHEMA_NAME = "observations"
#: What every reply must hold, by the names that replies use; the numbers and identities may be null but not left out.
ENTRY = ", ".join(f"{name} {kind}" for name, kind in zip(FIELDS.values(), (c.split()[1] for c in OBSERVATION.split(", ")), strict=True))
# What a reply may say.
TYPES = ("competitor_promo", "demand_signal", "stock_out", "retailer_complaint", "price_change")
SEVERITIES = ("low", "medium", "high")


def _listed(lines: Column, none: str) -> Column:
    return F.when(F.size(lines) == 0, F.lit(f"  {none}")).otherwise(F.array_join(lines, "\n"))


def prompt(text: Column, outlet: Column, skus: Column, quantities: Column) -> Column:
    """What a model is asked about a clip: its text, what was recognised in it, and the values that it may choose.

    Equal texts with equal annotations have equal prompts; numbers are written as short as they can be.
    """
    words = vocabulary(outlet, skus)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    shops = F.transform(outlet["candidates"], lambda c: say("  ", c["outlet_id"], " | ", c["name"], " | ", shown(c["distance_m"]), " m | name ", shown(c["name_score"])))
    rival = lambda c: F.when(c["is_competitor"], "competitor").otherwise("own")
    alias = lambda c: F.when(c["via_alias"].isNotNull(), F.concat(F.lit(" | alias "), c["via_alias"])).otherwise("")
    product = lambda c: say("    ", c["sku_id"], " | ", c["name"], " | ", rival(c), " | ", shown(c["score"]), alias(c))
    goods = F.transform(skus, lambda m: say("  said: ", m["raw"], "\n", F.array_join(F.transform(m["candidates"], product), "\n")))
    amounts = F.transform(quantities, lambda q: say("  ", shown(q["value"]), F.when(q["unit"].isNull(), "").otherwise(F.concat(F.lit(" "), q["unit"])), " | ", q["basis"]))
    may = lambda name, values: say(f"  {name}: ", F.when(F.size(values) == 0, "null").otherwise(F.concat(F.array_join(values, ", "), F.lit(", null"))))
    declared = F.when(outlet["declared"], "  stated by the representative\n").otherwise("")
    parts = [
        F.lit("Transcript"), text, F.lit("Outlets near"), F.concat(declared, _listed(shops, "none")), F.lit("Products heard"), _listed(goods, "none"), F.lit("Numbers heard"), _listed(amounts, "none"),
        F.lit("May be chosen"), may("outletId", words["outlet_ids"]), may("skuId", words["sku_ids"]), may("competitorBrand", words["competitor_brands"]),
    ]
    return F.array_join(F.transform(F.array(*parts), lambda x: F.coalesce(x, F.lit(""))), "\n")


def reply_key(asked: Column, schema_name: str = SCHEMA_NAME) -> Column:
    """Under what a reply to a prompt is recorded."""
    return F.concat(F.lit(f"{schema_name}:"), F.substring(F.sha2(asked, 256), 1, 16))


def parsed_reply(raw: Column, words: Column) -> Column:
    """(entries, fault): the observations of a reply, or what is wrong with it; ``words`` is the clip's vocabulary.

    A reply counts whole or not at all: it must be JSON with a list of observations, each with every field, a known type and
    severity, a text, numbers that are numbers, and identities that the clip's own annotations offer. Other fields are passed over.
    """
    found = F.from_json(raw, f"observations array<struct<{ENTRY.replace(' ', ':')}>>, _corrupt string".replace(",:", ", "), {"columnNameOfCorruptRecord": "_corrupt"})
    names = F.from_json(raw, "observations array<map<string,string>>")["observations"]
    plain = F.transform(found["observations"], lambda o: F.struct(*(o[name].alias(c) for c, name in FIELDS.items())))
    lacking = F.exists(names, lambda m: m.isNull() | (F.size(F.array_intersect(F.map_keys(m), F.array(*map(F.lit, FIELDS.values())))) < len(FIELDS)))
    unknown = F.exists(plain, lambda o: F.coalesce(~(o["type"].isin(*TYPES) & o["severity"].isin(*SEVERITIES) & o["verbatim"].isNotNull()), F.lit(True)))
    fault = (
        F.when(F.try_parse_json(raw).isNull(), "the reply is not JSON")
        .when(found["observations"].isNull() | found["_corrupt"].isNotNull(), "the reply has no list of observations, or one of another kind")
        .when(lacking, "an observation lacks a field")
        .when(unknown, "an observation has an unknown type or severity, or no text")
        .when(F.exists(plain, lambda o: ~identity_allowed(o, words)), "an observation names what was not offered")
    )
    return F.struct(plain.alias("entries"), fault.alias("fault"))


def with_replies(clips: DataFrame, replies: DataFrame, schema_name: str = SCHEMA_NAME) -> DataFrame:
    """Annotated clips with key, entries (an array of observations) and error, from the recorded ``replies`` (key, raw).

    ``error`` says that no reply is recorded for the clip's prompt, or what is wrong with it; entries are then null. Of several
    replies to one prompt the least counts.
    """
    asked = clips.withColumn("key", reply_key(prompt(F.col("text"), F.col("outlet"), F.col("skus"), F.col("quantities")), schema_name))
    one = replies.groupBy("key").agg(F.min("raw").alias("raw"))
    rows = asked.join(one, "key", "left").withColumn("reply", parsed_reply(F.col("raw"), vocabulary(F.col("outlet"), F.col("skus"))))
    error = F.when(F.col("raw").isNull(), F.concat(F.lit("no reply is recorded for "), F.col("key"))).otherwise(F.col("reply.fault"))
    return rows.select(*clips.columns, "key", F.when(error.isNull(), F.col("reply.entries")).alias("entries"), error.alias("error"))


def assembled_from_replies(clips: DataFrame, replies: DataFrame, schema_name: str = SCHEMA_NAME) -> tuple[DataFrame, DataFrame]:
    """(observations, errors) of annotated clips, by ``with_replies``.

    Observations are (clip_id, place, observation, rejected): numbers that no quantity of the clip states have become null and are listed.
    Errors are (clip_id, key, error, retryable): a missing or faulty reply may pass when asked again. A clip whose reply
    holds no observation has no row in either.
    """
    rows = with_replies(clips, replies, schema_name)
    errors = rows.filter("error is not null").select("clip_id", "key", "error", F.lit(True).alias("retryable"))
    good = rows.select("clip_id", "quantities", F.posexplode("entries").alias("place", "entry"))
    done = good.select("clip_id", "place", locked_numbers(F.col("entry"), F.col("quantities")).alias("x"))
    return done.select("clip_id", "place", "x.observation", "x.rejected"), errors
