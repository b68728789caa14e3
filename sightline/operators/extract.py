"""The whole way from transcripts to observations as one dataflow, with errors as values of rows.

A clip that fails at a stage keeps its row, with the stage and the error, and takes no further part; all other
clips go on. Annotations of a clip are worked out once and carried along, so nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.compat import is_blank
from ..functions.text import transcript_words
from ..sources.scratch import written
from .assemble import annotated, flagged, locked_numbers, said, valid_observation
from .heard import with_rows
from .quantities import quantities
from .replies import with_replies
from .resolve import resolve_outlets, resolve_products

STAGES = ["01-transcribe", "05-assemble", "06-confidence"]
CLIP = ["clip_id", "company_id", "text", "words", "brands", "lat", "lng", "declared_outlet_id"]


def _fault(stage: str, message: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), message.alias("message"), F.lit(True).alias("retryable"))


def transcribed(clips: DataFrame, spelt: bool = True) -> DataFrame:
    """Clips with ``fault``: a transcript that is missing or blank, which another attempt may mend; ``words`` of equal confidence where a clip has none, null unless they are to be ``spelt``."""
    words = transcript_words("text")
    rows = clips if "words" in clips.columns else clips.withColumn("words", words if spelt else F.when(F.lit(False), words))
    message = F.when(F.col("text").isNull(), "there is no transcript").when(is_blank("text"), "the transcript is blank")
    return rows.select(*CLIP, F.when(message.isNotNull(), _fault(STAGES[0], message)).alias("fault"))


def extract(clips: DataFrame, skus: DataFrame, aliases: DataFrame, outlets: DataFrame, replies: DataFrame | None = None, threshold: float = 0.8, seen: Observation | None = None) -> DataFrame:
    """clip_id, company_id, status, fault, n_products, n_quantities, n_outlets, observations: a row for each clip.

    Clips have (clip_id, company_id, text, brands, lat, lng, declared_outlet_id), and may have words. ``fault`` is (stage, message,
    retryable), null for a processed clip; a failed one has no observations. ``observations`` is an array of (place, observation,
    field_confidence, flagged_fields, status, rejected). With ``replies`` a model's recorded replies say what was observed, else
    rules do. ``seen`` gets how many clips there were and how many failed, as the rows are made; clip_id must be unique.
    """
    heard = transcribed(clips, spelt=False)
    good, texts = with_rows(heard.filter("fault is null").drop("fault"))
    good = written(good)
    # each is written, for one plan of all of them takes the driver much memory, and is planned anew as each of its stages ends
    found = resolve_outlets(good, outlets, heard=texts), resolve_products(good, skus, aliases, heard=texts), quantities(good.select(F.col("clip_id").alias("doc_id"), "row"), texts)
    known = annotated(good.drop("row"), *map(written, found))
    if replies is None:
        rows = known.withColumns({"entries": said(F.col("outlet"), F.col("skus"), F.col("quantities"), F.col("text")), "error": F.lit(None).cast("string")})
    else:
        rows = with_replies(known, replies)
    counts = {"n_products": F.size("skus"), "n_quantities": F.size("quantities"), "n_outlets": F.col("outlet.gps_candidates")}
    rows = rows.withColumns(counts).select("*", F.posexplode_outer("entries").alias("place", "entry"))
    rows = rows.withColumn("locked", locked_numbers(F.col("entry"), F.col("quantities"))).withColumns({"observation": F.when(F.col("entry").isNotNull(), F.col("locked.observation")), "rejected": F.col("locked.rejected")})
    keep = ["clip_id", "company_id", "error", *counts, "place", "observation", "rejected"]
    done = flagged(rows, keep, threshold)
    whole = F.struct("place", "observation", "field_confidence", "flagged_fields", "status", "rejected")
    made = done.groupBy("clip_id", "company_id", "error", *counts).agg(
        F.collect_list(F.when(F.col("observation").isNotNull(), whole)).alias("made"),
        F.max(F.col("observation").isNotNull() & ~valid_observation(F.col("observation"))).alias("broken"),
    )
    late = F.when(F.col("error").isNotNull(), _fault(STAGES[1], F.col("error"))).when(F.col("broken"), _fault(STAGES[2], F.lit("an observation breaks its contract")))
    in_place = F.array_sort("made", lambda a, b: a["place"] - b["place"])
    made = made.select("clip_id", late.alias("late"), *counts, F.when(late.isNull(), in_place).alias("observations"))
    out = heard.select("clip_id", "company_id", "fault").join(made, "clip_id", "left")
    fault = F.coalesce("fault", "late")
    out = out.select("clip_id", "company_id", F.when(fault.isNull(), "processed").otherwise("failed").alias("status"), fault.alias("fault"), *counts, F.coalesce("observations", F.array().cast(made.schema["observations"].dataType)).alias("observations"))
    if seen is not None:
        out = out.observe(seen, F.count("*").alias("clips"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.size("observations")).alias("observations"))
    return out


def stage_counts(extracted: DataFrame) -> DataFrame:
    """stage, entered, failed: how many clips came to each stage and failed there, in order; stages that none came to as well."""
    failed = lambda stage: F.count_if(F.col("fault.stage") == stage)
    sums = extracted.agg(F.count("*").alias("clips"), *(failed(s).alias(s) for s in STAGES))
    before = lambda k: sum((F.col(f"`{s}`") for s in STAGES[:k]), F.lit(0))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), (F.col("clips") - before(k)).cast("long").alias("entered"), F.col(f"`{s}`").alias("failed")) for k, s in enumerate(STAGES)))
    return sums.select(F.inline(rows))


def observations_of(extracted: DataFrame) -> DataFrame:
    """A row for each observation, ready to replace the clip's stored ones."""
    return extracted.select("clip_id", "company_id", F.inline("observations"))
