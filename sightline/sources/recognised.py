"""Replies of speech recognisers, landed as JSON: transcripts whose words have spans and confidences.

A word's span and its segment are found by one pass over the sorted reply, so a long reply costs
no more for each word than a short one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import clamp01, mean_confidence, trimmed
from ..functions.text import segment_confidence

HOSTED = "text string, language string, duration double, segments array<struct<start:double,end:double,avg_logprob:double,no_speech_prob:double,compression_ratio:double>>, words array<struct<word:string,start:double,end:double>>"
LOCAL = "transcription array<struct<text:string,offsets:struct<from:double,to:double>,tokens:array<struct<p:double>>>>"
#: Confidence where nothing is known of a segment.
UNKNOWN = 0.75


def word_spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """[s, e) of each word: behind the one before, else from the start; an empty span where the search stood if it is nowhere."""
    at, found, missing = 0, [], set()
    for w in words:
        s = -1 if w in missing else text.find(w, at)
        if s < 0 and w not in missing:
            s = text.find(w)
            if s < 0:
                missing.add(w)
        if s >= 0:
            at = s + len(w)
        found.append((s, at) if s >= 0 else (at, at))
    return found


def first_holding(times: list[float], starts: list[float], ends: list[float]) -> list[int]:
    """For each time the first segment, as given, that holds it, both ends included; -1 for none.

    Times and segments are swept in order of time, with the segments that have begun in a heap by place.
    """
    begun: list[tuple[int, float]] = []
    by_start = sorted(range(len(starts)), key=starts.__getitem__)
    out, k = [-1] * len(times), 0
    for i in sorted(range(len(times)), key=times.__getitem__):
        while k < len(by_start) and starts[by_start[k]] <= times[i]:
            heapq.heappush(begun, (by_start[k], ends[by_start[k]]))
            k += 1
        while begun and begun[0][1] < times[i]:  # over for all later times too
            heapq.heappop(begun)
        if begun:
            out[i] = begun[0][0]
    return out


def _lists(of_rows: list[list], values: pa.Array) -> pa.ListArray:
    """Flat values as lists, one a row, as long as the rows' own."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of_rows)]), pa.int32()), values)


def _spans(text: Column, words: Column) -> Column:
    def spans(texts: pa.Array, words: pa.Array) -> pa.Array:
        # two numbers a word: an object a word would be some hundred times the batch
        found = [np.array(word_spans(t.as_py(), w.as_py()), np.int32).reshape(-1, 2) for t, w in zip(texts, words, strict=True)]
        flat = np.concatenate([np.empty((0, 2), np.int32), *found])
        return _lists(found, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["s", "e"]))

    return F.arrow_udf(spans, "array<struct<s:int,e:int>>")(text, words)


def _segments_of(times: Column, starts: Column, ends: Column) -> Column:
    def found(times: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        of = [np.array(first_holding(t.as_py(), a.as_py(), b.as_py()), np.int32) for t, a, b in zip(times, starts, ends, strict=True)]
        return _lists(of, pa.array(np.concatenate([np.empty(0, np.int32), *of])))

    return F.arrow_udf(found, "array<int>")(times, starts, ends)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_words(rows: DataFrame, **more: Column) -> DataFrame:
    """clip_id, text, words (w, s, e, conf, start, end), ... of rows with text and bare (w, conf, start, end)."""
    rows = rows.withColumn("bare", F.filter("bare", lambda x: x["w"] != "")).withColumn("spans", _spans(F.col("text"), F.transform("bare", lambda x: x["w"])))
    word = lambda x, span: F.struct(x["w"].alias("w"), span["s"].alias("s"), span["e"].alias("e"), x["conf"].alias("conf"), x["start"].alias("start"), x["end"].alias("end"))
    return rows.select("clip_id", "text", F.zip_with("bare", "spans", word).alias("words"), *(c.alias(name) for name, c in more.items()))


def hosted_transcripts(replies: DataFrame, language: str = "bn") -> tuple[DataFrame, DataFrame]:
    """(transcripts, errors) of replies (clip_id, raw) of a service that gives segments with probabilities, and words.

    A word has the confidence of the first segment that holds its start, or the mean of all segments, 0.75 without any;
    without words the text's own are taken, each with that mean. Transcripts are (clip_id, text, words, language, duration_sec,
    confidence_derived); errors are (clip_id, error) of null replies and those that are not JSON objects.
    """
    rows = replies.withColumn("r", F.from_json("raw", HOSTED))
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    errors = rows.filter(bad).select("clip_id", F.lit("the reply is not a JSON object").alias("error"))
    part = lambda s: F.struct(F.coalesce(s["start"], F.lit(0.0)).alias("start"), F.coalesce(s["end"], F.lit(0.0)).alias("end"), segment_confidence(s["avg_logprob"], s["no_speech_prob"], s["compression_ratio"]).alias("conf"))
    rows = rows.filter(~bad).select("clip_id", trimmed(F.coalesce("r.text", F.lit(""))).alias("text"), F.transform(F.coalesce("r.segments", _empty("struct<start:double,end:double,avg_logprob:double,no_speech_prob:double,compression_ratio:double>")), part).alias("segments"), "r.words", "r.language", "r.duration")
    rows = rows.withColumn("mean", mean_confidence("segments", UNKNOWN))
    timed = F.filter(F.transform("words", lambda w: F.struct(trimmed(F.coalesce(w["word"], F.lit(""))).alias("w"), F.coalesce(w["start"], F.lit(0.0)).alias("start"), F.coalesce(w["end"], F.lit(0.0)).alias("end"))), lambda w: w["w"] != "")
    rows = rows.withColumn("timed", F.coalesce(timed, _empty("struct<w:string,start:double,end:double>")))
    rows = rows.withColumn("of", _segments_of(F.transform("timed", lambda w: w["start"]), F.transform("segments", lambda s: s["start"]), F.transform("segments", lambda s: s["end"])))
    conf = lambda k: F.when(k < 0, F.col("mean")).otherwise(F.get("segments", k)["conf"])
    heard = F.zip_with("timed", "of", lambda w, k: F.struct(w["w"].alias("w"), conf(k).alias("conf"), w["start"].alias("start"), w["end"].alias("end")))
    plain = F.transform(F.split("text", r"\s+"), lambda w: F.struct(w.alias("w"), F.col("mean").alias("conf"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end")))
    rows = rows.withColumn("bare", F.when(F.size("timed") > 0, heard).otherwise(plain))
    done = _with_words(rows, language=F.coalesce("language", F.lit(language)), duration_sec=F.col("duration"), confidence_derived=F.lit(True))
    return done, errors


def local_transcripts(replies: DataFrame, language: str = "bn") -> tuple[DataFrame, DataFrame]:
    """(transcripts, errors) of replies (clip_id, raw) of a recogniser that gives segments with the probability of each token.

    Every word of a segment has the mean of its tokens' probabilities, 0.75 without any; times are in milliseconds. Columns as of ``hosted_transcripts``.
    """
    rows = replies.withColumn("r", F.from_json("raw", LOCAL))
    bad = F.col("r.transcription").isNull()
    errors = rows.filter(bad).select("clip_id", F.lit("the reply has no list of segments").alias("error"))
    rows = rows.filter(~bad).select("clip_id", F.col("r.transcription").alias("segments"))
    text = F.array_join(F.filter(F.transform("segments", lambda s: trimmed(F.coalesce(s["text"], F.lit("")))), lambda t: t != ""), " ")
    seconds = lambda s, end: F.coalesce(s["offsets"][end], F.lit(0.0)) / 1000
    sure = lambda s: clamp01(mean_confidence(F.transform(F.filter(s["tokens"], lambda t: t["p"].isNotNull()), lambda t: F.struct(t["p"].alias("conf"))), UNKNOWN))
    of_segment = lambda s: F.transform(F.split(F.coalesce(s["text"], F.lit("")), r"\s+"), lambda w: F.struct(w.alias("w"), sure(s).alias("conf"), seconds(s, "from").alias("start"), seconds(s, "to").alias("end")))
    last = F.nullif(F.try_element_at("segments", F.lit(-1))["offsets"]["to"], F.lit(0.0)) / 1000
    rows = rows.select("clip_id", text.alias("text"), F.flatten(F.transform("segments", of_segment)).alias("bare"), last.alias("last"))
    return _with_words(rows, language=F.lit(language), duration_sec=F.col("last"), confidence_derived=F.lit(False)), errors
