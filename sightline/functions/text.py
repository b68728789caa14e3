"""Tokens with spans, phonetic keys of Latin script, similarities and distances, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compat import ColumnLike, col

# Punctuation trimmed from the edges of a token.
EDGE = "।,.;:!?\"'()\\[\\]{}—–\\-"
# Latin letter groups and what they sound like, in order of application.
LATIN_GROUPS = [("^wh", "hu"), ("ew", "iu"), ("ow", "o"), ("aw", "a"), ("ph", "p"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("sh", "s"), ("zh", "j"), ("ck", "k"), ("ee", "i"), ("oo", "u"), ("aa", "a"), ("ea", "i"), ("ou", "u"), ("c(?=[eiy])", "s"), ("e$", "")]
# Single Latin letters that sound like another.
LATIN_FROM, LATIN_TO = "qwvzfc", "kbbjpk"
# A token that states a pack size.
PACK_TOKEN = r"(?i)^\d+(ml|l|g|kg|gm|ltr|pcs)?$"
EARTH_RADIUS_M = 6_371_000.0


def tokens(text: ColumnLike) -> Column:
    """array of (text, s, e): runs between white space, edge punctuation trimmed, [s, e) in ``text``."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"\S+|\s+"), F.lit(0))
    empty = F.lit(None).cast("struct<at:int,found:array<struct<text:string,s:int,e:int>>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,s:int,e:int>>").alias("found"))

    def trimmed(piece: Column) -> Column:
        edged = piece.rlike(f"^[{EDGE}]|[{EDGE}]$")  # most are not, and need no more
        lead = F.when(edged, F.length(F.regexp_extract(piece, f"^([{EDGE}]*)", 1))).otherwise(0)
        core = F.when(piece.rlike(r"^\s"), "").when(edged, F.regexp_replace(F.regexp_replace(piece, f"^[{EDGE}]+", ""), f"[{EDGE}]+$", "")).otherwise(piece)
        return F.struct(F.length(piece).alias("size"), lead.alias("lead"), core.alias("core"))

    def add(state: Column, piece: Column) -> Column:
        begin = (state["at"] + piece["lead"]).cast("int")
        token = F.struct(piece["core"].alias("text"), begin.alias("s"), (begin + F.length(piece["core"])).cast("int").alias("e"))
        return F.struct((state["at"] + piece["size"]).cast("int").alias("at"), F.when(piece["core"] != "", F.array_append(state["found"], token)).otherwise(state["found"]).alias("found"))

    return F.coalesce(F.aggregate(F.transform(pieces, trimmed), start, add), empty)["found"]


def latin_key(word: ColumnLike) -> Column:
    """Phonetic key of a word in Latin script: groups, single letters, letters and digits only, runs collapsed."""
    return _sounds(F.trim(F.regexp_replace(col(word), "[​-‍﻿]", "")))


def latin_keys(lines: ColumnLike) -> Column:
    """The ``latin_key`` of each of many words, one a line and without white space, worked out together: that costs less than one by one."""
    return _sounds(F.regexp_replace(col(lines), "[​-‍﻿]", ""), start="(?<![^\n])", end="(?![^\n])", kept="\n")


def folded_keys(lines: ColumnLike) -> Column:
    """The ``latin_key`` of each of many phonetic keys, one a line: most have no letter but those that such keys are made of, and take fewer steps."""
    s = col(lines)
    for pattern, sound in LATIN_GROUPS:
        if not set(pattern) & set(LATIN_FROM):
            s = F.replace(s, F.lit(pattern), F.lit(sound)) if pattern.isalpha() else F.regexp_replace(s, pattern.replace("$", "(?![^\n])"), sound)
    return F.when(col(lines).rlike(f"[{LATIN_FROM}x]"), latin_keys(lines)).otherwise(F.regexp_replace(s, "(.)\\1+", "$1"))


def _sounds(s: Column, start: str = "^", end: str = "$", kept: str = "") -> Column:
    """Keys of the words of a string: patterns of where one starts and ends, and the character kept between them."""
    s = F.lower(s)
    for pattern, sound in LATIN_GROUPS:
        s = F.replace(s, F.lit(pattern), F.lit(sound)) if pattern.isalpha() else F.regexp_replace(s, pattern.replace("^", start).replace("$", end), sound)  # letters alone need no pattern, which costs more
    s = F.regexp_replace(F.translate(s, LATIN_FROM, LATIN_TO), "x", "ks")
    return F.regexp_replace(F.regexp_replace(s, f"[^a-z0-9{kept}]", ""), "(.)\\1+", "$1")


def skeleton(key: ColumnLike) -> Column:
    return F.translate(col(key), "aeiou", "")


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def key_similarity(a: ColumnLike, b: ColumnLike, bones_a: Column | None = None, bones_b: Column | None = None) -> Column:
    """Lenient similarity of two phonetic keys: the better of keys and 0.95 times skeletons, which may be given; 0 if one is empty."""
    a, b = col(a), col(b)
    bones_a, bones_b = (skeleton(k) if bones is None else bones for k, bones in ((a, bones_a), (b, bones_b)))
    full = ratio(a, b)
    bones = F.when((bones_a == "") | (bones_b == ""), full).otherwise(F.greatest(full, 0.95 * ratio(bones_a, bones_b)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(bones)


def haversine_m(lat1: ColumnLike, lng1: ColumnLike, lat2: ColumnLike, lng2: ColumnLike) -> Column:
    la, lo, lb, lp = (F.radians(col(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((lp - lo) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def proximity(distance_m: ColumnLike, radius_m: float) -> Column:
    """1 at the place, 0 at the radius and beyond; 0 without a radius."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - col(distance_m) / radius_m)) if radius_m > 0 else F.lit(0.0)


def strip_edges(word: ColumnLike) -> Column:
    """A word without punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(col(word), f"^[{EDGE}]+", ""), f"[{EDGE}]+$", "")


def span_of(found: ColumnLike, first: ColumnLike, last: ColumnLike) -> Column:
    """(s, e) of a run of tokens; null if either place is out of range."""
    a, b = F.get(col(found), col(first)), F.get(col(found), col(last))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a["s"].alias("s"), b["e"].alias("e")))


def transcript_words(text: ColumnLike, confidence: float = 0.9) -> Column:
    """array of (w, s, e, conf): the tokens of a text, all with one confidence."""
    return F.transform(tokens(text), lambda t: F.struct(t["text"].alias("w"), t["s"].alias("s"), t["e"].alias("e"), F.lit(confidence).alias("conf")))


def attach_spans(text: ColumnLike, words: ColumnLike) -> Column:
    """array of (w, s, e, conf): where each of (w, conf) stands in ``text``.

    A word is looked for behind the one before, then from the start; one that is nowhere is an empty span
    where the search stood. Empty words go.
    """
    text = col(text)
    kept = F.filter(F.transform(col(words), lambda x: F.struct(F.trim(x["w"]).alias("w"), x["conf"].alias("conf"))), lambda x: x["w"] != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<w:string,s:int,e:int,conf:double>>").alias("found"))

    def place(state: Column, x: Column) -> Column:
        ahead, anywhere = F.call_function("locate", x["w"], text, state["at"] + 1), F.call_function("locate", x["w"], text, F.lit(1))
        s = F.when(ahead > 0, ahead - 1).when(anywhere > 0, anywhere - 1).otherwise(state["at"]).cast("int")
        e = F.when((ahead > 0) | (anywhere > 0), s + F.length(x["w"])).otherwise(s).cast("int")
        return F.struct(e.alias("at"), F.array_append(state["found"], F.struct(x["w"].alias("w"), s.alias("s"), e.alias("e"), x["conf"].cast("double").alias("conf"))).alias("found"))

    return F.aggregate(kept, start, place)["found"]


def segment_confidence(log_probability: ColumnLike, no_speech: ColumnLike, compression: ColumnLike) -> Column:
    """Confidence of a recognised segment: 0.75 if unknown, halved where the text compresses suspiciously well; 4 places."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(F.exp(col(log_probability)), F.lit(0.0))))
    speech = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce(col(no_speech), F.lit(0.0))))
    packed = F.when(col(compression) > 2.4, 0.5).otherwise(1.0)
    return F.floor(F.when(col(log_probability).isNull(), 0.75).otherwise(sure * speech * packed) * 10000 + 0.5) / 10000


def phonetic_keys(text: ColumnLike, key) -> Column:
    """Keys of the words of a phrase, by ``key``; those without one go."""
    return F.filter(F.transform(F.split(col(text), r"\s+"), key), lambda k: k != "")
