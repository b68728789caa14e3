"""Small expressions whose rounding, null and empty rules differ from the nearest built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_with_null(c: ColumnLike) -> Column:
    """Number of distinct values, null counted as one of them."""
    c = col(c)
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))


def half_up(x: ColumnLike, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: halves go up, in binary arithmetic."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def half_even(x: ColumnLike, places: int = 0) -> Column:
    return F.bround(col(x), places)


def map_mean(m: ColumnLike) -> Column:
    """Mean of a map's values; null for an empty or null map."""
    values = F.map_values(col(m))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def card_confidence(m: ColumnLike) -> Column:
    """What a card shows of an observation's confidences: their mean, 0 without any."""
    return F.coalesce(map_mean(m), F.lit(0.0))


def clamp01(x: ColumnLike) -> Column:
    """Held between 0 and 1; NaN is 0, null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(col(x), F.lit(0.0)))))


#: White space at which texts are trimmed; that of trim() is the space alone.
BLANK = "\\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def is_blank(text: ColumnLike) -> Column:
    """Whether a text is empty or white space; null for null."""
    return ~col(text).rlike(f"[^{BLANK}]")


def trimmed(text: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "")


def split_list(c: ColumnLike) -> Column:
    """Parts of a cell between ``;`` or ``|``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def parse_bool(c: ColumnLike, fallback: bool = True) -> Column:
    """Blank: ``fallback``; 1, true, yes, y and active in any case: true; all else false."""
    word = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(word == "", F.lit(fallback)).otherwise(word.isin("1", "true", "yes", "y", "active"))


def stable_hash(*columns: str) -> Column:
    """sha-256 of the JSON object of the columns, keys sorted, nulls left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def confidence_tone(x: ColumnLike) -> Column:
    return F.when(col(x) >= 0.8, "high").when(col(x) >= 0.6, "mid").otherwise("low")


def price_text(delta: ColumnLike) -> Column:
    """A price movement in words: ৳5 less, ৳3 more."""
    size = F.regexp_replace(F.format_number(F.abs(col(delta)), 3), r"\.?0+$", "")
    return F.concat(F.lit("৳"), size, F.when(col(delta) < 0, " less").otherwise(" more"))


def geo_point(lat: ColumnLike, lng: ColumnLike) -> Column:
    """A GeoJSON point: longitude first."""
    return F.struct(F.lit("Point").alias("type"), F.array(col(lng), col(lat)).alias("coordinates"))


# Names of the confidence bands.
BAND_NAMES = {"0.0": "<50", "0.5": "50-60", "0.6": "60-70", "0.7": "70-80", "0.8": "80-90", "0.9": "90-100"}


def band_name(band: ColumnLike) -> Column:
    """A band of confidences as readers see it; other names stay."""
    out = col(band)
    for low, name in BAND_NAMES.items():
        out = F.when(col(band) == low, name).otherwise(out)
    return out


def mean_confidence(words: ColumnLike, without: float | None = None) -> Column:
    """Mean of ``conf`` in an array of words or segments; ``without`` (null by default) if there are none."""
    total = F.aggregate(col(words), F.lit(0.0), lambda a, w: a + w["conf"])
    return F.coalesce(F.try_divide(total, F.size(col(words))), F.lit(without).cast("double"))


def confidence_at(segments: ColumnLike, at: ColumnLike) -> Column:
    """Confidence of the first of (start, end, conf) that holds a time, both ends included; else the mean."""
    hit = F.get(F.filter(col(segments), lambda s: (s["start"] <= col(at)) & (col(at) <= s["end"])), F.lit(0))
    return F.coalesce(hit["conf"], mean_confidence(segments, 0.75))


def without_secrets(rows, *secrets: str):
    """A table without columns that no client may see."""
    return rows.drop(*(secrets or ("password_hash", "invite_token", "location")))
