"""The library's text functions for SQL: temporary functions whose bodies are the expressions themselves."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

from . import bangla, text

#: Name, parameters, result, and the expression, made of calls alone, that is its body.
EXPRESSIONS = {
    "latin_key": ("w string", "string", lambda: text.latin_key("w")),
    "bangla_key": ("w string", "string", lambda: bangla.bangla_key("w")),
    "phonetic_key": ("w string", "string", lambda: bangla.phonetic_key("w")),
    "key_skeleton": ("w string", "string", lambda: text.skeleton("w")),
    "strip_edges": ("w string", "string", lambda: text.strip_edges("w")),
    "normal_word": ("w string", "string", lambda: bangla.normal_word("w")),
    "western_digits": ("w string", "string", lambda: bangla.western_digits("w")),
}
#: Those whose expressions hold operators, as SQL.
BODIES = {
    "half_up": ("x double, places int", "double", "floor(x * pow(10, places) + 0.5) / pow(10, places)"),
    "haversine_m": ("lat1 double, lng1 double, lat2 double, lng2 double", "double", f"2 * {text.EARTH_RADIUS_M!r}D * asin(least(1D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lng2) - radians(lng1)) / 2), 2))))"),
    "key_ratio": ("a string, b string", "double", "case when greatest(length(a), length(b)) = 0 then 1D else greatest(0D, 1 - levenshtein(a, b) / greatest(length(a), length(b))) end"),
    "confidence_tone": ("x double", "string", "case when x >= 0.8 then 'high' when x >= 0.6 then 'mid' else 'low' end"),
}


def _sql(expression: Column) -> str:
    return expression._jc.node().sql()


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    bodies = {name: (parameters, kind, _sql(make())) for name, (parameters, kind, make) in EXPRESSIONS.items()} | BODIES
    for name, (parameters, kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return sorted(bodies)
