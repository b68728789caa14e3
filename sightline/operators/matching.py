"""Joins and rankings of field reports: scoping, catalogue, geography, spans, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import haversine_m
from ..sources.scratch import written

METRES_PER_DEGREE = 111_000.0


def scoped_skus(skus: DataFrame, brands: list[str], include_competitors: bool = True) -> DataFrame:
    """Active products: all of them without brands, else those of the brands and, if asked, competitors."""
    active = skus.filter("active")
    if not brands:
        return active if include_competitors else active.filter(~F.col("is_competitor"))
    own = F.col("brand").isin(brands)
    return active.filter(F.col("is_competitor") | own if include_competitors else own & ~F.col("is_competitor"))


def within_radius(points: DataFrame, outlets: DataFrame, radius_m: float) -> DataFrame:
    """points (point_id, company_id, lat, lng) with each active outlet of the tenant at most ``radius_m`` away.

    An equi-join on grid cells: an outlet stands in one cell, a point looks in nine, and cells are at
    least a radius wide everywhere but near the poles; the exact distance decides. ``distance_m``.
    A point near the 180th meridian looks on its other side too.
    """
    step = radius_m / METRES_PER_DEGREE
    row = lambda c: F.floor(F.col(c) / step)
    # longitude cells are as wide at the latitude row's far edge, so both sides agree on them
    wide = lambda r: F.greatest(F.cos(F.radians((F.abs(r) + 2) * step)), F.lit(0.01))
    placed = outlets.filter("active").withColumn("_row", row("lat"))
    placed = placed.withColumn("_cell", F.floor(F.col("lng") * wide(F.col("_row")) / step))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    looking = points.withColumn("_row", F.explode(F.transform(near, lambda d: row("lat") + d)))
    edge = 2 * step / wide(F.col("_row"))
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lng") > 180 - edge, -360.0), F.when(F.col("lng") < edge - 180, 360.0)))
    cell = lambda turn: F.floor((F.col("lng") + turn) * wide(F.col("_row")) / step)
    looking = looking.withColumn("_cell", F.explode(F.array_distinct(F.flatten(F.transform(turns, lambda t: F.transform(near, lambda d: cell(t) + d))))))
    o = placed.select("company_id", "_row", "_cell", "outlet_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    joined = meeting(looking, o, ["company_id", "_row", "_cell"], "point_id")
    found = joined.withColumn("distance_m", haversine_m("lat", "lng", "_lat", "_lng")).filter(F.col("distance_m") <= radius_m)
    return found.select("point_id", "company_id", "outlet_id", "distance_m")


#: Pairs that one task compares.
PAIRS = 2_000_000


def meeting(left: DataFrame, right: DataFrame, keys: list[str], by: str, most: int = PAIRS) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, dealt over tasks by the pairs that come of it: some ``most`` each, or fewer.

    Pairs grow faster than rows, so tasks dealt by rows would grow with them. A key of more pairs is cut: the side with more rows
    is dealt over the cuts (``left`` by its column ``by``, ``right`` by all columns), the other side is at each of them.
    """
    n, m = (side.groupBy(*keys).agg(F.count("*").alias(c)) for side, c in ((left, "_n"), (right, "_m")))
    met = n.join(m, keys).withColumn("_pairs", F.col("_n") * F.col("_m"))
    large = met.filter(F.col("_pairs") > most).select(*keys, F.ceil(F.col("_pairs") / most).cast("int").alias("_cuts"), (F.col("_n") >= F.col("_m")).alias("_dealt"))
    tasks = int((met.agg(F.sum("_pairs")).first()[0] or 0) / most)
    if tasks < 1:
        return left.join(right, keys)
    every = F.sequence(F.lit(0), F.col("_cuts") - 1)
    one = lambda *c: F.array(F.pmod(F.xxhash64(*c), F.col("_cuts")).cast("int"))
    cut = lambda side, here, c: side.join(F.broadcast(large), keys, "left").withColumn("_cut", F.explode(F.when(F.col("_cuts").isNull(), F.array(F.lit(0))).when(here, one(*c)).otherwise(every))).drop("_cuts", "_dealt").repartition(2 * tasks, *keys, "_cut")
    return cut(left, F.col("_dealt"), [by]).join(cut(right, ~F.col("_dealt"), right.columns), [*keys, "_cut"]).drop("_cut")


def nearest_outlets(points: DataFrame, outlets: DataFrame, radius_m: float, most: int) -> DataFrame:
    """point_id, outlet_id, distance_m, rank: of the outlets in reach the nearest first, then the least id.

    Points of one place see the same outlets, and outlets of one place are equally far. So places are compared, each with its
    ``most`` least outlets, and a crowded place costs no more than an empty one.
    """
    place = ["company_id", "lat", "lng"]
    few = ranked(outlets.filter("active").select(*place, "outlet_id", "active"), place, [F.col("outlet_id")], most).drop("rank")
    seen = written(points.select(*place).filter("lat is not null and lng is not null").distinct().withColumn("point_id", F.monotonically_increasing_id()))
    near = ranked(within_radius(seen, few, radius_m), ["point_id"], [F.col("distance_m"), F.col("outlet_id")], most)
    back = near.select(F.col("point_id").alias("_seen"), "outlet_id", "distance_m").join(seen.withColumnRenamed("point_id", "_seen"), "_seen")
    found = points.join(back, place).select("point_id", "outlet_id", "distance_m")
    return ranked(found, ["point_id"], [F.col("distance_m"), F.col("outlet_id")], most)


def with_portfolio(clips: DataFrame, reps: DataFrame, *fields: str) -> DataFrame:
    """Clips with fields of their representative, one row each; null where there is none, and then nothing is out of scope."""
    return clips.join(reps.select("rep_id", *fields), "rep_id", "left")


def known_products(rows: DataFrame, skus: DataFrame) -> DataFrame:
    """Rows (aliases, say) whose product is one of the given, of the same tenant."""
    return rows.join(skus, ["company_id", "sku_id"], "left_semi")


def unknown_products(rows: DataFrame, skus: DataFrame) -> DataFrame:
    """Rows whose product is none of the given, null among them."""
    return rows.join(skus, ["company_id", "sku_id"], "left_anti")


def last_values(rows: DataFrame, key: str, at: str, value: str, most: int) -> DataFrame:
    """key, values: the last ``most`` of each key, the earliest of them first; cut before they are gathered."""
    few = ranked(rows, [key], [F.desc(at), F.desc(value)], most)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias("values"))


def first_values(rows: DataFrame, key: str, at: str, value: str, most: int) -> DataFrame:
    """key, values: the first ``most`` different values of each key, in the order in which they were first seen; nulls are no values."""
    seen = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(at).alias("_first"))
    few = ranked(seen, [key], [F.col("_first")], most)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def margin(rows: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """Each key's best row and by how much it leads the second (which counts as 0 if there is none)."""
    few = ranked(rows, keys, [F.desc(score), *(F.col(t) for t in ties)], 2)  # cut before the shuffle
    led = few.withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(Window.partitionBy(*keys).orderBy("rank")), F.lit(0.0)))
    return led.filter("rank = 1").drop("rank")


def with_names(rows: DataFrame, directory: DataFrame, key: str, name: str, shown: str) -> DataFrame:
    """Rows with what a key is called, the key itself where the tenant's directory lacks it, and — for none."""
    names = directory.select("company_id", key, F.col(name).alias("_name"))
    return rows.join(names, ["company_id", key], "left").withColumn(shown, F.coalesce("_name", key, F.lit("—"))).drop("_name")


def token_ngrams(tokens: Column, longest: int) -> Column:
    """array of (at, words): all runs of 1 to ``longest`` tokens, by start, then length."""
    last = F.size(tokens)
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), last - i)), lambda n: F.struct(i.alias("at"), F.slice(tokens, i + 1, n).alias("words"))))
    return F.flatten(runs)


def greedy_spans(spans: Column) -> Column:
    """Non-overlapping spans of array (s, e, score): best score first, then longer, then earlier given; sorted by s."""
    numbered = F.transform(spans, lambda x, i: F.struct((-x["score"]).alias("a"), (x["s"] - x["e"]).alias("b"), i.alias("c"), x.alias("x")))
    best = F.transform(F.array_sort(numbered), lambda y: y["x"])
    none = F.filter(spans, lambda x: F.lit(False))
    kept = F.aggregate(best, none, lambda got, x: F.when(F.exists(got, lambda g: (g["s"] < x["e"]) & (x["s"] < g["e"])), got).otherwise(F.array_append(got, x)))
    return F.array_sort(kept)


def overlap_confidence(words: Column, s: Column, e: Column) -> Column:
    """Mean of word confidences weighed by overlap with [s, e): words are (s, e, conf).

    An empty span is 0; without overlap the mean of all words; without words 0.5.
    """
    start = F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("total"))

    def add(sums: Column, w: Column) -> Column:
        shared = F.greatest(F.lit(0), F.least(e, w["e"]) - F.greatest(s, w["s"]))
        return F.struct((sums["weight"] + shared).alias("weight"), (sums["total"] + shared * w["conf"]).alias("total"))

    heard = F.aggregate(words, start, add, lambda sums: F.when(sums["weight"] > 0, sums["total"] / F.nullif(sums["weight"], F.lit(0.0))))
    everything = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["conf"]) / F.nullif(F.size(words), F.lit(0))  # worked out only where nothing is shared
    return F.when(e <= s, 0.0).when(F.size(words) == 0, 0.5).otherwise(F.coalesce(heard, everything))
