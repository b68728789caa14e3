"""Queries of single parts over the given tables: imports, projections, corrections, confidences, snapshots, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, text
from ..operators import assemble, clarify, evaluation, matching, state
from ..sources import bridge, imports
from . import capture
from .catalog import TRIM
from .registry import register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("s6_outlet_import", f"""with c as (select c_custkey as k, case when c_custkey % 11 = 0 then 'x' when c_custkey % 13 = 0 then '' else (c_custkey % 120 - 20)::varchar end as lat, case when c_custkey % 17 = 0 then null else (c_custkey % 400 - 100)::varchar end as lng from customer),
  p as (select *, try_cast(lat as double) as a, try_cast(lng as double) as b from c),
  r as (select *, case when a is null or b is null then '{imports.NOT_NUMBERS}' else array_to_string(list_filter([case when k % 7 = 0 then 'outletId: {imports.EMPTY_TEXT}' end, case when a < -90 then 'geo.lat: {imports.TOO_SMALL} -90' end, case when a > 90 then 'geo.lat: {imports.TOO_LARGE} 90' end,
    case when b < -180 then 'geo.lng: {imports.TOO_SMALL} -180' end, case when b > 180 then 'geo.lng: {imports.TOO_LARGE} 180' end], lambda x: x is not null), '; ') end as reason from p)
  select (k + 1)::int as row, case when reason = '' then a end as lat, case when reason = '' then b end as lng, nullif(reason, '') as reason from r""")
def _outlet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the rows of a file: places out of range, no numbers, blanks."""
    k = F.col("c_custkey")
    cells = _read(spark, sf_dir, "customer").select(
        (k + 1).cast("int").alias("row"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("O"), k)).alias("outletId"), F.col("c_name").alias("name"),
        F.when(k % 11 == 0, "x").when(k % 13 == 0, "").otherwise((k % 120 - 20).cast("string")).alias("lat"), F.when(k % 17 != 0, (k % 400 - 100).cast("string")).alias("lng"),
    )
    good, skipped = imports.outlet_rows(cells, capture.COMPANY)
    return good.select("row", "lat", "lng").unionByName(skipped, allowMissingColumns=True)


@register("s7_rep_import", """select s_suppkey as row, case when s_suppkey % 9 = 0 then null else array_to_string(list_filter([case when s_suppkey % 2 = 0 then 'Brand#' || s_suppkey % 25 end, case when s_suppkey % 3 = 0 then 'Lux' end], lambda x: x is not null), ',') end as portfolio, case when s_suppkey % 9 = 0 then null else s_suppkey % 5 <> 1 end as active, s_suppkey % 9 = 0 as skipped from supplier""")
def _rep_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    portfolio = F.concat(F.when(k % 2 == 0, F.concat(F.lit(" Brand#"), k % 25, F.lit(" ;"))).otherwise(";"), F.when(k % 3 == 0, "| Lux").otherwise(" "))
    cells = _read(spark, sf_dir, "supplier").select(k.alias("row"), F.concat(F.lit("R"), k).alias("repId"), F.when(k % 9 == 0, "").otherwise(F.col("s_name")).alias("name"), portfolio.alias("brandPortfolio"), F.when(k % 5 == 1, "no").when(k % 5 == 2, "YES").otherwise("").alias("active"))
    good, skipped = imports.rep_rows(cells, capture.COMPANY)
    good = good.select("row", F.array_join("brand_portfolio", ",").alias("portfolio"), "active", F.lit(False).alias("skipped"))
    return good.unionByName(skipped.select("row", F.lit(True).alias("skipped")), allowMissingColumns=True)


@register("k12_patch_reps", """with p as (select s_suppkey as k, s_suppkey % 4 = 0 and s_suppkey % 3 = 0 as hit from supplier) select k as rep, case when hit then 'T' || k % 5 else 'T0' end as territory_id, case when hit and k % 8 = 0 then false else true end as active, 'Lux' as portfolio from p""")
def _patch_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth rep is patched, but only tenant co0 may: a patch of another tenant's rep changes nothing."""
    k = F.col("rep")
    reps = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rep")).select("rep", F.concat(F.lit("co"), k % 3).alias("company_id"), F.concat(F.lit("R"), k).alias("rep_id"), F.lit("T0").alias("territory_id"), F.array(F.lit("Lux")).alias("brand_portfolio"), F.lit(True).alias("active"))
    patches = reps.filter(k % 4 == 0).select(F.lit("co0").alias("company_id"), "rep_id", F.concat(F.lit("T"), k % 5).alias("territory_id"), F.lit(None).cast("array<string>").alias("brand_portfolio"), F.when(k % 8 == 0, False).alias("active"))
    rows, _ = state.patch_reps(reps, patches)
    return rows.select("rep", "territory_id", "active", F.array_join("brand_portfolio", ",").alias("portfolio"))


@register("p4_without_secrets", "select c_custkey, c_name from customer")
def _without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.sha2("c_name", 256).alias("password_hash"), F.lit("t").alias("invite_token"), compat.geo_point(F.lit(1.0), F.lit(2.0)).alias("location"))
    return compat.without_secrets(rows)


@register("p5_public_prompts", capture.SURE + """ select event_id as clip_id, 0 as place, 'skuId' as field, 'কোন পণ্য?' as question, case when event_id % 5 = 0 then 'B' else 'A' end as current_value, 'pending' as status from g where s < 0.8::double""")
def _public_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = capture._annotated_events(spark, sf_dir)
    asked = clarify.public(clarify.clarifications(assemble.scored(observed, known), known, "2024-02-01 00:00:00"))
    return asked.drop("kind", "options", "expires_at")


@register("p6_geo_points", bridge.ctes("outlets") + "select outlet_id, 'Point' as type, lng as first, lat as second from outlets")
def _geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.table(spark, sf_dir, "outlets").select("outlet_id", compat.geo_point("lat", "lng").alias("g"))
    return rows.select("outlet_id", "g.type", F.col("g.coordinates")[0].alias("first"), F.col("g.coordinates")[1].alias("second"))


@register("p10_band_names", "select event_id, case event_id % 8 when 0 then '<50' when 5 then '50-60' when 6 then '60-70' when 7 then '70-80' when 3 then '90-100' when 4 then '80-90' else 'no band' end as band from events")
def _band_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    band = F.when(k == 0, "0.0").when(k == 3, "0.9").when(k == 4, "0.8").when(k > 4, F.concat(F.lit("0."), k)).otherwise("no band")
    return _read(spark, sf_dir, "events").select("event_id", compat.band_name(band).alias("band"))


@register("p12_corrections", """select event_id as clip_id, 5.0::double as quantity, 1.0::double as confidence, 'corrected' as status, false as flagged from events""")
def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = capture._annotated_events(spark, sf_dir)
    done = clarify.corrected(assemble.scored(observed, known), {"quantity": F.lit(5)})
    return done.select("clip_id", "observation.quantity", F.col("field_confidence")["quantity"].alias("confidence"), "status", F.array_contains("flagged_fields", "quantity").alias("flagged"))


@register("f15_to_learn", """with e as (select event_id, 0.6::double + (event_id % 5)::double / 10 as score, (event_id % 9)::double / 20 as margin from events where event_id % 7 <> 0) select 'x' as surface, 'A' as sku_id, event_id as clip_id from e where score < 0.75 or margin < 0.2""")
def _to_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = capture._annotated_events(spark, sf_dir)
    mentions = known.select(F.lit("co").alias("company_id"), "clip_id", F.col("clip_id").alias("at"), "skus")
    return clarify.to_learn(mentions).select("surface", "sku_id", "clip_id")


@register("f17_answers", "select event_id, event_id % 4 not in (1, 3) and event_id % 5 < 2 as may from events")
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt that timed out still takes an answer; the value must be one of those offered."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "answered", "auto_resolved", "cancelled"))), (k % 4 + 1).cast("int"))
    offered = F.array(*(F.struct(F.lit(v).alias("value"), F.lit("l").alias("label"), F.lit(0.5).alias("score")) for v in ("0", "1")))
    return _read(spark, sf_dir, "events").select("event_id", clarify.may_answer(status, offered, k % 5).alias("may"))


@register("a10_word_confidence", "with w as (select event_id // 8 as g, avg((event_id * 37 % 100)::double / 100) filter (event_id % 3 = 0) as mean from events group by 1) select g, round(mean, 9) as words, round(coalesce(mean, 0.75), 9) as segments from w")
def _word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a clip's words, null without any; of its segments, 0.75 without any."""
    k = F.col("event_id")
    words = F.collect_list(F.when(k % 3 == 0, F.struct((k * 37 % 100 / 100).alias("conf"))))
    rows = _read(spark, sf_dir, "events").groupBy(F.expr("event_id div 8").alias("g")).agg(words.alias("w"))
    return rows.select("g", F.round(compat.mean_confidence("w"), 9).alias("words"), F.round(compat.mean_confidence("w", 0.75), 9).alias("segments"))


@register("a11_error_rates", """with r as (select p_name, case p_partkey % 4 when 0 then 0.0 when 1 then 1.0 when 2 then 1.0 else 2.0 end::double / len(string_split(p_name, ' ')) as w from part) select count(*) as clips, (floor(avg(w) * 10000 + 0.5) / 10000)::double as wer from r""")
def _error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as heard: whole, with a word more, without the first, and with another first and a word more."""
    rest = F.concat_ws(" ", F.slice(F.split("p_name", " "), 2, 99))
    k = F.col("p_partkey") % 4
    heard = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" zz"))).when(k == 2, rest).otherwise(F.concat(F.lit("yy "), rest, F.lit(" zz")))
    return evaluation.error_rates(_read(spark, sf_dir, "part").select(F.col("p_name").alias("reference"), heard.alias("heard"))).select("clips", "wer")


SNAPSHOTS = "select strftime(ts, '%Y-%m-%d') as run_at, round(avg((event_id % 3 <> 0 and value < 60)::int), 4)::double as accuracy from events group by 1"


@register("w8_snapshot_deltas", f"with s as ({SNAPSHOTS}), d as (select *, accuracy - lag(accuracy) over (order by run_at) as accuracy_delta, lag(accuracy) over (order by run_at) as before from s) select run_at, round(accuracy_delta, 9) as accuracy_delta, coalesce(accuracy < before - 0.02::double, false) as regressed from d")
def _snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a day: how its accuracy changed, and whether it fell by more than two points."""
    hit = (F.col("event_id") % 3 != 0) & (F.col("value") < 60)
    runs = _read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_at")).agg(F.round(F.avg(hit.cast("int")), 4).alias("accuracy"))
    rows = evaluation.with_deltas(runs, "accuracy")
    return rows.select("run_at", F.round("accuracy_delta", 9).alias("accuracy_delta"), evaluation.regressed(F.col("accuracy"), F.col("accuracy") - F.col("accuracy_delta")).alias("regressed"))


@register("x2_strip_edges", f"select w as word, {TRIM} as core from (select distinct unnest(regexp_extract_all(text, '\\S+')) as w from benchmark)")
def _strip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", text.strip_edges("word").alias("core"))


@register("x3_token_runs", "select item_id, w[2] || ' ' || w[3] as run from (select item_id, string_split(text, ' ') as w from (select item_id, trim(regexp_replace(text, '[^a-z]+', ' ', 'g')) as text from benchmark)) where len(w) >= 3")
def _token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third token of a text, from their span; null where a text has fewer."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", "[^a-z]+", " ")).alias("t"))
    rows = rows.withColumn("span", text.span_of(text.tokens("t"), F.lit(1), F.lit(2))).filter("span is not null")
    return rows.select("item_id", F.col("t").substr(F.col("span.s") + 1, F.col("span.e") - F.col("span.s")).alias("run"))


@register("j18_directories", bridge.ctes("observations", "skus", "outlets") + """, r as (select 'REP-' || c_custkey as rep_id, 'co' || c_custkey % 3 as company_id, c_name as name from customer)
  select observation_id, coalesce(s.name, o.sku_id, '—') as sku, coalesce(t.name, o.outlet_id, '—') as outlet, coalesce(r.name, o.rep_id, '—') as rep from observations o
  left join skus s on s.sku_id = o.sku_id and s.company_id = o.company_id left join outlets t on t.outlet_id = o.outlet_id and t.company_id = o.company_id left join r on r.rep_id = o.rep_id and r.company_id = o.company_id""")
def _directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three maps of a dashboard: products, outlets, representatives."""
    reps = _read(spark, sf_dir, "customer").selectExpr("concat('REP-', c_custkey) as rep_id", "concat('co', c_custkey % 3) as company_id", "c_name as name")
    rows = matching.with_names(bridge.table(spark, sf_dir, "observations"), bridge.table(spark, sf_dir, "skus"), "sku_id", "name", "sku")
    rows = matching.with_names(rows, bridge.table(spark, sf_dir, "outlets"), "outlet_id", "name", "outlet")
    return matching.with_names(rows, reps, "rep_id", "name", "rep").select("observation_id", "sku", "outlet", "rep")


@register("f5_own_brands", bridge.ctes("skus") + "select company_id, sku_id from skus where active and not is_competitor and brand in ('Brand#11', 'Brand#22')")
def _own_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.scoped_skus(bridge.table(spark, sf_dir, "skus"), ["Brand#11", "Brand#22"], include_competitors=False).select("company_id", "sku_id")
