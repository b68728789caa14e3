"""The library's registered queries over the bridged tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bangla, compat, text
from ..operators import analytics, evaluation, matching, quantities, state
from ..sources import bridge
from .registry import QUERIES, SQL  # noqa: F401
from .registry import register as _register
from .registry import values as _values

COMPANY, START, END, AS_OF = "co1", "2024-01-05 00:00:00", "2024-01-25 23:59:59", "2024-01-28"
NOWHERE = "no-such-company"

def _observations(spark: SparkSession, sf_dir: str, company: str = COMPANY) -> DataFrame:
    return analytics.scoped(bridge.table(spark, sf_dir, "observations"), company, START, END)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.processed(bridge.table(spark, sf_dir, "clips"), COMPANY, START, END)


OBS = bridge.ctes("observations") + f", scope as (select * from observations where company_id = '{COMPANY}' and status is distinct from 'discarded' and recorded_at between timestamp '{START}' and timestamp '{END}') "
CLIPS = bridge.ctes("clips") + f", scope as (select * from clips where company_id = '{COMPANY}' and status = 'processed' and recorded_at between timestamp '{START}' and timestamp '{END}') "
MEAN = "list_avg(list_filter([c_skuId, c_outletId, c_quantity], lambda x: x is not null))"


def _distinct(c: str) -> str:
    return f"(count(distinct {c}) + max(case when {c} is null then 1 else 0 end))"


SUMMARY = f"""select count(*) as observations, coalesce({_distinct('clip_id')}, 0) as clip_count, coalesce({_distinct('rep_id')}, 0) as active_reps,
  coalesce({_distinct('outlet_id')}, 0) as outlets_covered, count(*) filter (status = 'needs_clarification') as needs_clarification,
  count(*) filter (severity = 'high') as high_severity from scope"""

for _name, _operator, _sql in (
    ("a1_summary", analytics.summary, SUMMARY),
    ("a2_share_of_voice", analytics.share_of_voice, f"select competitor_brand, count(*) as mentions, {_distinct('outlet_id')} as outlet_count, count(*) filter (severity = 'high') as high_severity from scope where competitor_brand is not null group by 1"),
    ("a3_stock_outs", analytics.stock_outs, "select outlet_id, sku_id, count(*) as occurrences, max(recorded_at) as last_seen from scope where type = 'stock_out' group by 1, 2"),
    ("a4_price_erosion", analytics.price_erosion, f"select sku_id, competitor_brand, round_even(avg(price_delta), 2) as avg_delta, min(price_delta) as min_delta, count(*) as reports, {_distinct('outlet_id')} as outlet_count from scope where price_delta is not null group by 1, 2"),
    ("a5_rep_coverage", analytics.rep_coverage, f"select rep_id, count(*) as observations, {_distinct('clip_id')} as clip_count, {_distinct('outlet_id')} as outlet_count, count(*) filter (status = 'needs_clarification') as flagged, round_even(avg({MEAN}), 3) as avg_confidence from scope group by 1"),
    ("a6_type_breakdown", analytics.type_breakdown, "select type, severity, count(*) as count from scope group by 1, 2"),
    ("a8_confidence_bands", analytics.confidence_bands, f"""select case when m >= 0 and m < 0.5 then '0.0' when m < 0.6 then '0.5' when m < 0.7 then '0.6' when m < 0.8 then '0.7' when m < 0.9 then '0.8' when m < 1.01 then '0.9' else 'other' end as band, count(*) as count
      from (select {MEAN} as m from scope) group by 1"""),
):
    _register(_name, OBS + _sql)(lambda spark, sf_dir, f=_operator: f(_observations(spark, sf_dir)))

for _name, _operator, _sql in (
    ("a9a_clip_counts", analytics.clip_counts, "select count(*) as clips, count(*) filter (source is distinct from 'photo') as voice, count(*) filter (source = 'photo') as photo, count(*) filter (simulated and extractor is not null) as simulated from scope"),
    ("a9b_extractor_counts", analytics.extractor_counts, "select extractor, extractor_model, count(*) as clips, arg_min(simulated, (recorded_at, clip_id)) as simulated from scope where extractor is not null group by 1, 2"),
    ("a9c_llm_first", analytics.first_llm, "select arg_min(llm_model, (recorded_at, clip_id)) as llm_model from scope where llm_model is not null"),
    ("a9d_extraction_conf", analytics.extraction_confidence, "select floor(avg(extraction_confidence) * 1000 + 0.5) / 1000 as extraction_confidence from scope"),
    ("a9ef_stage_latency", analytics.stage_latency, """select stage, floor(avg(ms) + 0.5)::double as avg_ms, list_sort(list(ms))[least(count(*) - 1, floor(count(*) * 0.95)::bigint) + 1] as p95_ms, count(*) as n
      from (select 'transcribe' as stage, t_transcribe as ms from scope union all select 'assemble', t_assemble from scope) where ms is not null group by 1"""),
):
    _register(_name, CLIPS + _sql)(lambda spark, sf_dir, f=_operator: f(_clips(spark, sf_dir)))


@_register("a1_summary_empty", OBS.replace(COMPANY, NOWHERE) + SUMMARY)
def _summary_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(_observations(spark, sf_dir, NOWHERE))


@_register("a7_trend_gapfilled", bridge.ctes("observations") + f"""select cast(d as date)::varchar as day, count(o.observation_id) as observations, count(*) filter (o.status = 'needs_clarification') as flagged
  from (select unnest(generate_series(date '{AS_OF}' - 13, date '{AS_OF}', interval 1 day)) as d) s
  left join (select * from observations where company_id = '{COMPANY}' and status is distinct from 'discarded') o on cast(o.recorded_at as date) = cast(s.d as date) group by 1""")
def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trend(bridge.table(spark, sf_dir, "observations"), COMPANY, AS_OF)


@_register("f1_base_scope", OBS + "select observation_id, status from scope")
def _base_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("observation_id", "status")


@_register("f5_brand_scope", bridge.ctes("skus") + "select company_id, sku_id from skus where active and (is_competitor or brand in ('Brand#11', 'Brand#22', 'Brand#33'))")
def _brand_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.scoped_skus(bridge.table(spark, sf_dir, "skus"), ["Brand#11", "Brand#22", "Brand#33"]).select("company_id", "sku_id")


@_register("f7_default_window", f"""with v as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then 'not a time' when 2 then strftime(ts, '%Y-%m-%d') end as x, case when event_id % 4 < 2 then '2024-01-20' when event_id % 4 = 2 then '' end as y from events)
  select event_id, case when ok then a else timestamp '{AS_OF}' - interval 30 day end as start_at, case when ok then b else timestamp '{AS_OF}' end as end_at
  from (select event_id, try_cast(x as timestamp) as a, try_cast(y as timestamp) as b, try_cast(x as timestamp) is not null and try_cast(y as timestamp) is not null as ok from v)""")
def _default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends fall back together if one of them cannot be read: ranges from the days of events, a text, blanks and nulls."""
    k, day = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(k.isin(0, 2), day).when(k == 1, "not a time").alias("x"), F.when(k < 2, "2024-01-20").when(k == 2, "").alias("y"))
    return rows.select("event_id", *analytics.window_or_default("x", "y", F.lit(AS_OF).cast("timestamp")))


@_register("o2_recent_feed", OBS + "select observation_id, recorded_at from scope order by recorded_at desc, observation_id limit 100")
def _recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.feed(_observations(spark, sf_dir)).select("observation_id", "recorded_at")


@_register("o3_review_queue", OBS + "select observation_id, recorded_at from scope where status = 'needs_clarification' order by recorded_at desc, observation_id limit 50")
def _review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.feed(_observations(spark, sf_dir), 50, "needs_clarification").select("observation_id", "recorded_at")


@_register("o4_pending_prompts", OBS + "select observation_id, recorded_at from scope where status = 'needs_clarification' order by recorded_at, observation_id limit 20")
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pending_prompts(_observations(spark, sf_dir).filter("status = 'needs_clarification'"), "recorded_at", "observation_id").select("observation_id", "recorded_at")


@_register("p3_map_mean", OBS + f"select observation_id, round({MEAN}, 9) as mean from scope")
def _map_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("observation_id", F.round(compat.map_mean("field_confidence"), 9).alias("mean"))


@_register("p7_directory_join", bridge.ctes("observations", "skus") + "select o.observation_id, coalesce(s.name || ' ' || s.pack, o.sku_id, '—') as display from observations o left join skus s on o.sku_id = s.sku_id and o.company_id = s.company_id")
def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = bridge.table(spark, sf_dir, "skus").withColumn("shown", F.concat_ws(" ", "name", "pack"))
    return matching.with_names(bridge.table(spark, sf_dir, "observations"), skus, "sku_id", "shown", "display").select("observation_id", "display")


@_register("p9_confidence_tone", OBS + f"select observation_id, case when {MEAN} >= 0.8 then 'high' when {MEAN} >= 0.6 then 'mid' else 'low' end as tone from scope")
def _tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("observation_id", compat.confidence_tone(compat.map_mean("field_confidence")).alias("tone"))


REPS = "reps as (select concat('REP-', cast(c_custkey as string)) as rep_id, c_mktsegment as segment from customer)"


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.selectExpr("concat('REP-', cast(c_custkey as string)) as rep_id", "c_mktsegment as segment")


@_register("j1_clip_rep", bridge.ctes("clips") + f", {REPS} select clip_id, segment from clips left join reps using (rep_id)")
def _clip_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_portfolio(bridge.table(spark, sf_dir, "clips"), _reps(spark, sf_dir), "segment").select("clip_id", "segment")


@_register("j2_alias_semi", bridge.ctes("observations", "skus") + "select observation_id from observations o where exists (select 1 from skus s where s.active and s.sku_id = o.sku_id and s.company_id = o.company_id)")
def _alias_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = bridge.table(spark, sf_dir, "skus").filter("active")
    return matching.known_products(bridge.table(spark, sf_dir, "observations"), skus).select("observation_id")


@_register("j16_fk_antijoin", bridge.ctes("observations", "skus") + "select observation_id from observations o where not exists (select 1 from skus s where s.sku_id = o.sku_id and s.company_id = o.company_id)")
def _fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unknown_products(bridge.table(spark, sf_dir, "observations"), bridge.table(spark, sf_dir, "skus")).select("observation_id")


POINT = {"point_id": "s_suppkey", "company_id": "concat('co', cast(s_suppkey % 3 as string))", "lat": "23.78 + cast((s_suppkey * 53) % 400 as double) * 0.0001", "lng": "90.40 + cast((s_suppkey * 29) % 400 as double) * 0.0001"}
HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lng) - radians({a}.lng)) / 2), 2))))"
POINTS_SQL = "points as (select " + ", ".join(f"{e} as {c}" for c, e in POINT.items()) + " from supplier)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*(f"{e} as {c}" for c, e in POINT.items()))


@_register("j5_geo_radius", bridge.ctes("outlets") + f", {POINTS_SQL} select p.point_id, p.company_id, o.outlet_id, round({HAVERSINE.format(a='p', b='o')}, 6) as distance_m from points p join outlets o on p.company_id = o.company_id and o.active and {HAVERSINE.format(a='p', b='o')} <= 120")
def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.within_radius(_points(spark, sf_dir), bridge.table(spark, sf_dir, "outlets"), 120.0)
    return found.withColumn("distance_m", F.round("distance_m", 6))


@_register("x40_haversine", bridge.ctes("outlets") + f", {POINTS_SQL} select p.point_id, round({HAVERSINE.format(a='p', b='o')}, 6) as metres from points p join outlets o on o.outlet_id = 'OUT-' || p.point_id")
def _haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bridge.table(spark, sf_dir, "outlets").select("outlet_id", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    joined = _points(spark, sf_dir).withColumn("outlet_id", F.concat(F.lit("OUT-"), "point_id")).join(o, "outlet_id")
    return joined.select("point_id", F.round(text.haversine_m("lat", "lng", "lat2", "lng2"), 6).alias("metres"))


@_register("w1_topk_candidates", OBS + "select * from (select rep_id, observation_id, value, row_number() over (partition by rep_id order by value desc, observation_id)::int as rank from scope) where rank <= 5")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ranked(_observations(spark, sf_dir).select("rep_id", "observation_id", "value"), ["rep_id"], [F.desc("value"), F.col("observation_id")], 5)


@_register("w2_margin", OBS + "select rep_id, observation_id, round(value - coalesce(following, 0), 9) as margin from (select *, lead(value) over w as following, row_number() over w as r from scope window w as (partition by rep_id order by value desc, observation_id)) where r = 1")
def _margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.margin(_observations(spark, sf_dir).select("rep_id", "observation_id", "value"), ["rep_id"], "value", "observation_id")
    return best.select("rep_id", "observation_id", F.round("margin", 9).alias("margin"))


@_register("w3_best_per_key", OBS + "select rep_id, sku_id, observation_id from (select *, row_number() over (partition by rep_id, sku_id order by value desc, observation_id) as r from scope) where r = 1")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).select("rep_id", "sku_id", "observation_id", "value")
    return matching.ranked(rows, ["rep_id", "sku_id"], [F.desc("value"), F.col("observation_id")], 1).select("rep_id", "sku_id", "observation_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")


@_register("w4_token_ngrams", "with t as (select p_partkey, string_split(p_name, ' ') as w from part) select p_partkey, i as at, n, array_to_string(w[i + 1 : i + n], ' ') as words from t, lateral (select unnest(range(0, len(w)))::int as i), lateral (select unnest(range(1, 5))::int as n) where i + n <= len(w)")
def _ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _names(spark, sf_dir).select("p_partkey", F.explode(matching.token_ngrams(F.split("p_name", " "), 4)).alias("run"))
    return runs.select("p_partkey", F.col("run.at").alias("at"), F.size("run.words").alias("n"), F.array_join("run.words", " ").alias("words"))


@_register("w5_greedy_spans", """with recursive spans as (select event_id // 8 as g, event_id as id, (event_id * 7 % 20)::int as s, (event_id * 7 % 20 + 1 + event_id % 6)::int as e, (event_id * 37 % 100)::double as score from events ),
  ordered as (select *, row_number() over (partition by g order by score desc, e - s desc, id) as r from spans),
  step as (select g, 0::bigint as r, []::struct(s int, e int)[] as kept from ordered where r = 1
    union all select o.g, o.r, case when len(list_filter(k.kept, lambda x: x.s < o.e and o.s < x.e)) > 0 then k.kept else list_append(k.kept, {'s': o.s, 'e': o.e}) end from step k join ordered o on o.g = k.g and o.r = k.r + 1)
  select g, x.s as s, x.e as e from (select g, unnest(arg_max(kept, r)) as x from step group by g)""")
def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.selectExpr("event_id div 8 as g", "event_id as id", "cast(event_id * 7 % 20 as int) as s", "cast(event_id * 7 % 20 + 1 + event_id % 6 as int) as e", "cast(event_id * 37 % 100 as double) as score")
    spans = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "s", "e", "score"))).alias("spans"))
    plain = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score")))
    return spans.select("g", F.explode(matching.greedy_spans(plain)).alias("x")).select("g", "x.s", "x.e")


@_register("w6_last_n", OBS + "select rep_id, string_agg(observation_id, ',' order by recorded_at, observation_id) as last_ids from (select *, row_number() over (partition by rep_id order by recorded_at desc, observation_id desc) as r from scope) where r <= 5 group by 1")
def _last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.last_values(_observations(spark, sf_dir), "rep_id", "recorded_at", "observation_id", 5)
    return rows.select("rep_id", F.array_join("values", ",").alias("last_ids"))


TRIM = "regexp_replace(regexp_replace(w, '^[।,.;:!?\"''()\\[\\]{}—–\\-]+', ''), '[।,.;:!?\"''()\\[\\]{}—–\\-]+$', '')"


@_register("x1_tokenize", f"select item_id, i::int as place, t as token from (select item_id, t, row_number() over (partition by item_id order by k) - 1 as i from (select item_id, k, {TRIM} as t from (select item_id, unnest(regexp_extract_all(text, '\\S+')) as w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) as k from benchmark)) where t <> '')")
def _tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", F.posexplode(text.tokens("text")).alias("place", "t")).select("item_id", "place", F.col("t.text").alias("token"))


def _key_sql(c: str) -> str:
    s = f"lower({c})"
    for pattern, sound in text.LATIN_GROUPS:
        if pattern == "c(?=[eiy])":
            for vowel in "eiy":
                s = f"replace({s}, 'c{vowel}', 's{vowel}')"
        else:
            s = f"regexp_replace({s}, '{pattern}', '{sound}', 'g')"
    s = f"regexp_replace(replace(translate({s}, '{text.LATIN_FROM}', '{text.LATIN_TO}'), 'x', 'ks'), '[^a-z0-9]', '', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        s = f"regexp_replace({s}, '{letter}+', '{letter}', 'g')"
    return s


@_register("x20_phonetic_key_latin", f"select p_partkey, {_key_sql('p_type')} as key from part")
def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", text.latin_key("p_type").alias("key"))


@_register("x24_skeleton", f"select p_partkey, translate({_key_sql('p_type')}, 'aeiou', '') as skeleton from part")
def _skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", text.skeleton(text.latin_key("p_type")).alias("skeleton"))


def _ratio_sql(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end)"


@_register("x26_similarity", f"""with k as (select p_partkey, {_key_sql('p_type')} as a, {_key_sql('p_name')} as b from part), z as (select *, translate(a, 'aeiou', '') as sa, translate(b, 'aeiou', '') as sb from k)
  select p_partkey, round(case when a = '' or b = '' then 0.0 when a = b then 1.0 when sa = '' or sb = '' then {_ratio_sql('a', 'b')} else greatest({_ratio_sql('a', 'b')}, 0.95::double * {_ratio_sql('sa', 'sb')}) end, 9) as similarity from z""")
def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _names(spark, sf_dir).select("p_partkey", text.latin_key("p_type").alias("a"), text.latin_key("p_name").alias("b"))
    return keyed.select("p_partkey", F.round(text.key_similarity("a", "b"), 9).alias("similarity"))


@_register("x43_js_round", "select event_id, floor(value * 100 + 0.5) / 100 as rounded from events")
def _half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", compat.half_up("value", 2).alias("rounded"))


@_register("x44_half_even", "select event_id, round_even(floor(value * 2) / 2, 0) as rounded from events")
def _half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.floor(F.col("value") * 2) / 2
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", compat.half_even(halves).alias("rounded"))


@_register("x62_stable_hash", """select n_nationkey, sha256('{' || '"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as digest from nation""")
def _stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", compat.stable_hash("n_regionkey", "n_name", "n_nationkey").alias("digest"))


@_register("x71_cer", """select p_partkey, round(levenshtein(a, b)::double / length(a), 9) as cer from (select p_partkey, replace(p_name, ' ', '') as a, replace(p_type, ' ', '') as b from part)""")
def _cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", F.round(evaluation.cer(F.col("p_name"), F.col("p_type")), 9).alias("cer"))


CELL = "case event_id % 5 when 0 then 'PRAN; Lux |Surf Excel' when 1 then '  ' when 2 then ';;a|b;' when 3 then null else 'one' end"


@_register("s2_split_list", f"select event_id, array_to_string(list_filter(list_transform(regexp_split_to_array({CELL}, '[;|]'), lambda x: trim(x)), lambda x: x <> ''), ',') as items from events")
def _split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cell", F.expr(CELL))
    return rows.select("event_id", F.array_join(compat.split_list("cell"), ",").alias("items"))


WORD = "case event_id % 6 when 0 then ' YES ' when 1 then '' when 2 then 'no' when 3 then '1' when 4 then null else 'Active' end"


@_register("s3_parse_bool", f"select event_id, case when trim(coalesce({WORD}, '')) = '' then true else lower(trim({WORD})) in ('1', 'true', 'yes', 'y', 'active') end as flag from events")
def _parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", compat.parse_bool(F.expr(WORD)).alias("flag"))


#: All events are there, and all come in under other keys, half of which are new.
EXISTING = "select user_id as k, event_id as v, ts as moment from events"
INSERTS = "select user_id * 2 as k, event_id as v, ts as moment from events"


def _kv(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{key} as k", "event_id as v", "ts as at")


@_register("k1_insert_dedupe", f"with e as ({EXISTING}), i as ({INSERTS}) select k, v from e union all select k, v from (select *, row_number() over (partition by k order by moment, v) as r from i where k not in (select k from e)) where r = 1")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.insert_new(_kv(spark, sf_dir), _kv(spark, sf_dir, "user_id * 2"), ["k"], ["at", "v"]).select("k", "v")


@_register("k2_replace_for_key", f"with e as ({EXISTING}), i as ({INSERTS}) select k, v from e where k not in (select k from i) union all select k, v from i")
def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = _kv(spark, sf_dir, "user_id * 2")
    return state.replace_for_keys(_kv(spark, sf_dir), incoming, incoming, "k").select("k", "v")


@_register("k3_upsert_latest", "select k, v from (select user_id as k, event_id as v, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_latest(_kv(spark, sf_dir), ["k"], ["at", "v"]).select("k", "v")


@_register("g3_clip_state", bridge.ctes("observations") + "select clip_id, arg_max(coalesce(status, 'none'), (recorded_at, observation_id)) as status from observations group by 1")
def _clip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.table(spark, sf_dir, "observations").withColumn("status", F.coalesce("status", F.lit("none")))
    return state.latest_status(rows, "clip_id", "status", "recorded_at", "observation_id")


PROMPT = "user_id as prompt_id, event_id as moment, case event_type when 'click' then 'answer' when 'error' then 'cancel' when 'view' then 'timeout' else 'create' end as kind, event_id % 7 as value"


@_register("g4_clarify_fold", f"""with e as (select {PROMPT} from events), f as (select prompt_id, min(moment) filter (kind = 'timeout') as t, min(moment) filter (kind = 'cancel') as c, min(moment) filter (kind = 'answer') as a, arg_min(value, moment) filter (kind = 'answer') as v from e group by 1)
  select prompt_id, case when ok then 'answered' when c is not null and (t is null or c < t) then 'cancelled' when t is not null then 'auto_resolved' else 'pending' end as status, case when ok then v end as value, coalesce(ok and t is not null and a > t, false) as late
  from (select *, a is not null and (c is null or a < c) as ok from f)""")
def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_prompts(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*PROMPT_COLUMNS))


PROMPT_COLUMNS = ["user_id as prompt_id", "event_id as at", "case event_type when 'click' then 'answer' when 'error' then 'cancel' when 'view' then 'timeout' else 'create' end as kind", "event_id % 7 as value"]


@_register("g5_alias_counts", bridge.ctes("observations") + """, r as (select company_id, type as surface, sku_id, clip_id, recorded_at as moment, row_number() over (partition by company_id, type order by recorded_at desc, clip_id desc) as n from observations where sku_id is not null)
  select company_id, surface, count(*) as occurrences, arg_max(sku_id, (moment, clip_id)) as suggested, string_agg(clip_id::varchar, ',' order by moment, clip_id) filter (n <= 5) as samples from r group by 1, 2""")
def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.table(spark, sf_dir, "observations").filter("sku_id is not null").select("company_id", F.col("type").alias("surface"), "sku_id", "clip_id", F.col("recorded_at").alias("at"))
    return state.surface_counts(rows).select("company_id", "surface", "occurrences", "suggested", F.array_join(F.col("sample_clips").cast("array<string>"), ",").alias("samples"))


SAMPLE = "cast((event_id * 13) % 101 as double) / 100 as conf, event_id % 3 <> 0 as correct, event_id % 4 = 0 as flagged, event_id % 3 = 0 as wrong"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast((event_id * 13) % 101 as double) / 100 as conf", "event_id % 3 <> 0 as correct", "event_id % 4 = 0 as flagged", "event_id % 3 = 0 as wrong")


@_register("a16_calibration", f"""with s as (select {SAMPLE} from events), b as (select unnest(range(0, 10))::int as bin)
  select bin, count(conf) as n, coalesce(sum(correct::int), 0)::bigint as correct, floor(coalesce(avg(conf), 0) * 10000 + 0.5) / 10000 as mean_conf, floor(coalesce(avg(correct::int), 0) * 10000 + 0.5) / 10000 as observed
  from b left join s on conf >= bin / 10.0::double and (conf < (bin + 1) / 10.0::double or bin = 9) group by 1""")
def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(_samples(spark, sf_dir))


@_register("a17_gate", f"select floor(count(*) filter (flagged)::double / count(*) * 10000 + 0.5) / 10000 as flagged_share, floor(count(*) filter (flagged and wrong)::double / count(*) filter (wrong) * 10000 + 0.5) / 10000 as errors_caught, floor(count(*) filter (flagged and wrong)::double / count(*) filter (flagged) * 10000 + 0.5) / 10000 as flag_precision from (select {SAMPLE} from events)")
def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate(_samples(spark, sf_dir))


FIELD = "event_type as field, case when event_id % 5 = 0 then null else event_id % 3 end as truth, case when event_id % 7 = 0 then null else event_id % 4 end as predicted"
TALLY = f"select field, count(*) filter (truth = predicted) as correct, count(*) filter (truth <> predicted) as wrong, count(*) filter (truth is not null and predicted is null) as missed, count(*) filter (truth is null and predicted is not null) as spurious from (select {FIELD} from events) group by 1"


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type as field", "case when event_id % 5 = 0 then null else event_id % 3 end as truth", "case when event_id % 7 = 0 then null else event_id % 4 end as predicted")
    return evaluation.field_tallies(rows)


_register("a12_field_tallies", TALLY)(_tallies)


@_register("a14_prf", f"""with t as ({TALLY}), p as (select *, correct::double / (correct + wrong + spurious) as p, correct::double / (correct + wrong + missed) as r from t)
  select field, floor(p * 10000 + 0.5) / 10000 as precision, floor(r * 10000 + 0.5) / 10000 as recall, floor(2 * p * r / (p + r) * 10000 + 0.5) / 10000 as f1, floor(correct::double / (correct + wrong + missed + spurious) * 10000 + 0.5) / 10000 as accuracy from p""")
def _prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_recall(_tallies(spark, sf_dir))


@_register("u2_distinct_first_seen", OBS + "select rep_id, string_agg(quantity::bigint::varchar, ',' order by first_id) as quantities from (select *, row_number() over (partition by rep_id order by first_id) as r from (select rep_id, quantity, min(observation_id) as first_id from scope where quantity is not null group by 1, 2)) where r <= 3 group by 1")
def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.first_values(_observations(spark, sf_dir), "rep_id", "observation_id", "quantity", 3)
    return rows.select("rep_id", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("quantities"))


@_register("u3_array_except", OBS + "select observation_id, array_to_string(list_filter([case when c_skuId < 0.8 then 'skuId' end, case when c_quantity < 0.8 then 'quantity' end], lambda x: x is not null), ',') as open_fields from scope")
def _except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("observation_id", F.array_join(F.array_except("flagged_fields", F.array(F.lit("outletId"))), ",").alias("open_fields"))


@_register("j7_span_overlap", """select g, round(sum(w * conf) / sum(w), 9) as confidence from (select event_id // 8 as g, greatest(0, least(12, e) - greatest(4, s)) as w, conf from (select event_id, event_id * 7 % 20 as s, event_id * 7 % 20 + 1 + event_id % 6 as e, (event_id * 37 % 100)::double / 100 as conf from events)) group by 1 having sum(w) > 0""")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id div 8 as g", "event_id", "event_id * 7 % 20 as s", "event_id * 7 % 20 + 1 + event_id % 6 as e", "cast(event_id * 37 % 100 as double) / 100 as conf")
    words = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("event_id", "s", "e", "conf"))).alias("words"))
    some = words.filter(F.exists("words", lambda w: (w["s"] < 12) & (w["e"] > 4)))
    return some.select("g", F.round(matching.overlap_confidence(F.col("words"), F.lit(4), F.lit(12)), 9).alias("confidence"))


# Phrases and the quantities in them, by place.
PHRASES = [
    ("১২", [(12, None)]), ("2.5", [(2.5, None)]), ("দেড়", [(1.5, None)]), ("আড়াই", [(2.5, None)]), ("আধা", [(0.5, None)]), ("সাড়ে তিন", [(3.5, None)]), ("সোয়া তিন", [(3.25, None)]),
    ("পৌনে চার", [(3.75, None)]), ("সাড়ে", []), ("ডজন", []), ("দেড় ডজন", [(18, "piece")]), ("সাড়ে তিন ডজন", [(42, "piece")]), ("পৌনে দুই ডজন", [(21, "piece")]), ("তিন হালি", [(12, "piece")]),
    ("দুই গণ্ডা", [(8, "piece")]), ("পাঁচ শ", [(500, None)]), ("তিন হাজার পাঁচ শ", [(3500, None)]), ("আড়াই লাখ", [(250000, None)]), ("দুই কোটি", [(20000000, None)]), ("দেড়শ", [(150, None)]),
    ("আড়াইশ", [(250, None)]), ("পাঁচ টাকা", [(5, "BDT")]), ("দুই কার্টন", [(2, "carton")]), ("তিন কেজি", [(3, "kg")]), ("দেড় ডজন কার্টন", [(18, "carton")]), ("দের ডজন", [(18, "piece")]),
    ("সারে তিন", [(3.5, None)]), ("পোনে চার", [(3.75, None)]), ("দের দর্জন", [(18, "piece")]), ("তীন", [(3, None)]), ("তিন কার্টন আর দুই ডজন আর পাঁচ কেজি", [(3, "carton"), (24, "piece"), (5, "kg")]),
    ("দোকানে", []), ("ভালো", []), ("কিন্তু", []), ("ক", []),
]
SPOKEN = [("হুইল", "Wheel"), ("প্রাণ", "PRAN"), ("প্রান", "PRAN"), ("এক্সেল", "Excel"), ("হারপিক", "Harpic"), ("নিউ", "New"), ("ম্যাঙ্গো", "mango")]


@_register("fixture_t2_quantities", "select event_id as doc_id, n::bigint as n, v::double as value, u::varchar as unit from events join (values " + _values([(i, k + 1, v, u) for i, (_, found) in enumerate(PHRASES) for k, (v, u) in enumerate(found)]) + f") t(i, n, v, u) on event_id % {len(PHRASES)} = i")
def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event says one of the fixed phrases."""
    phrases = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PHRASES)], "i long, text string")
    said = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), (F.col("event_id") % len(PHRASES)).alias("i")).join(F.broadcast(phrases), "i")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("s"))
    return quantities.quantities(said.select("doc_id", "text")).select("doc_id", place.cast("long").alias("n"), "value", "unit")


@_register("fixture_phonetic_bn", "select event_id, spoken, same from events join (values " + _values([(i, b, True) for i, (b, _) in enumerate(SPOKEN)]) + f") t(i, spoken, same) on event_id % {len(SPOKEN)} = i")
def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event says one of the fixed words."""
    words = spark.createDataFrame([(i, *w) for i, w in enumerate(SPOKEN)], "i long, spoken string, written string")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % len(SPOKEN)).alias("i")).join(F.broadcast(words), "i")
    return rows.select("event_id", "spoken", (bangla.phonetic_key("spoken") == bangla.phonetic_key("written")).alias("same"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a2_share_of_voice"](spark, sf_dir)


