"""Queries of the whole flow over the given tables: extraction, replies, retries, clip life, feeds, uploads, recogniser replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import analytics, assemble, clarify, extract, matching, quantities, replies, resolve
from ..sources import bridge, recognised, traces, uploads
from ..streaming import feed, retries, status
from . import capture
from .registry import register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(values: list) -> str:
    return "[" + ", ".join("null" if v is None else repr(v) for v in values) + "]"


# Spoken parts and what they mean. Numbers: (words, value); units: (word, factor, unit).
NUMBERS = [("এক", 1), ("সাড়ে তিন", 3.5), ("বারো", 12), ("পৌনে চার", 3.75), ("২৫", 25), ("পাঁচ শ", 500), ("আড়াই", 2.5), ("দের", 1.5), ("দুই শ", 200), ("চাল্লিশ", 40), ("সোয়া দুই", 2.25)]
UNITS = [("ডজন", 12, "piece"), ("কেজি", 1, "kg"), ("টাকা", 1, "BDT"), ("হালি", 4, "piece"), ("কার্টন", 1, "carton"), ("লাগবে", 1, None), ("প্যাকেট", 1, "packet")]


@register("t2_quantities", f"""with e as (select event_id, event_id % 11 + 1 as a, event_id % 7 + 1 as b, (event_id // 3) % 11 + 1 as c, (event_id // 5) % 7 + 1 as d from events),
  two as (select event_id, 1::bigint as n, {_sql_list([v for _, v in NUMBERS])}[a]::double * {_sql_list([f for _, f, _ in UNITS])}[b] as value, {_sql_list([u for _, _, u in UNITS])}[b]::varchar as unit from e
    union all select event_id, 2, {_sql_list([v for _, v in NUMBERS])}[c]::double * {_sql_list([f for _, f, _ in UNITS])}[d], {_sql_list([u for _, _, u in UNITS])}[d]::varchar from e where event_id % 2 = 0)
  select event_id as doc_id, n, value, unit from two""")
def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a sentence with one or two quantities: numbers of all forms with units of all kinds."""
    pick = lambda parts, key: F.element_at(F.array(*map(F.lit, parts)), key + 1)
    k = F.col("event_id")
    number, unit = [w for w, _ in NUMBERS], [w for w, _, _ in UNITS]
    first = F.concat_ws(" ", F.lit("দোকানে"), pick(number, (k % 11).cast("int")), pick(unit, (k % 7).cast("int")))
    second = F.when(k % 2 == 0, F.concat_ws(" ", F.lit("আর"), pick(number, (F.floor(k / 3) % 11).cast("int")), pick(unit, (F.floor(k / 5) % 7).cast("int"))))
    found = quantities.quantities(_read(spark, sf_dir, "events").select(k.alias("doc_id"), F.concat_ws(" ", first, second).alias("text")))
    listed = F.array_sort(F.collect_list(F.struct("s", "value", "unit")))
    return found.groupBy("doc_id").agg(listed.alias("q")).select("doc_id", F.posexplode("q").alias("n", "q")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "q.value", "q.unit")


# What a clip may say of a shop, a product and an amount, and what each means.
SHOPS = [("বিজয় স্টোরে", "OUT-1182"), ("রহমান স্টোরে", "OUT-1183"), ("", "OUT-1183")]
GOODS = [("", None, None), ("প্রাণ ম্যাঙ্গো জুস", "SKU-404", None), ("হুইল এর অফার", None, "COMP-WHEEL"), ("হারপিক", "SKU-503", None), ("চানাচুর", "SKU-420", None)]
AMOUNTS = [("", None, None), ("দেড় ডজন", 18, "piece"), ("পাঁচ টাকা কম", 5, "BDT"), ("তিন কেজি", 3, "kg")]
DECLARED = "OUT-1184"

SAID_SQL = f"""with c as (select c_custkey as k, {_sql_list([o for _, o in SHOPS])}[c_custkey % 3 + 1]::varchar as heard, {_sql_list([s for _, s, _ in GOODS])}[c_custkey % 5 + 1]::varchar as sku_id, {_sql_list([r for _, _, r in GOODS])}[c_custkey % 5 + 1]::varchar as competitor_brand,
    {_sql_list([v for _, v, _ in AMOUNTS])}[c_custkey % 4 + 1]::double as amount, {_sql_list([u for _, _, u in AMOUNTS])}[c_custkey % 4 + 1]::varchar as unit, c_custkey % 17 = 0 or c_custkey % 19 = 0 as failed from customer),
  o as (select k as clip_id, case when failed then 'failed' else 'processed' end as status, case when failed then '01-transcribe' end as stage,
    case when failed then null when sku_id is not null then 'demand_signal' when competitor_brand is not null then 'competitor_promo' else 'retailer_complaint' end as type,
    case when failed then null when k % 7 = 0 then '{DECLARED}' else heard end as outlet_id, case when not failed then sku_id end as sku_id, case when not failed then competitor_brand end as competitor_brand,
    case when not failed and sku_id is not null and unit is distinct from 'BDT' then amount end as quantity, case when not failed and sku_id is not null and unit <> 'BDT' then unit end as unit,
    case when not failed and competitor_brand is not null and unit = 'BDT' then -amount end as price_delta from c) """


def spoken_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each customer: shop, product and amount as its key has them, some blank, some without a text, some with a declared outlet."""
    k = F.col("c_custkey")
    pick = lambda parts, n: F.element_at(F.array(*(F.lit(p[0]) for p in parts)), (k % n + 1).cast("int"))
    said = F.concat_ws(" ", pick(SHOPS, 3), F.lit("আজকে"), pick(GOODS, 5), F.lit("লাগবে"), pick(AMOUNTS, 4))
    text = F.when(k % 19 == 0, None).when(k % 17 == 0, " \t").otherwise(said)
    place = [F.lit(x).alias(c) for x, c in zip(capture.PLACE, ("lat", "lng"), strict=True)]
    return _read(spark, sf_dir, "customer").select(k.alias("clip_id"), F.lit(capture.COMPANY).alias("company_id"), text.alias("text"), F.lit(None).cast("array<string>").alias("brands"), *place, F.when(k % 7 == 0, DECLARED).alias("declared_outlet_id"))


def _extracted(spark: SparkSession, clips: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    return extract.extract(clips, capture.skus(spark), capture.aliases(spark), capture.outlets(spark), recorded)


@register("t0_spoken_clips", SAID_SQL + "select * from o")
def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From transcripts to observations, failed clips among them."""
    rows = _extracted(spark, spoken_clips(spark, sf_dir)).select("clip_id", "status", F.col("fault.stage").alias("stage"), F.explode_outer("observations").alias("x"))
    return rows.select("clip_id", "status", "stage", *(F.col("x.observation")[c].alias(c) for c in ("type", "outlet_id", "sku_id", "competitor_brand", "quantity", "unit", "price_delta")))


@register("t0_stage_counts", SAID_SQL + """, n as (select count(*) as clips, count(*) filter (status = 'failed') as failed from o)
  select '01-transcribe' as stage, clips as entered, failed from n union all select unnest(['05-assemble', '06-confidence']), clips - failed, 0 from n""")
def _stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.stage_counts(_extracted(spark, spoken_clips(spark, sf_dir)))


def conversation_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, whole, as a clip of a tenant whose catalogue is the one of the tests."""
    place = [F.lit(x).alias(c) for x, c in zip(capture.PLACE, ("lat", "lng"), strict=True)]
    turns = _read(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("clip_id"), F.lit(capture.COMPANY).alias("company_id"), "text", F.lit(None).cast("array<string>").alias("brands"), *place, F.lit(None).cast("string").alias("declared_outlet_id"))


@register("t0_conversations")
def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a thousand invented words meet a catalogue by sound alone; SQL has no such likeness, so tests compare with plain Python."""
    rows = _extracted(spark, conversation_clips(spark, sf_dir))
    flags = F.aggregate("observations", F.lit(0), lambda n, x: n + F.size(x["flagged_fields"]))
    return rows.select("clip_id", "status", F.col("fault.message").alias("error"), "n_products", "n_quantities", "n_outlets", F.size("observations").alias("n_observations"), flags.alias("n_flags"), F.to_json(F.get("observations", F.lit(0))["observation"]).alias("first"))


#: Parts of which one task makes clips.
PARTS_A_TASK = 10_000


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations made of each part: two products, a rival, two outlets and two quantities at most, by arithmetic on its key."""
    k = F.col("p_partkey")
    product = lambda sku, name, rival, score: F.struct(sku.alias("sku_id"), name.alias("name"), F.lit("b").alias("brand"), F.lit(rival).alias("is_competitor"), F.lit(score).alias("score"), F.lit(None).cast("string").alias("via_alias"))
    mention = lambda *found: F.struct(F.lit(0).alias("s"), F.length("p_name").alias("e"), F.col("p_name").alias("raw"), F.array(*found).alias("candidates"), F.lit(0.1).alias("margin"))
    own = mention(product(F.concat(F.lit("S"), k), F.col("p_name"), False, 0.9), product(F.concat(F.lit("S"), k + 1), F.col("p_type"), False, 0.8))
    rival = mention(product(F.concat(F.lit("C"), k % 50), F.col("p_brand"), True, 0.7))
    shop = lambda i: F.struct(F.concat(F.lit("O"), k % 100 + i).alias("outlet_id"), F.concat(F.lit("Shop "), k % 100 + i).alias("name"), F.lit(10.0 * (i + 1)).alias("distance_m"), F.lit(0.5).alias("name_score"), F.lit(0.9 - i / 10).alias("score"))
    shops = F.when(k % 5 == 0, F.array().cast("array<struct<outlet_id:string,name:string,distance_m:double,name_score:double,score:double>>")).when(k % 5 == 1, F.array(shop(0))).when(k % 5 == 2, F.array(shop(0), shop(1))).otherwise(F.array(*map(shop, range(4))))
    outlet = F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("string").alias("raw"), shops.alias("candidates"), F.lit(0.1).alias("margin"), F.size(shops).alias("gps_candidates"), F.lit(False).alias("declared"))
    amount = lambda v, unit: F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), v.cast("double").alias("value"), unit.cast("string").alias("unit"), F.lit("").alias("basis"), F.lit(0.9).alias("confidence"))
    amounts = F.array_compact(F.array(amount(k % 9 + 0.5, F.lit("kg")), F.when(k % 4 > 0, amount(k % 9 + 0.5, F.lit("litre"))), F.when(k % 4 > 1, amount(k % 13, F.lit(None)))))
    words = F.array(F.struct(F.lit("x").alias("w"), F.lit(0).alias("s"), F.length("p_name").alias("e"), F.lit(0.9).alias("conf")))
    parts = _read(spark, sf_dir, "part")
    parts = parts.repartition(1 + parts.count() // PARTS_A_TASK, "p_partkey")  # a small file is one task, and much is made of its rows
    return parts.select(k.alias("clip_id"), F.col("p_name").alias("text"), words.alias("words"), outlet.alias("outlet"), F.when(k % 3 == 0, F.array(own, rival)).otherwise(F.array(own)).alias("skus"), amounts.alias("quantities"), "p_partkey")


@register("c2_outlet_questions", """select p_partkey as clip_id, case when p_partkey % 5 = 2 then 'Shop ' || p_partkey % 100 || ' নাকি Shop ' || (p_partkey % 100 + 1) || '?' else 'কোন দোকান?' end as question,
  'O' || p_partkey % 100 || ',O' || (p_partkey % 100 + 1) || case when p_partkey % 5 > 2 then ',O' || (p_partkey % 100 + 2) else '' end as options from part where p_partkey % 5 >= 2""")
def _outlet_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir, "outletId")


@register("c4_quantity_questions", """select p_partkey as clip_id, (p_partkey % 9) || '.5 kg নাকি ' || (p_partkey % 13) || '?' as question, (p_partkey % 9) || '.5,' || (p_partkey % 13) as options from part where p_partkey % 4 > 1""")
def _quantity_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number with another unit is the same option."""
    return _questions(spark, sf_dir, "quantity")


def _questions(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    known = _known(spark, sf_dir)
    done = assemble.scored(assemble.assembled(known).filter("place = 0"), known, threshold=1.01)  # all is asked about
    asked = clarify.clarifications(done, known, "2024-02-01 00:00:00").filter(F.col("field") == field)
    return asked.select("clip_id", "question", F.array_join(F.transform("options", lambda o: o["value"]), ",").alias("options"))


FAULTS = ["the reply is not JSON", "the reply has no list of observations, or one of another kind", "an observation lacks a field", "an observation names what was not offered", "an observation has an unknown type or severity, or no text"]


@register("p13_prompt_replies", f"""select p_partkey as clip_id, case p_partkey % 8 when 0 then 'missing' when 1 then '{FAULTS[0]}' when 2 then '{FAULTS[1]}' when 3 then '{FAULTS[2]}' when 4 then '{FAULTS[3]}' when 5 then '{FAULTS[4]}' end as error,
  case when p_partkey % 8 > 5 then 'S' || p_partkey end as sku_id, case when p_partkey % 8 = 6 then (p_partkey % 9)::double + 0.5 end as quantity, case when p_partkey % 8 = 6 then 'kg' end as unit, case when p_partkey % 8 > 5 then (p_partkey % 8 = 7)::int end as rejected from part""")
def _prompt_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply is recorded for the prompt of most parts: whole ones, one with an invented number, and each kind of faulty one."""
    known = _known(spark, sf_dir)
    k = F.col("clip_id")
    number = F.when(k % 8 == 7, k % 9 + 0.25).otherwise(k % 9 + 0.5).cast("string")
    entry = lambda kind="demand_signal", sku=F.concat(F.lit("S"), k), last=',"verbatimBn":"x"': F.concat(F.lit(f'{{"observations":[{{"type":"{kind}","outletId":null,"skuId":"'), sku, F.lit('","competitorBrand":null,"quantity":'), number, F.lit(',"unit":"kg","priceDelta":null,"severity":"low"' + last + "}]}"))
    raw = F.when(k % 8 == 1, "{nonsense").when(k % 8 == 2, '{"answers":[]}').when(k % 8 == 3, entry(last="")).when(k % 8 == 4, entry(sku=F.lit("S0"))).when(k % 8 == 5, entry("guess")).otherwise(entry())
    asked = replies.prompt(F.col("text"), F.col("outlet"), F.col("skus"), F.col("quantities"))
    recorded = known.filter(k % 8 > 0).select(replies.reply_key(F.concat(asked)).alias("key"), raw.alias("raw"))
    found, errors = replies.assembled_from_replies(known, recorded)
    said = F.when(F.col("error").startswith("no reply"), "missing").otherwise(F.col("error"))
    good = found.select("clip_id", F.lit(None).cast("string").alias("error"), "observation.sku_id", "observation.quantity", "observation.unit", F.size("rejected").alias("rejected"))
    return good.unionByName(errors.select("clip_id", said.alias("error")), allowMissingColumns=True)


@register("g2_attempts", """with a as (select event_id // 5 as job_id, ts, event_type = 'purchase' as ok, event_type = 'error' as by_provider, [null, 429, 404, 500][event_id % 4 + 1] as code from events),
  n as (select *, row_number() over (partition by job_id order by ts) as attempt from a),
  s as (select *, case when ok then 'done' when (by_provider and code = 404) or attempt = 3 then 'dead' else 'waiting' end as status from n where attempt <= 3),
  f as (select *, row_number() over (partition by job_id order by status = 'waiting', case when status = 'waiting' then -attempt else attempt end) as r from s)
  select job_id, attempt::int as attempts, status, case when status = 'waiting' then ts + to_milliseconds(2000 * 2 ** (attempt - 1)::int) end as due from f where r = 1""")
def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events are the log of a job: a purchase succeeds, an error is a provider's refusal, all else may pass."""
    rows = _read(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("job_id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") == "error").alias("by_provider"), F.expr("element_at(array(null, 429, 404, 500), cast(event_id % 4 + 1 as int))").alias("http_status"))
    return retries.settled_attempts(rows)


ASKED = "case event_type when 'signup' then 'queued' when 'purchase' then 'processed' when 'error' then 'failed' when 'click' then 'processing' else 'queued' end"


@register("g3_clip_life", f"""with recursive e as (select user_id // 2 as clip_id, ts, {ASKED} as asked, row_number() over (partition by user_id // 2 order by ts, {ASKED}) as n from events),
  s as (select clip_id, 0::bigint as n, null::timestamp as ts, null::varchar as before, null::varchar as asked, null::boolean as accepted, ''::varchar as now from (select distinct clip_id from e) t
    union all
    select e.clip_id, e.n, e.ts, nullif(s.now, ''), e.asked, ok, case when ok then e.asked else s.now end from s join (select *, 1 as one from e) e on e.clip_id = s.clip_id and e.n = s.n + 1,
      lateral (select (s.now = '' and e.asked = 'queued') or (s.now in ('queued', 'processed', 'failed') and e.asked = 'processing') or (s.now = 'processing' and e.asked in ('processing', 'processed', 'failed')) as ok) l)
  select clip_id, ts as at, before, asked, accepted from s where n > 0""")
def _clip_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two users are the changes asked of one clip; the log says which were legal."""
    return status.status_log(_read(spark, sf_dir, "events").selectExpr("user_id div 2 as clip_id", "ts as at", f"{ASKED} as status"))


@register("g6_live_feed", """with e as (select 'co' || user_id % 3 as company_id, 'o' || event_id % 4000 as observation_id, ts, event_type || event_id as body from events where user_id % 10 <> 0),
  l as (select *, row_number() over (partition by company_id, observation_id order by ts desc, body desc) as r from e),
  p as (select *, row_number() over (partition by company_id order by ts desc, observation_id desc) as place from l where r = 1)
  select company_id, place::int as place, observation_id, ts as created_at, body from p where place <= 60""")
def _live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sixty of each tenant, an observation once; rows without a tenant are in no feed."""
    rows = _read(spark, sf_dir, "events").selectExpr("case when user_id % 10 <> 0 then concat('co', user_id % 3) when user_id % 20 = 0 then '' end as company_id", "concat('o', event_id % 4000) as observation_id", "ts as created_at", "concat(event_type, event_id) as body")
    return feed.latest(rows)


@register("s11_ingest", r"""with p as (select page_id, html, page_id % 6 = 1 as corrupt, page_id % 6 = 2 as absent, octet_length(encode(html)) > 3000 as large, page_id % 9 = 0 as short, page_id % 8 = 3 as source, page_id % 7 = 2 as place, page_id % 5 = 4 as time from pages)
  select page_id, case when not corrupt and not absent then octet_length(encode(html))::int end as bytes, array_to_string(list_filter([case when short then 'client_uuid must have 8 to 128 characters' end, case when absent then 'audio_base64 is missing' end, case when corrupt then 'audio_base64 is not base64' end,
    case when large and not corrupt and not absent then 'audio is too large' end, case when source then 'source must be voice or photo' end, case when place then 'a place needs lat and lng' end, case when time then 'recorded_at must be a time in UTC' end], lambda x: x is not null), '; ') as reasons from p""")
def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: their content in base64, broken in some, and fields that break each rule."""
    k = F.col("page_id")
    rows = _read(spark, sf_dir, "pages").select(
        k, F.when(k % 9 == 0, "short").otherwise(F.concat(F.lit("client-"), F.lpad(k.cast("string"), 8, "0"))).alias("client_uuid"),
        F.when(k % 6 == 1, F.concat(F.lit("*"), F.base64(F.col("html").cast("binary")))).when(k % 6 != 2, F.base64(F.col("html").cast("binary"))).alias("audio_base64"),
        F.lit(None).cast("string").alias("mime_type"), F.when(k % 8 == 3, "video").when(k % 2 == 0, "photo").alias("source"), F.lit(23.78).alias("lat"), F.when(k % 7 != 2, 90.4).alias("lng"),
        F.lit(None).cast("string").alias("declared_outlet_id"), F.when(k % 5 == 4, "2024-01-09 10:00").otherwise("2024-01-09T10:00:00.000Z").alias("recorded_at"),
    )
    done = uploads.checked(rows, most_bytes=3000)
    return done.select("page_id", F.octet_length("audio").alias("bytes"), F.array_join("reasons", "; ").alias("reasons"))


@register("s13_hosted_words", r"""with t as (select conv_id, turn, regexp_extract_all(text, '\S+') as w from conversations where len(regexp_extract_all(text, '\S+')) > 0),
  x as (select conv_id, turn, unnest(w) as word, generate_subscripts(w, 1) - 1 as i, len(w) as n from t),
  c as (select *, case when i >= 10 * ((n + 9) // 10) - 5 then null else i // 10 end as seg from x),
  m as (select conv_id, turn, n, avg(floor(exp(-(s % 7) / 5.0::double) * case when s % 3 = 0 then 0.5 else 1 end * 10000 + 0.5) / 10000) as mean from (select conv_id, turn, n, unnest(range(0, (n + 9) // 10)) as s from (select distinct conv_id, turn, n from x)) group by all)
  select conv_id, turn, count(*)::int as n_words, sum(len(word))::bigint as chars, round(sum(case when seg is null then mean else floor(exp(-(seg % 7) / 5.0::double) * case when seg % 3 = 0 then 0.5 else 1 end * 10000 + 0.5) / 10000 end) / count(*), 6) as confidence
  from c join m using (conv_id, turn, n) group by 1, 2""")
def _hosted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a recogniser's reply: a word each second, a segment for ten of them, the last one cut short."""
    turns = _read(spark, sf_dir, "conversations").withColumn("w", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).filter(F.size("w") > 0)
    last = F.floor((F.size("w") + 9) / 10).cast("int") - 1
    end = lambda s: F.when(s == last, s * 10 + 4.5).otherwise(s * 10 + 9.5)
    segment = lambda s: F.struct((s * 10).cast("double").alias("start"), end(s).cast("double").alias("end"), (-(s % 7) / 5).alias("avg_logprob"), F.when(s % 3 == 0, 2.5).otherwise(1.0).alias("compression_ratio"))
    words = F.transform("w", lambda w, i: F.struct(F.concat(F.lit(" "), w).alias("word"), i.cast("double").alias("start"), (i + 0.9).cast("double").alias("end")))
    raw = F.to_json(F.struct("text", F.transform(F.sequence(F.lit(0), last), segment).alias("segments"), words.alias("words")))
    found, _ = recognised.hosted_transcripts(turns.select(F.struct("conv_id", "turn").alias("clip_id"), raw.alias("raw")))
    sure = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["conf"]) / F.size("words")
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + (w["e"] - w["s"]))
    return found.select("clip_id.conv_id", "clip_id.turn", F.size("words").alias("n_words"), chars.alias("chars"), F.round(sure, 6).alias("confidence"))


@register("k8_traces", """select user_id as clip_id, (max(ts)::date)::varchar as day, sum(floor(value))::double as total_ms, bool_or(event_type = 'error') as failed, count(*)::int as stages, min('<' || length(event_type) || ' bytes>') as smallest from events group by 1""")
def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are the stages of a user's clip; their input holds binary content two levels down."""
    entries = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), F.col("ts").alias("traced_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.floor("value").cast("double").alias("ms"), F.lit(False).alias("cached"),
        F.struct(F.array(F.struct(F.col("event_type").cast("binary").alias("audio"))).alias("parts")).alias("input"), F.lit("x").alias("output"), F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    done = traces.traces(entries)
    smallest = F.array_min(F.transform("stages", lambda s: s["input"]["parts"][0]["audio"]))
    return done.select("clip_id", F.col("day").cast("string").alias("day"), "total_ms", "failed", F.size("stages").alias("stages"), smallest.alias("smallest"))


CLIPS = bridge.ctes("clips")


@register("a9_pipeline_stats", CLIPS + """, p as (select * from clips where company_id = 'co1' and status = 'processed' and recorded_at between timestamp '2024-01-05' and timestamp '2024-01-25'),
  x as (select extractor, extractor_model, count(*) as n, arg_min(simulated, (recorded_at, clip_id)) as sim from p where extractor is not null group by all),
  t as (select 'transcribe' as stage, t_transcribe as ms from p where t_transcribe is not null union all select 'assemble', t_assemble from p where t_assemble is not null),
  r as (select *, row_number() over (partition by stage order by ms) - 1 as i, count(*) over (partition by stage) as n from t),
  g as (select stage, floor(avg(ms) + 0.5)::bigint as avg_ms, max(n) as n, max(case when i = least(n - 1, floor(0.95 * n)) then ms end)::bigint as p95 from r group by stage)
  select count(*) as clips, count(*) filter (source is distinct from 'photo') as voice, count(*) filter (source = 'photo') as photo, arg_min(llm_model, (recorded_at, clip_id)) filter (llm_model is not null) as llm_model,
    (select string_agg(extractor || ' ' || extractor_model || ' ' || n || ' ' || sim, ',' order by n desc, extractor, extractor_model) from x) as extractors, (select string_agg(stage || ' ' || avg_ms || ' ' || p95 || ' ' || n, ',' order by stage) from g) as stages from p""")
def _pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = analytics.processed(bridge.table(spark, sf_dir, "clips"), "co1", "2024-01-05", "2024-01-25")
    words = lambda *c: F.concat_ws(" ", *(x.cast("string") for x in c))
    extractors = F.array_join(F.transform("extractors", lambda x: words(x["extractor"], x["extractor_model"], x["clips"], x["simulated"])), ",")
    stages = F.array_join(F.transform("stages", lambda x: words(x["stage"], x["avg_ms"].cast("long"), x["p95_ms"].cast("long"), x["n"])), ",")
    return analytics.pipeline_stats(clips).select("clips", "voice", "photo", "llm_model", extractors.alias("extractors"), stages.alias("stages"))


@register("a21_day_counters", """select count(*) as clips, coalesce(sum(floor(value * 8) / 8), 0)::double as seconds, count(*) filter (event_type = 'purchase') as sent from events where ts >= timestamp '2024-01-09' and ts < timestamp '2024-01-10'""")
def _day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.on_day(_read(spark, sf_dir, "events"), "2024-01-09", "ts")
    return analytics.day_counters(rows.select((F.floor(F.col("value") * 8) / 8).alias("seconds"), F.when(F.col("event_type") == "purchase", "sent").alias("status")))


@register("a22_trace_totals", """select event_id as clip_id, (case when event_id % 7 = 0 then 0 else floor(value * 10) end + case when event_id % 7 = 0 or event_id % 4 = 1 then 0 else floor(value * 25) end)::double as total_ms, (event_id % 3)::int as flagged from events where event_id % 2 = 0""")
def _trace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.when(i <= F.col("clip_id") % 3, F.array(F.lit("skuId"))).otherwise(F.array().cast("array<string>")).alias("flagged_fields")))
    return analytics.trace_totals(bridge.table(spark, sf_dir, "clips").withColumn("observations", observations))


@register("t4_outlet_names", """with o as (select c_custkey, c_custkey % 3 as co, 23.78::double + (c_custkey * 37) % 400 * 0.0001::double as lat, 90.40::double + (c_custkey * 91) % 400 * 0.0001::double as lng from customer where c_custkey % 12 <> 0),
  c as (select s_suppkey, s_suppkey % 3 as co, 23.78::double + s_suppkey % 400 * 0.0001::double as lat, 90.4::double + s_suppkey * 3 % 400 * 0.0001::double as lng from supplier),
  d as (select s_suppkey, c_custkey, 2 * 6371000.0::double * asin(least(1, sqrt(pow(sin((radians(o.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(o.lat)) * pow(sin((radians(o.lng) - radians(c.lng)) / 2), 2)))) as m from c join o using (co) where abs(o.lat - c.lat) < 0.01 and abs(o.lng - c.lng) < 0.01),
  r as (select *, count(*) over (partition by s_suppkey) as n, row_number() over (partition by s_suppkey order by floor((1 - m / 120) * 10000 + 0.5) desc, m, 'OUT-' || c_custkey) as place from d where m <= 120)
  select s_suppkey as clip_id, 'OUT-' || c_custkey as outlet_id, (floor(m * 10 + 0.5) / 10)::double as distance_m, (floor((1 - m / 120) * 10000 + 0.5) / 10000)::double as score, n::int as near from r where place = 1""")
def _outlet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that say no shop's name: outlets are ranked by nearness alone."""
    said = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as clip_id", "concat('co', cast(s_suppkey % 3 as string)) as company_id", "'আজ' as text", "23.78D + s_suppkey % 400 * 0.0001D as lat", "90.4D + s_suppkey * 3 % 400 * 0.0001D as lng", "cast(null as string) as declared_outlet_id")
    found = resolve.resolve_outlets(said, bridge.table(spark, sf_dir, "outlets")).withColumn("top", F.get("outlet.candidates", F.lit(0))).filter("top is not null")
    return found.select("clip_id", "top.outlet_id", "top.distance_m", "top.score", F.col("outlet.gps_candidates").alias("near"))


@register("o6_nearest_outlets", bridge.ctes("outlets") + """, c as (select s_suppkey, 'co' || s_suppkey % 3 as company_id, 23.78::double + s_suppkey % 400 * 0.0001::double as lat, 90.4::double + s_suppkey * 3 % 400 * 0.0001::double as lng from supplier),
  d as (select s_suppkey as point_id, outlet_id, 2 * 6371000.0::double * asin(least(1, sqrt(pow(sin((radians(o.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(o.lat)) * pow(sin((radians(o.lng) - radians(c.lng)) / 2), 2)))) as m from c join outlets o using (company_id) where active),
  r as (select *, row_number() over (partition by point_id order by m, outlet_id) as rank from d where m <= 600)
  select point_id, outlet_id, rank::int as rank from r where rank <= 3""")
def _nearest_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as point_id", "concat('co', cast(s_suppkey % 3 as string)) as company_id", "23.78D + s_suppkey % 400 * 0.0001D as lat", "90.4D + s_suppkey * 3 % 400 * 0.0001D as lng")
    return matching.nearest_outlets(points, bridge.table(spark, sf_dir, "outlets"), 600.0, 3).drop("distance_m")


@register("a20_card_confidence", bridge.ctes("observations") + "select observation_id, round(coalesce(list_avg(list_filter([c_skuId, c_outletId, c_quantity], lambda x: x is not null)), 0), 9) as confidence from observations")
def _card_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "observations").select("observation_id", F.round(compat.card_confidence("field_confidence"), 9).alias("confidence"))


OFFERED_SQL = """select p_partkey as k, case p_partkey % 5 when 0 then '' when 1 then 'O' || p_partkey % 100 when 2 then 'O' || p_partkey % 100 || ',O' || (p_partkey % 100 + 1)
  else 'O' || p_partkey % 100 || ',O' || (p_partkey % 100 + 1) || ',O' || (p_partkey % 100 + 2) || ',O' || (p_partkey % 100 + 3) end as outlets, case when p_partkey % 3 = 0 then 'C' || p_partkey % 50 else '' end as rival from part"""


@register("u1_offered", f"select k as clip_id, outlets as outlet_ids, 'S' || k || ',S' || (k + 1) as sku_ids, rival as competitor_brands from ({OFFERED_SQL})")
def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clips of many shapes offer to choose from."""
    known = _known(spark, sf_dir)
    words = assemble.vocabulary(F.col("outlet"), F.col("skus"))
    return known.select("clip_id", *(F.array_join(words[c], ",").alias(c) for c in ("outlet_ids", "sku_ids", "competitor_brands")))


@register("t5d_assembled", f"""with o as ({OFFERED_SQL}) select k as clip_id, 0 as place, 'demand_signal' as type, nullif(split_part(outlets, ',', 1), '') as outlet_id, 'S' || k as sku_id, null::varchar as competitor_brand, (k % 9)::double + 0.5 as quantity, 'kg' as unit, 'medium' as severity from o
  union all select k, 1, 'competitor_promo', nullif(split_part(outlets, ',', 1), ''), null, rival, null, null, 'high' from o where rival <> ''""")
def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demand signal for each clip, and a promotion where a competitor was heard."""
    found = assemble.assembled(_known(spark, sf_dir))
    return found.select("clip_id", "place", *(F.col("observation")[c].alias(c) for c in ("type", "outlet_id", "sku_id", "competitor_brand", "quantity", "unit", "severity")))
