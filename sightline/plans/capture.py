"""Queries of the capture pipeline: resolvers, assembly, confidence, clarification, import and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, text
from ..operators import analytics, assemble, clarify, evaluation, quantities, resolve, state
from ..sources import bridge, imports
from .registry import register, values

COMPANY = "acme-bd"
# A catalogue, its aliases and outlets around one place.
SKUS = [
    ("SKU-404", "PRAN Mango Juice", "PRAN", "250ml", None, False), ("SKU-407", "PRAN Mango Drink", "PRAN", "1L", None, False), ("SKU-410", "PRAN Litchi Juice", "PRAN", "250ml", None, False),
    ("SKU-420", "PRAN Chanachur", "PRAN", "150g", None, False), ("SKU-501", "Surf Excel Powder", "Surf Excel", "500g", "Unilever", False), ("SKU-502", "Lux Soap", "Lux", "100g", "Unilever", False),
    ("SKU-504", "Sunsilk Shampoo", "Sunsilk", "180ml", "Unilever", False), ("SKU-503", "Harpic Toilet Cleaner", "Harpic", "500ml", None, False), ("SKU-601", "Colgate Toothpaste", "Colgate", "100g", None, False),
    ("COMP-WHEEL", "Wheel", "Wheel", None, None, True), ("COMP-WHITEPLUS", "White Plus", "White Plus", None, None, True), ("COMP-RIN", "Rin Powder", "Rin", None, None, True),
]
ALIASES = [("SKU-420", "চানাচুর")]
PLACE = (23.7806, 90.4074)
OUTLETS = [("OUT-1182", "Bijoy Store", 0.00016, 0.0, True), ("OUT-1183", "Rahman Store", 0.00009, 0.00008, True), ("OUT-1184", "New Alam Enterprise", -0.00014, 0.00005, True), ("OUT-9001", "Faraway Traders", 0.02, 0.02, True), ("OUT-9002", "Closed Shop", 0.0001, 0.0, False)]
CLEAN = "বিজয় স্টোরে প্রাণ ম্যাঙ্গো জুস দেড় ডজন লাগবে, আর হুইল এর নতুন অফার দিছে, পাঁচ টাকা কম"
CORRUPTED = "বিজয় স্টরে প্রান ম্যাঙ্গো জুস দের ডজন লাগবে আর হইল এর নতুন অফার দিছে পাচ টাকা কম"


def skus(spark: SparkSession) -> DataFrame:
    rows = [(COMPANY, *r, True) for r in SKUS]
    return spark.createDataFrame(rows, "company_id string, sku_id string, name string, brand string, pack string, manufacturer string, is_competitor boolean, active boolean")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(COMPANY, *r) for r in ALIASES], "company_id string, sku_id string, surface string")


def outlets(spark: SparkSession) -> DataFrame:
    rows = [(COMPANY, i, name, PLACE[0] + a, PLACE[1] + b, active) for i, name, a, b, active in OUTLETS]
    return spark.createDataFrame(rows, "company_id string, outlet_id string, name string, lat double, lng double, active boolean")


def clips(spark: SparkSession, texts: list[str | None], brands: list[list[str] | None] | None = None, declared: list[str | None] | None = None, placed: bool = True, confidence: float = 0.95) -> DataFrame:
    rows = [(k, COMPANY, t, brands[k] if brands else None, PLACE[0] if placed else None, PLACE[1] if placed else None, declared[k] if declared else None) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "clip_id long, company_id string, text string, brands array<string>, lat double, lng double, declared_outlet_id string")
    return table.withColumn("words", text.transcript_words("text", confidence))


def said_by(rows: DataFrame, key: str, said: DataFrame, n: int) -> DataFrame:
    """Each row of a table as a clip that says one of ``n`` fixed things, by its key; clip_id is the key."""
    return rows.select(F.col(key).alias("_key"), (F.col(key) % n).alias("clip_id")).join(F.broadcast(said), "clip_id").withColumn("clip_id", F.col("_key")).drop("_key")


def annotations(spark: SparkSession, of: DataFrame) -> DataFrame:
    found = quantities.quantities(of.select(F.col("clip_id").alias("doc_id"), "text"))
    return assemble.annotated(of, resolve.resolve_outlets(of, outlets(spark)), resolve.resolve_products(of, skus(spark), aliases(spark)), found)


# What is said, and the product it means; no product where several are as likely.
SAID = [
    ("প্রাণ ম্যাঙ্গো জুস", ["SKU-404"]), ("প্রান ম্যাঙ্গো জুস", ["SKU-404"]), ("হুইল", ["COMP-WHEEL"]), ("হইল", ["COMP-WHEEL"]), ("প্রাণ ম্যাঙ্গো", [None]), ("হারপিক", ["SKU-503"]), ("চানাচুর", ["SKU-420"]),
    ("সার্ফ এক্সেল", ["SKU-501"]), ("প্রাণ", [None]), ("ইউনিলিভার", [None]), ("আজকে দোকান বন্ধ ছিল", []), ("দেড় ডজন", []), (CLEAN, ["SKU-404", "COMP-WHEEL"]), (CORRUPTED, ["SKU-404", "COMP-WHEEL"]),
]


@register("fixture_t3_skus", "select s_suppkey as clip_id, n::bigint as n, sku_id::varchar as sku_id from supplier join (values " + values([(k, i + 1, s) for k, (_, found) in enumerate(SAID) for i, s in enumerate(found)]) + f") t(i, n, sku_id) on s_suppkey % {len(SAID) + 1} = i")
def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier says one of the fixed phrases; the last is out of its brands' scope."""
    said = clips(spark, [t for t, _ in SAID] + ["চানাচুর"], [None] * len(SAID) + [["Lux"]])
    said = said_by(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", said, len(SAID) + 1)
    found = resolve.resolve_products(said, skus(spark), aliases(spark)).select("clip_id", F.posexplode("skus").alias("n", "m"))
    sure = F.when((F.col("m.margin") >= 0.1) | (F.size("m.candidates") == 1), F.get("m.candidates", F.lit(0))["sku_id"])
    return found.select("clip_id", (F.col("n") + 1).cast("long").alias("n"), sure.alias("sku_id"))


# What is said, a declared outlet, whether the place is known; then the outlet (none if unsure), outlets near, whether it was declared.
VISITS = [("বিজয় স্টোরে", None, True, "OUT-1182", 3, False), ("রহমান স্টোরে", None, True, "OUT-1183", 3, False), ("স্টোরে", None, True, None, 3, False), ("", "OUT-1182", True, "OUT-1182", 1, True), ("বিজয় স্টোরে", "OUT-404", True, "OUT-1182", 3, False), ("বিজয় স্টোরে", None, False, None, 0, False)]


@register("fixture_t4_outlets", "select s_suppkey as clip_id, outlet_id::varchar as outlet_id, near::int as near, declared from supplier join (values " + values([(k, o, n, d) for k, (_, _, _, o, n, d) in enumerate(VISITS)]) + f") t(i, outlet_id, near, declared) on s_suppkey % {len(VISITS)} = i")
def _outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = clips(spark, [v[0] for v in VISITS], declared=[v[1] for v in VISITS])
    known = F.array(*(F.lit(v[2]) for v in VISITS))[F.col("clip_id").cast("int")]
    said = said.withColumns({c: F.when(known, F.col(c)) for c in ("lat", "lng")})
    said = said_by(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", said, len(VISITS))
    o = F.col("outlet")
    found = resolve.resolve_outlets(said, outlets(spark))
    return found.select("clip_id", F.when(o["margin"] > 0.25, F.get(o["candidates"], F.lit(0))["outlet_id"]).alias("outlet_id"), o["gps_candidates"].alias("near"), o["declared"].alias("declared"))


# The observations of the clean and the corrupted clip.
OBSERVED = [(0, "demand_signal", "OUT-1182", "SKU-404", None, 18.0, "piece", None), (1, "competitor_promo", "OUT-1182", None, "COMP-WHEEL", None, None, -5.0)]


@register("fixture_e2e_corrupted_clip", "select s_suppkey as clip_id, place::int as place, type, outlet_id, sku_id, competitor_brand, quantity::double as quantity, unit, price_delta::double as price_delta from supplier, (values " + values(OBSERVED) + ") t(place, type, outlet_id, sku_id, competitor_brand, quantity, unit, price_delta)")
def _end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the suppliers say the clean text, half the corrupted one."""
    said = said_by(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", clips(spark, [CLEAN, CORRUPTED]), 2)
    known = annotations(spark, said)
    done = assemble.scored(assemble.assembled(known), known)
    o = F.col("observation")
    return done.select("clip_id", "place", *(o[c].alias(c) for c in ("type", "outlet_id", "sku_id", "competitor_brand", "quantity", "unit", "price_delta")))


#: Made-up clips that one task has.
CLIPS_A_TASK = 100_000

CANDIDATE = "struct<outlet_id:string,name:string,distance_m:double,name_score:double,score:double>"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _annotated_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A clip and an observation for each event: one word spans all, margins and scores are arithmetic on event_id."""
    keys = _events(spark, sf_dir).select("event_id")
    # keys are dealt by number, for what is made of them is wide, and partitions that Spark sizes by their compressed bytes are then too large
    rows = keys.repartition(1 + keys.count() // CLIPS_A_TASK, "event_id").selectExpr(
        "event_id as clip_id",
        "array(named_struct('w', 'x', 's', 0, 'e', 10, 'conf', cast(event_id % 101 as double) / 100)) as words",
        f"""named_struct('s', if(event_id % 4 = 0, null, 0), 'e', if(event_id % 4 = 0, null, 10), 'raw', 'x', 'candidates',
          cast(if(event_id % 11 = 0, array(), array(named_struct('outlet_id', 'O', 'name', 'o', 'distance_m', 1.0D, 'name_score', 0.0D, 'score', cast(event_id % 10 as double) / 10))) as array<{CANDIDATE}>),
          'margin', cast(event_id % 7 as double) / 20, 'gps_candidates', 1, 'declared', event_id % 3 = 0) as outlet""",
        f"""cast(array(named_struct('s', 0, 'e', 10, 'raw', 'x', 'candidates', array(
          named_struct('sku_id', 'A', 'name', 'a', 'brand', 'b', 'is_competitor', false, 'score', 0.6D + cast(event_id % 5 as double) / 10, 'via_alias', if(event_id % 7 = 0, 'x', null)),
          named_struct('sku_id', 'B', 'name', 'b', 'brand', 'b', 'is_competitor', false, 'score', 0.5D, 'via_alias', null)),
          'margin', cast(event_id % 9 as double) / 20)) as array<struct<s:int,e:int,raw:string,candidates:{resolve.CANDIDATES},margin:double>>) as skus""",
        "array(named_struct('s', 0, 'e', 10, 'value', cast(event_id % 4 as double), 'unit', 'piece', 'basis', '', 'confidence', 0.9D)) as quantities",
        """named_struct('type', 'demand_signal', 'outlet_id', 'O', 'sku_id', if(event_id % 5 = 0, 'B', 'A'), 'competitor_brand', cast(null as string),
          'quantity', if(event_id % 13 = 0, null, cast(event_id % 6 as double)), 'unit', 'piece', 'price_delta', cast(-(event_id % 5) as double), 'severity', 'low', 'verbatim', 'x') as observation""",
    )
    return rows.drop("observation"), rows.select("clip_id", F.lit(0).alias("place"), "observation")


SURE = """with e as (select event_id, (0.0::double + 10 * ((event_id % 101)::double / 100)) / 10.0::double as asr, (event_id % 9)::double / 20 as m, (event_id % 7)::double / 20 as m2 from events),
  f as (select *, 0.55::double + 0.45::double * least(m / 0.3::double, 1.0::double) as mf, 0.55::double + 0.45::double * least(m2 / 0.3::double, 1.0::double) as mf2 from e),
  g as (select event_id,
    case when event_id % 3 = 0 then 1.0::double when event_id % 11 = 0 then 0.0::double when event_id % 4 = 0 then (event_id % 10)::double / 10 * mf2 else asr * mf2 end as o,
    case when event_id % 5 = 0 then asr * mf * 0.5::double * 0.85::double when event_id % 7 = 0 then least(1.0::double, asr * 0.95::double + 0.05::double) else least(1.0::double, asr * mf * (0.6::double + (event_id % 5)::double / 10) * 1.0::double) end as s,
    case when event_id % 13 = 0 then null when event_id % 6 = event_id % 4 then asr * 0.9::double else 0.0::double end as q from f)"""


@register("t6_confidence", SURE + """ select event_id as clip_id, floor(o * 10000 + 0.5) / 10000 as outlet, floor(s * 10000 + 0.5) / 10000 as sku, floor(q * 10000 + 0.5) / 10000 as quantity, floor(coalesce(q, 0.9::double) * 10000 + 0.5) / 10000 as unit,
  case when o < 0.8::double or s < 0.8::double or q < 0.8::double then 'needs_clarification' else 'confirmed' end as status from g""")
def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = _annotated_events(spark, sf_dir)
    m = F.col("field_confidence")
    return assemble.scored(observed, known).select("clip_id", m["outletId"].alias("outlet"), m["skuId"].alias("sku"), m["quantity"].alias("quantity"), m["unit"].alias("unit"), "status")


@register("f12_enum_lock", """select event_id, (a is null or a in ('A', 'B')) and (o is null or (event_id % 11 <> 0 and o = 'O')) as allowed from (select event_id, case event_id % 3 when 0 then 'A' when 1 then 'C' end as a, case event_id % 2 when 0 then 'O' end as o from events)""")
def _enum_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = _annotated_events(spark, sf_dir)
    o = F.col("observation")
    key = F.col("clip_id")
    o = o.withField("sku_id", F.when(key % 3 == 0, "A").when(key % 3 == 1, "C")).withField("outlet_id", F.when(key % 2 == 0, "O"))
    return observed.join(known, "clip_id").select(key.alias("event_id"), assemble.identity_allowed(o, assemble.vocabulary(F.col("outlet"), F.col("skus"))).alias("allowed"))


@register("f13_number_lock", """select event_id, case when q = event_id % 4 then q end::double as quantity, case when q is null or q = event_id % 4 then 'piece' end as unit, case when event_id % 5 = event_id % 4 then -(event_id % 5) end::double as price_delta,
  ((q is not null and q <> event_id % 4)::int + (event_id % 5 <> event_id % 4)::int) as rejected from (select event_id, case when event_id % 13 = 0 then null else event_id % 6 end as q from events)""")
def _number_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = _annotated_events(spark, sf_dir)
    done = observed.join(known, "clip_id").select("clip_id", assemble.locked_numbers(F.col("observation"), F.col("quantities")).alias("x"))
    return done.select(F.col("clip_id").alias("event_id"), "x.observation.quantity", "x.observation.unit", "x.observation.price_delta", F.size("x.rejected").alias("rejected"))


@register("t5d_assemble", """select event_id as clip_id, 'demand_signal' as type, case when event_id % 11 <> 0 then 'O' end as outlet_id, 'A' as sku_id, (event_id % 4)::double as quantity, 'piece' as unit, 'medium' as severity from events""")
def _assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _annotated_events(spark, sf_dir)
    return assemble.assembled(known.withColumn("text", F.lit("x"))).select("clip_id", *(F.col("observation")[c].alias(c) for c in ("type", "outlet_id", "sku_id", "quantity", "unit", "severity")))


@register("u1_vocabulary", "select event_id, case when event_id % 11 <> 0 then 'O' else '' end as outlet_ids, 'A,B' as sku_ids, '' as competitor_brands from events")
def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _annotated_events(spark, sf_dir)
    v = assemble.vocabulary(F.col("outlet"), F.col("skus"))
    return known.select(F.col("clip_id").alias("event_id"), *(F.array_join(v[c], ",").alias(c) for c in ("outlet_ids", "sku_ids", "competitor_brands")))


@register("c1_clarifications", SURE + """ select event_id as clip_id, 'skuId' as field, 'sku' as kind, 'A,B' as options, case when event_id % 5 = 0 then 'B' else 'A' end as current_value, floor(s * 10000 + 0.5) / 10000 as confidence, '2024-02-02 00:00:00' as expires_at from g where s < 0.8::double""")
def _clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outlet or one quantity is nothing to choose between, so only products are asked about."""
    known, observed = _annotated_events(spark, sf_dir)
    asked = clarify.clarifications(assemble.scored(observed, known), known, "2024-02-01 00:00:00")
    offered = F.array_join(F.transform("options", lambda o: o["value"]), ",")
    return asked.select("clip_id", "field", "kind", offered.alias("options"), "current_value", "confidence", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register("c5_apply_answer", SURE + """ select event_id as clip_id, 'B' as sku_id, 1.0::double as confidence, case when o < 0.8::double or q < 0.8::double then 'needs_clarification' else 'confirmed' end as status from g where s < 0.8::double""")
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, observed = _annotated_events(spark, sf_dir)
    flagged = assemble.scored(observed, known).filter(F.array_contains("flagged_fields", "skuId"))
    done = clarify.settled(flagged, "skuId", F.lit("B"), F.lit(True))
    return done.select("clip_id", F.col("observation.sku_id").alias("sku_id"), F.col("field_confidence")["skuId"].alias("confidence"), "status")


@register("j6_declared_outlet", """with p as (select s_suppkey as clip_id, case when s_suppkey % 2 = 0 then 'OUT-' || (s_suppkey * 3) end as declared from supplier) select clip_id, declared is not null and exists (select 1 from customer c where c.c_custkey % 3 = clip_id % 3 and declared = 'OUT-' || c.c_custkey) as declared from p""")
def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the clips name an outlet, which counts if the tenant has it."""
    said = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as clip_id", "concat('co', cast(s_suppkey % 3 as string)) as company_id", "cast(null as string) as text", "23.78D + s_suppkey % 400 * 0.0001D as lat", "90.4D as lng", "case when s_suppkey % 2 = 0 then concat('OUT-', cast(s_suppkey * 3 as string)) end as declared_outlet_id")
    return resolve.resolve_outlets(said, bridge.table(spark, sf_dir, "outlets")).select("clip_id", "outlet.declared")




@register("s5_import_report", """with c as (select row_number() over (order by p_partkey) + 1 as row from part), b as (select row, row % 7 = 0 as a, row % 11 = 0 as b from c)
  select row::int as row, case when a and b then 'skuId: String must contain at least 1 character(s); name: String must contain at least 1 character(s)' when a then 'skuId: String must contain at least 1 character(s)' else 'name: String must contain at least 1 character(s)' end as reason from b where a or b""")
def _import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the rows of a file, some of whose cells are blank."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.col("p_brand").alias("brand"))
    parts = imports.numbered(parts, "p_partkey").withColumn("row", F.col("row").cast("int"))
    cells = parts.select("row", F.when(F.col("row") % 7 == 0, "").otherwise(F.concat(F.lit("S"), "row")).alias("skuId"), F.when(F.col("row") % 11 == 0, "").otherwise(F.col("p_name")).alias("name"), "brand")
    return imports.sku_rows(cells, COMPANY)[1]


@register("x70_wer", """select p_partkey, round(case p_partkey % 4 when 0 then 0.0 when 1 then 1.0 when 2 then 1.0 else 2.0 end::double / len(string_split(p_name, ' ')), 9) as wer from part""")
def _wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as heard: whole, with a word more, without the first, and with another first and a word more."""
    rest = F.concat_ws(" ", F.slice(F.split("p_name", " "), 2, 99))
    k = F.col("p_partkey") % 4
    heard = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" zz"))).when(k == 2, rest).otherwise(F.concat(F.lit("yy "), rest, F.lit(" zz")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("reference"), heard.alias("heard"))
    return evaluation.with_wer(rows).select("p_partkey", F.round("wer", 9).alias("wer"))


@register("o5_alias_queue", bridge.ctes("observations") + "select company_id, sku_id as surface, count(*) as occurrences, max(recorded_at) as last_seen from observations where sku_id is not null group by 1, 2 order by occurrences desc, last_seen desc, company_id, surface limit 50")
def _alias_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = bridge.table(spark, sf_dir, "observations").filter("sku_id is not null").groupBy("company_id", F.col("sku_id").alias("surface"))
    return clarify.approval_queue(seen.agg(F.count("*").alias("occurrences"), F.max("recorded_at").alias("last_seen")).withColumn("status", F.lit("pending"))).drop("status")


@register("a16_calibration_error", """with s as (select (event_id * 13 % 101)::double / 100 as conf, (event_id % 3 <> 0)::int as hit from events), b as (select least(floor(conf * 10 + 1e-9), 9) as bin, count(*) as n, avg(conf) as c, avg(hit) as h, sum((conf - hit) * (conf - hit)) as q from s group by 1)
  select floor(sum(n * abs(c - h)) / sum(n) * 10000 + 0.5) / 10000 as ece, floor(sum(q) / sum(n) * 10000 + 0.5) / 10000 as brier from b""")
def _calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_error(_events(spark, sf_dir).selectExpr("cast((event_id * 13) % 101 as double) / 100 as conf", "event_id % 3 <> 0 as correct"))


FIELD = "event_type as field, case when event_id % 5 = 0 then null else event_id % 3 end as truth, case when event_id % 7 = 0 then null else event_id % 4 end as predicted"


@register("a15_overall_accuracy", f"select floor(count(*) filter (truth = predicted)::double / count(*) filter (truth is not null or predicted is not null) * 10000 + 0.5) / 10000 as accuracy from (select {FIELD} from events)")
def _overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of two halves of the events, merged."""
    rows = _events(spark, sf_dir).selectExpr("event_id", "event_type as field", "case when event_id % 5 = 0 then null else event_id % 3 end as truth", "case when event_id % 7 = 0 then null else event_id % 4 end as predicted")
    halves = [evaluation.field_tallies(rows.filter(f"event_id % 2 = {k}")) for k in (0, 1)]
    return evaluation.overall_accuracy(evaluation.merged_tallies(*halves))


@register("j10_matching", """select event_id as clip_id, case when event_id % 3 = 0 then 2 else 0 end + case when event_id % 3 = 1 then 2 else 0 end as crossed, case when event_id % 4 = 0 then 1 else 0 end as spare from events""")
def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two true rows and the same two predicted, in either order, with a third at times."""
    row = lambda sku: "named_struct(" + ", ".join(f"'{c}', " + (sku if c == "sku_id" else "cast(null as string)") for c in evaluation.SCORED) + ")"
    rows = _events(spark, sf_dir).selectExpr("event_id as clip_id", f"array({row("'a'")}, {row("'b'")}) as truth", f"concat(if(event_id % 3 = 0, array({row("'b'")}, {row("'a'")}), if(event_id % 3 = 1, array({row("'b'")}, {row("'a'")}), array({row("'a'")}, {row("'b'")}))), if(event_id % 4 = 0, array({row("'c'")}), array())) as predicted")
    pairs = evaluation.matched(rows)
    equal = F.col("t.sku_id") == F.col("p.sku_id")
    return pairs.groupBy("clip_id").agg((F.sum(F.when(equal & (F.col("clip_id") % 3 != 2), 1).otherwise(0))).cast("int").alias("crossed"), F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).cast("int").alias("spare"))


@register("p8_price_text", bridge.ctes("observations") + "select observation_id, '৳' || regexp_replace(format('{:,.3f}', abs(price_delta)), '\\.?0+$', '') || case when price_delta < 0 then ' less' else ' more' end as words from observations where price_delta is not null")
def _price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.table(spark, sf_dir, "observations").filter("price_delta is not null")
    return rows.select("observation_id", compat.price_text("price_delta").alias("words"))


@register("x37_segment_confidence", "select event_id, floor(case when event_id % 9 = 0 then 0.75::double else exp(-(event_id % 20)::double / 10) * (1 - (event_id % 11)::double / 10) * case when event_id % 4 = 3 then 0.5::double else 1.0::double end end * 10000 + 0.5) / 10000 as conf from events")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id", "if(event_id % 9 = 0, null, -cast(event_id % 20 as double) / 10) as lp", "cast(event_id % 11 as double) / 10 as ns", "cast(event_id % 4 as double) as cr")
    return rows.select("event_id", text.segment_confidence("lp", "ns", "cr").alias("conf"))


@register("g1_dedupe", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    return state.insert_new(rows.limit(0), rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("k4_field_patch", "with p as (select event_id % 500 as k, value as v, ts, event_id from events), l as (select k, arg_max(v, (ts, event_id)) as v from p group by 1) select c_custkey, case when l.k is null then c_acctbal else l.v end as c_acctbal from customer left join l on l.k = c_custkey")
def _patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    patches = _events(spark, sf_dir).select((F.col("event_id") % 500).alias("c_custkey"), F.lit("c_acctbal").alias("field"), F.col("value").cast("string").alias("value"), F.struct("ts", "event_id").alias("at"))
    return state.patched(rows, patches, "c_custkey", ["c_acctbal"])


@register("f20_day", "select event_id from events where cast(ts as date) = date '2024-01-09'")
def _day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.on_day(_events(spark, sf_dir), "2024-01-09", "ts").select("event_id")


@register("t3_part_names", None)
def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name, spoken, against the tenant's own parts as a catalogue. Tests hold it against brute force."""
    parts = bridge.table(spark, sf_dir, "skus").withColumn("manufacturer", F.lit(None).cast("string"))
    said = parts.select(F.col("sku_id").alias("clip_id"), "company_id", F.col("name").alias("text"), F.lit(None).cast("array<string>").alias("brands"))
    none = spark.createDataFrame([], "company_id string, sku_id string, surface string")
    found = resolve.resolve_products(said, parts, none).select("clip_id", F.posexplode("skus").alias("n", "m"))
    return found.select("clip_id", "n", F.get("m.candidates", F.lit(0))["sku_id"].alias("sku_id"), F.get("m.candidates", F.lit(0))["score"].alias("score"), "m.margin")
