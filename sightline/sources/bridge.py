"""Domain tables derived from the general tables by arithmetic that any SQL engine repeats.

Each column is one SQL expression, valid in Spark and, but for the JSON accessor, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}

#: Named fields and the multiplier that spreads their confidences.
SCORED = {"skuId": 13, "outletId": 17, "quantity": 29}

OBSERVATIONS = {
    "observation_id": "event_id",
    "clip_id": "event_id - event_id % 2",
    "company_id": "concat('co', cast(user_id % 3 as string))",
    "rep_id": "concat('REP-', cast(user_id % 40 as string))",
    "type": "case event_type when 'click' then 'competitor_promo' when 'purchase' then 'demand_signal' when 'error' then 'stock_out' when 'signup' then 'retailer_complaint' else 'price_change' end",
    "outlet_id": "case when event_id % 11 = 0 then null else concat('OUT-', cast((event_id * 7 + {k}) % 20 as string)) end",
    "sku_id": "case when event_id % 7 = 0 then null else concat('SKU-', cast({k} % 5 as string)) end",
    "competitor_brand": "case when event_id % 3 = 0 then null else concat('COMP-', cast({k} % 4 as string)) end",
    "quantity": "case when event_id % 4 = 0 then null else cast(floor(value) as double) end",
    "price_delta": "case when event_id % 5 < 2 then -cast(floor(value * 8) as double) / 8 end",
    "severity": "case when value < 30 then 'low' when value < 70 then 'medium' else 'high' end",
    "status": "case event_id % 10 when 0 then 'discarded' when 1 then 'needs_clarification' when 2 then 'needs_clarification' when 3 then null else 'confirmed' end",
    **{f"c_{name}": f"case when event_id % 4 > {i} then cast((event_id * {m}) % 101 as double) / 100 end" for i, (name, m) in enumerate(SCORED.items())},
    "value": "value",
    "recorded_at": "ts",
}

CLIPS = {
    "clip_id": "event_id",
    "company_id": "concat('co', cast(user_id % 3 as string))",
    "rep_id": "concat('REP-', cast(user_id % 45 as string))",
    "source": "case when event_id % 13 = 0 then null when event_id % 5 = 0 then 'photo' else 'voice' end",
    "status": "case when event_id % 9 = 0 then 'failed' else 'processed' end",
    "extractor": "case when event_id % 7 = 0 then null else concat('asr-', cast({k} % 3 as string)) end",
    "extractor_model": "case when event_id % 7 = 0 then null else concat('m', cast({k} % 2 as string)) end",
    "llm_model": "case when event_id % 7 = 0 then null else concat('llm-', cast(event_id % 4 as string)) end",
    "simulated": "event_id % 6 = 0",
    "extraction_confidence": "case when event_id % 8 = 0 then null else cast((event_id * 31) % 1000 as double) / 1000 end",
    "t_transcribe": "case when event_id % 7 = 0 then null else cast(floor(value * 10) as double) end",
    "t_assemble": "case when event_id % 7 = 0 or event_id % 4 = 1 then null else cast(floor(value * 25) as double) end",
    "recorded_at": "ts",
}

SKUS = {
    "company_id": "concat('co', cast(p_partkey % 3 as string))",
    "sku_id": "concat('SKU-', cast(p_partkey as string))",
    "name": "p_name",
    "brand": "p_brand",
    "pack": "cast(p_size as string)",
    "is_competitor": "p_partkey % 7 = 0",
    "active": "p_partkey % 10 <> 0",
}

OUTLETS = {
    "outlet_id": "concat('OUT-', cast(c_custkey as string))",
    "company_id": "concat('co', cast(c_custkey % 3 as string))",
    "name": "c_name",
    "lat": "23.78 + cast((c_custkey * 37) % 400 as double) * 0.0001",
    "lng": "90.40 + cast((c_custkey * 91) % 400 as double) * 0.0001",
    "active": "c_custkey % 12 <> 0",
}

TABLES = {"observations": ("events", OBSERVATIONS, ""), "clips": ("events", CLIPS, "event_id % 2 = 0"), "skus": ("part", SKUS, ""), "outlets": ("customer", OUTLETS, "")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; observations also get field_confidence and flagged_fields, clips timings."""
    source, columns, where = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    rows = (rows.filter(where) if where else rows).selectExpr(*(f"{e.format(k=KEY['spark'])} as {c}" for c, e in columns.items()))
    if name == "observations":
        entries = ", ".join(f"struct('{f}' as key, c_{f} as value)" for f in SCORED)
        known = f"filter(array({entries}), x -> x.value is not null)"
        flagged = f"transform(filter({known}, x -> x.value < 0.8), x -> x.key)"
        rows = rows.selectExpr("*", f"map_from_entries({known}) as field_confidence", f"{flagged} as flagged_fields").drop(*(f"c_{f}" for f in SCORED))
    if name == "clips":
        stages = "array(struct('transcribe' as key, t_transcribe as value), struct('assemble' as key, t_assemble as value))"
        rows = rows.selectExpr("*", f"map_from_entries(filter({stages}, x -> x.value is not null)) as timings").drop("t_transcribe", "t_assemble")
    return rows


def ctes(*names: str) -> str:
    """The same tables as DuckDB common table expressions; maps stay plain columns."""
    parts = []
    for name in names:
        source, columns, where = TABLES[name]
        body = ", ".join(f"{e.format(k=KEY['duckdb'])} as {c}" for c, e in columns.items())
        parts.append(f"{name} as (select {body} from {source}{f' where {where}' if where else ''})")
    return "with " + ", ".join(parts) + " "
