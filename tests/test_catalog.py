"""Every registered query with SQL equals DuckDB on the same tables; edge cases of the operators."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.functions import compat, text
from sightline.operators import analytics, evaluation, matching, state
from sightline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(value):
    return round(value, 7) + 0.0 if isinstance(value, float) else str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(catalog.SQL[name])
    names = expected.columns
    assert sorted(names) == columns
    mine = Counter(tuple(same(r[c]) for c in columns) for r in got.collect())
    theirs = Counter(tuple(same(dict(zip(names, r, strict=True))[c]) for c in columns) for r in expected.fetchall())
    assert mine == theirs


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_empty_scope_is_one_row_of_zeros(spark):
    row = catalog.QUERIES["a1_summary_empty"](spark, SF).collect()
    assert len(row) == 1 and set(row[0]) == {0}


def test_distinct_counts_null_once(spark):
    rows = spark.createDataFrame([(1,), (None,), (1,), (None,)], "x int")
    assert rows.agg(compat.distinct_with_null("x")).first()[0] == 2
    assert rows.limit(0).agg(compat.distinct_with_null("x")).first()[0] == 0


def test_rounding_rules(spark):
    row = spark.range(1).select(compat.half_up(F.lit(2.5)), compat.half_even(F.lit(2.5)), compat.half_up(F.lit(1.005), 2), compat.half_up(F.lit(-2.5))).first()
    assert tuple(row) == (3.0, 2.0, 1.0, -2.0)


def test_tokens_keep_spans(spark):
    rows = ["(hello), world!  a-b", "…", "", None, " । এক দুই। "]
    for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.tokens("t").alias("x")).collect():
        assert r.x is None if r.t is None else all(r.t[x.s : x.e] == x.text for x in r.x)
    found = spark.createDataFrame([(rows[0],)], "t string").select(text.tokens("t").alias("x")).first().x
    assert [x.text for x in found] == ["hello", "world", "a-b"]


def test_latin_keys(spark):
    words = {"Wheel": "huil", "Excel": "eksel", "New": "niu", "juice": "juis", "mango": "mango", "Store": "stor", "Bijoy": "bijoy", "": ""}
    rows = spark.createDataFrame(list(words.items()), "w string, k string")
    assert [(r.w, r.got) for r in rows.select("w", text.latin_key("w").alias("got")).collect()] == list(words.items())


def test_similarity_of_empty_and_equal(spark):
    rows = spark.createDataFrame([("", "a", 0.0), ("", "", 0.0), ("mango", "mango", 1.0), ("mng", "mango", 0.95)], "a string, b string, s double")
    assert all(abs(r.s - r.got) < 1e-9 for r in rows.select("s", text.key_similarity("a", "b").alias("got")).collect())


def test_p95_of_twenty(spark):
    clips = spark.createDataFrame([({"x": float(i)},) for i in range(1, 21)], "timings map<string,double>")
    row = analytics.stage_latency(clips).first()
    assert (row.avg_ms, row.p95_ms, row.n) == (11.0, 20.0, 20)


def test_geo_join_equals_all_pairs(spark):
    points = spark.createDataFrame([(i, "c", 23.78 + (i * 37 % 97) * 2e-4, 90.4 + (i * 53 % 89) * 2e-4) for i in range(120)], "point_id int, company_id string, lat double, lng double")
    outlets = points.select(F.col("point_id").alias("outlet_id"), "company_id", (F.col("lat") + 3e-4).alias("lat"), (F.col("lng") - 2e-4).alias("lng"), (F.col("point_id") % 9 != 0).alias("active"))
    both = points.join(outlets.filter("active").select("outlet_id", F.col("lat").alias("b"), F.col("lng").alias("d")), F.lit(True))
    expected = both.filter(text.haversine_m("lat", "lng", "b", "d") <= 300).select("point_id", "outlet_id")
    got = matching.within_radius(points, outlets, 300.0).select("point_id", "outlet_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert "NestedLoop" not in matching.within_radius(points, outlets, 300.0)._jdf.queryExecution().toString()


def test_precision_recall_without_cases(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 8, 1, 1, 1), ("c", 0, 1, 0, 0)], "field string, correct long, wrong long, missed long, spurious long")
    got = {r.field: tuple(r)[1:] for r in evaluation.precision_recall(rows).collect()}
    assert got["a"] == (1.0, 1.0, 1.0, 1.0) and got["b"][:3] == (0.8, 0.8, 0.8) and got["c"] == (0.0, 0.0, 0.0, 0.0)


def test_prompt_histories(spark):
    events = [("p1", 1, "create", None), ("p1", 2, "answer", "A"), ("p1", 3, "answer", "B"), ("p2", 1, "create", None), ("p2", 5, "timeout", None), ("p2", 6, "answer", "C")]
    events += [("p3", 1, "create", None), ("p3", 2, "cancel", None), ("p3", 3, "answer", "D"), ("p4", 1, "create", None), ("p4", 5, "timeout", None), ("p5", 1, "create", None)]
    got = {r.prompt_id: tuple(r)[1:] for r in state.fold_prompts(spark.createDataFrame(events, "prompt_id string, at int, kind string, value string")).collect()}
    assert got == {"p1": ("answered", "A", False), "p2": ("answered", "C", True), "p3": ("cancelled", None, False), "p4": ("auto_resolved", None, False), "p5": ("pending", None, False)}
