"""Stored tables with a key, and the stage cache on top of one."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import stage_cache, state
from sightline.sources.keyed_table import MOST_FOLDERS, Conflict, KeyedTable

SCHEMA = "k long, v string, n long"


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, ["k"], 8)


@pytest.fixture
def rows(spark):
    return lambda given: spark.createDataFrame(given, SCHEMA)


def test_insert_upsert_and_replace_equal_their_folds(spark, table, rows):
    first = rows([(1, "a", 1), (2, "b", 1), (1, "c", 0), (None, "z", 1), (None, "y", 0)])
    assert table.read().count() == 0 and table.insert(first, ["n"])
    assert shown(table.read()) == [(1, "c", 0), (2, "b", 1), (None, "y", 0)]
    table.insert(rows([(2, "later", 0), (5, "e", 1)]), ["n"])
    before = table.read()
    table.upsert(rows([(2, "B", 5), (2, "A", 4), (3, "C", 1), (None, "n", 9)]), ["n"])
    new = state.upsert_latest(before.withColumn("at", F.lit(0)).unionByName(rows([(2, "B", 5), (2, "A", 4), (3, "C", 1), (None, "n", 9)]).withColumn("at", F.lit(1))), ["k"], ["at", "n"]).drop("at")
    assert shown(table.read()) == shown(new)
    before, keys, given = table.read(), spark.createDataFrame([(1,), (3,), (77,)], "k long"), rows([(3, "x", 1), (3, "y", 2)])
    table.replace(keys, given)
    assert shown(table.read()) == shown(state.replace_for_keys(before, given, keys, "k"))
    assert shown(KeyedTable(spark, table.path).read()) == shown(table.read())
    assert shown(table.lookup(spark.createDataFrame([(3,), (None,), (8,)], "k long"))) == [(3, "x", 1), (3, "y", 2), (None, "n", 9)]
    table.replace(spark.createDataFrame([(3,)], "k long"), rows([]))
    assert not table.read().filter("k = 3").count()


def test_rows_of_other_keys_are_refused(spark, table, rows):
    table.upsert(rows([(k, "a", k) for k in range(20)]))
    with pytest.raises(ValueError):
        table.replace(spark.createDataFrame([(1,)], "k long"), rows([(k, "b", k) for k in range(20)]))
    assert table.read().filter("v = 'a'").count() == 20


def test_a_batch_counts_once(table, rows):
    add = lambda there, given: there.unionByName(given).groupBy("k", "v").agg(F.sum("n").alias("n"))
    assert table.merge(rows([(1, "a", 5)]), add, ("s", 0)) and table.merge(rows([(1, "a", 2), (2, "a", 1)]), add, ("s", 1))
    assert not table.merge(rows([(1, "a", 2), (2, "a", 1)]), add, ("s", 1)) and not table.merge(rows([(1, "a", 5)]), add, ("s", 0))
    assert table.merge(rows([(1, "a", 1)]), add, ("other", 0))
    assert shown(table.read()) == [(1, "a", 8), (2, "a", 1)]


def test_a_commit_that_dies_changes_nothing(spark, table, rows, monkeypatch):
    table.upsert(rows([(k, "a", k) for k in range(20)]))
    before = shown(table.read())
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(rows([(k, "b", k) for k in range(10)]), batch=("s", 3))
    monkeypatch.undo()
    again = KeyedTable(spark, table.path)
    assert shown(again.read()) == before
    assert again.upsert(rows([(k, "b", k) for k in range(10)]), batch=("s", 3))
    assert again.read().filter("v = 'b'").count() == 10 and again.read().count() == 20
    left = again.vacuum(1)
    assert left > 0 and again.read().count() == 20 and again.vacuum(1) == 0


def test_of_two_writers_one_wins(spark, table, rows, monkeypatch):
    table.insert(rows([(1, "a", 1)]))
    old = dict(table.state)
    other = KeyedTable(spark, table.path)
    other.insert(rows([(2, "b", 1)]))
    monkeypatch.setattr(KeyedTable, "_latest", lambda self: old)  # as if both had read the same version
    with pytest.raises(Conflict):
        table.upsert(rows([(1, "lost", 1)]))
    monkeypatch.undo()
    assert shown(KeyedTable(spark, table.path).read()) == [(1, "a", 1), (2, "b", 1)]


def test_only_touched_buckets_are_written(table, rows):
    table.upsert(rows([(k, "a", k) for k in range(100)]))
    before = dict(table.state["folders"])
    table.upsert(rows([(7, "b", 1)]))
    assert sum(before[b] != table.state["folders"][b] for b in before) == 1 and len(before) == 8


def test_inserts_are_gathered_at_times(table, rows):
    for k in range(MOST_FOLDERS + 3):
        table.insert(rows([(k * 8 + j, "a", k) for j in range(8)]))
    assert table.read().count() == 8 * (MOST_FOLDERS + 3) and max(map(len, table.state["folders"].values())) <= MOST_FOLDERS
    assert table.read().select("k").distinct().count() == table.read().count()


def test_another_shape_is_refused(spark, table):
    with pytest.raises(ValueError):
        KeyedTable.create(spark, table.path, SCHEMA, ["v"], 8)


def test_stage_cache(spark, tmp_path):
    cache = stage_cache.open_cache(spark, str(tmp_path / "cache"), 4)
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.filter("text <> 'hopeless'").select("key", F.struct(F.length("text").alias("n"), F.upper("text").alias("loud")).alias("value"))

    go = lambda given, version="1": {
        r.id: (r.value and tuple(r.value), r.cached)
        for r in stage_cache.through_cache(cache, spark.createDataFrame(given, "id long, text string, lang string"), "shout", version, ["text", "lang"], compute, "n int, loud string").collect()
    }
    first = [(1, "ab", "en"), (2, "ab", "en"), (3, "ab", None), (4, "hopeless", "en")]
    assert go(first) == {1: ((2, "AB"), False), 2: ((2, "AB"), False), 3: ((2, "AB"), False), 4: (None, False)} and seen == [3]
    assert go(first[:3]) == {k: ((2, "AB"), True) for k in (1, 2, 3)} and seen == [3]  # nothing is worked out
    assert go([(1, "ab", "en"), (2, "abc", "en"), (3, "ab", None)])[2] == ((3, "ABC"), False) and seen == [3, 1]
    assert go(first[:2], "2")[1] == ((2, "AB"), False) and seen == [3, 1, 1]  # another version
    assert go(first) [4] == (None, False) and seen == [3, 1, 1, 1]  # what failed is tried again
    assert go([]) == {}
