"""Queries over repeated and crowded tables: results stay whole, and work does not grow with copies."""

from pyspark.sql import functions as F

from sightline.functions import bangla, text
from sightline.operators import evaluation, heard, matching, resolve
from sightline.plans import capture
from sightline.sources import imports, scratch


def test_rows_of_a_file_are_numbered_by_place_not_by_key(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 7, 500, 3, None, 90)], "k long").repartition(3)
    got = {r.k: r.row for r in imports.numbered(rows, "k").collect()}
    assert got == {0: 2, 3: 3, 7: 4, 90: 5, 500: 6, None: 7}
    assert imports.numbered(rows.limit(0), "k").count() == 0
    many = imports.numbered(spark.range(1000).select((F.col("id") * 3).alias("k")), "k")
    assert many.filter(F.col("row") != F.col("k") / 3 + 2).count() == 0


PLACED = "company_id string, lat double, lng double"


def test_crowded_places_are_compared_once(spark, monkeypatch):
    points = spark.createDataFrame([(k, "c", 23.0 + k % 2 * 0.001, 90.0) for k in range(40)] + [(99, "c", None, 90.0)], f"point_id long, {PLACED}")
    outlets = spark.createDataFrame([(f"o{k:02}", "c", 23.0 + k % 3 * 0.0005, 90.0, k != 1) for k in range(60)], f"outlet_id string, {PLACED}, active boolean")
    met = []
    within = matching.within_radius
    monkeypatch.setattr(matching, "within_radius", lambda p, o, r: met.append((p.count(), o.count())) or within(p, o, r))
    got = matching.nearest_outlets(points, outlets, 120.0, 3).collect()
    monkeypatch.undo()
    assert met == [(2, 9)]  # two places of points, three of outlets with three outlets each
    every = within(points, outlets, 120.0)
    want = matching.ranked(every, ["point_id"], [F.col("distance_m"), F.col("outlet_id")], 3).collect()
    assert {(r.point_id, r.rank, r.outlet_id) for r in got} == {(r.point_id, r.rank, r.outlet_id) for r in want} and len(got) == 120


def test_crowded_keys_are_cut_over_tasks(spark):
    left = spark.range(60).select(F.lit("a").alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([("b", 1), (None, 2)], "k string, x long"))
    right = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("y")).unionByName(spark.range(30).select(F.lit("b").alias("k"), F.col("id").alias("y")))
    dealt = matching.meeting(left, right, ["k"], "x", most=50)
    want = left.join(right, ["k"])
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, want.collect())) and dealt.count() == 1230
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 600


def test_equal_pairs_of_texts_are_compared_once(spark):
    rows = spark.createDataFrame([("a b", "a b"), ("a b", "a c"), ("a b", "a c"), ("", "x"), (None, None), ("a", None)], "reference string, heard string")
    assert sorted(r.wer for r in evaluation.with_wer(rows).collect()) == [0.0, 0.0, 0.5, 0.5, 1.0, 1.0]
    assert evaluation.error_rates(rows).first().wer == 0.5 and evaluation.error_rates(rows).first().clips == 6
    plan = evaluation.error_rates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1  # what the words are is worked out once, not for each of them


def test_rows_of_a_class_get_what_was_found_for_it(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", ["x"]), (4, None, None)], "clip_id long, text string, brands array<string>")
    classes = resolve.classed(rows.filter("text is not null"), "text", "brands")
    assert classes.count() == 2
    found = resolve.of_class(rows, classes, classes.select("clip_id", F.size("brands").alias("n")), "text", "brands")
    assert {r.clip_id: r.n for r in found.collect()} == {1: -1, 2: -1, 3: 1, 4: None} or {r.clip_id: r.n for r in found.collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_windows_too_long_for_any_name_are_left_out(spark):
    """Those that stay are all that are like a name."""
    said = spark.createDataFrame([(1, "c", [(w,) for w in ("surf", "eksel", "", "international", "wat", "plus", "a")])], "clip_id int, company_id string, t array<struct<key:string>>")
    names = spark.createDataFrame([("surpeksel",), ("luks",)], "key string")
    got = {(r.at, r.n): r.key for r in resolve.joined_windows(said, 4, names, 0.85).collect()}
    assert got[0, 2] == got[0, 3] == "surpeksel" and (4, 2) in got and not any(at <= 3 < at + n for at, n in got)
    near = resolve.similar_keys(spark.createDataFrame([(k,) for k in got.values()], "key string"), names, 0.85)
    assert [(r.left, r.right) for r in near.collect()] == [("surpeksel", "surpeksel")]


def test_best_run_is_the_best_of_all_runs(spark):
    """Against all runs of up to three tokens: the first and shortest of the best, or none below the floor."""
    texts = ["", "x", "bijoy store", "the store of bijoy", "new alam store enterprise bijoy store", "store store", "rahman the new stor alam", "qq bijoi"]
    names = ["Bijoy Store", "Rahman Store", "New Alam Enterprise", "", None]
    folds = resolve.folded
    token = lambda w: F.struct(F.nullif(folds(w), F.lit("")).alias("fold"), text.skeleton(F.nullif(folds(w), F.lit(""))).alias("bones"))
    rows = spark.createDataFrame([(t, n) for t in texts for n in names], "t string, name string").select("t", "name", F.transform(F.filter(F.split("t", " "), lambda w: w != ""), token).alias("folds"), resolve.name_parts(F.col("name")).alias("parts"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    runs = rows.select("t", "name", "parts", "folds", F.posexplode("folds").alias("at", "_")).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("folds") - F.col("at")))))
    score = resolve.run_score(F.col("parts"), resolve.part_likeness(F.col("parts"), F.slice("folds", F.col("at") + 1, F.col("n"))))
    every = runs.select("t", "name", score.alias("score"), (-F.col("at")).alias("a"), (-F.col("n")).alias("b")).filter("score >= 0.6").collect()
    want = {(t, n): max(((r.score, r.a, r.b) for r in every if (r.t, r.name) == (t, n)), default=None) for t in texts for n in names}
    got = {(r.t, r.name): r.x and tuple(r.x) for r in rows.select("t", "name", resolve.best_run(F.col("parts"), F.col("folds"), 3, 0.6).alias("x")).collect()}
    assert got == want and sum(x is not None for x in got.values()) == 7


def test_texts_are_dealt_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(scratch, "CHARACTERS_A_TASK", 100)
    table = spark.createDataFrame([(k, "x" * 50) for k in range(20)] + [(99, None)], "clip_id long, text string")
    assert scratch.spread(table, "text", "clip_id").rdd.getNumPartitions() == 11 and scratch.spread(table, "text", "clip_id").count() == 21
    assert scratch.spread(table.limit(0), "text", "clip_id").rdd.getNumPartitions() == 1


ODD = ["", " ", "a", "  বিজয় স্টোরে, (Mango Juice) 250ml.", "what whe e ee the\nthht\ttht — «x» !! 日本 O'Neil's", "wheelপ্রাণ fcqv Ōsaka éclair\u200bphone -wh- -", "x" * 50 + " . , y"]


def test_texts_are_heard_once(spark):
    """Tokens, keys, folds and spans are those of each token alone, and a text that is said twice has one row."""
    clips = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, ODD[3], None])], "clip_id int, text string")
    rows, table = heard.with_rows(clips)
    assert table.count() == len(ODD) and rows.filter("row is null").count() == 1 and rows.select("row").distinct().count() == len(ODD) + 1
    found = table.withColumns({"w": F.transform(text.tokens("text"), lambda t: t["text"]), "p": heard.pieces("text")})
    one = lambda key: F.array_join(F.transform("w", key), "\n")
    assert found.filter(~(F.col("tokens").eqNullSafe(F.array_join("w", "\n")) & F.col("keys").eqNullSafe(one(bangla.phonetic_key)) & F.col("folds").eqNullSafe(one(resolve.folded)))).count() == 0
    spans = F.flatten(F.transform("p", lambda _, i: F.transform(F.sequence(i, F.size("p") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), heard.span(F.col("p"), i, j).alias("x")))))
    for r in found.select("text", text.tokens("text").alias("t"), F.when(F.size("p") > 0, spans).alias("spans")).collect():
        for x in r.spans or []:
            s, e = r.t[x.i].s, r.t[x.j].e
            assert (x.x.s, x.x.e, x.x.raw) == (s, e, r.text[s:e])


def test_windows_unlike_any_name_are_left_out(spark):
    """Of all runs of tokens those like a name stay, and few others do; the letters that folding changes count as well."""
    said = ["sur", "pek", "sel", "p", "ra", "an", "lu", "x", "sun", "", "silk", "srp", "eksl", "uit", "t", "plus", "b", "ab", "a", "mekanikal", "enterpis", "wit", "eplus", "national", "thing", "shun", "sil"]
    table = spark.createDataFrame([(1, "c", [(w,) for w in said])], "clip_id int, company_id string, t array<struct<key:string>>")
    runs = [(i, n) for n in (2, 3, 4) for i in range(len(said) - n + 1) if sum(w != "" for w in said[i : i + n]) > 1]
    every = spark.createDataFrame([(i, n, "".join(said[i : i + n])) for i, n in runs], "at int, n int, whole string").withColumn("key", text.latin_key("whole"))
    for some, hits, most in ((["pran", "surpeksel", "luks", "sunsilk", "huiteplus", "baba"], 10, len(runs) / 2), (["mekanikalenterpris"], 2, len(runs))):
        names = spark.createDataFrame([(n,) for n in some], "key string")
        got = {(r.at, r.n): r.key for r in resolve.joined_windows(table, 4, names, 0.85).collect()}
        best = every.crossJoin(names.withColumnRenamed("key", "name")).groupBy("at", "n", "key").agg(F.max(text.key_similarity("key", "name")).alias("likeness")).collect()
        like = {(r["at"], r.n): r.key for r in best if r.likeness >= 0.85}
        assert like.items() <= got.items() and len(like) == hits and len(got) < most
    assert resolve.sounds_like_some([f"nam{k}ofabrandthatislong" for k in range(resolve.WAYS + 1)], 0.85, 4) is None


def test_few_keys_are_met_by_all(spark, monkeypatch):
    """The same pairs as by segments."""
    left, right = (spark.createDataFrame([(k,) for k in keys], "key string") for keys in (["pran", "prn", "paran", "luks", "lks", "", "kolgat", "kolgats", "a", "e", "rin", "ren", "n"], ["pran", "luks", "kolgat", "rin", "a", ""]))
    pairs = lambda floor, bones: sorted((r.left, r.right, r.likeness) for r in resolve.similar_keys(left, right, floor, bones).collect())
    few = [pairs(f, b) for f in (0.6, 0.7, 0.85) for b in (True, False)]
    monkeypatch.setattr(resolve, "FEW_KEYS", 0)
    assert few == [pairs(f, b) for f in (0.6, 0.7, 0.85) for b in (True, False)] and len(few[0]) > 8


def test_outlets_are_looked_for_once_a_place(spark, monkeypatch):
    met = []
    within = resolve.within_radius
    monkeypatch.setattr(resolve, "within_radius", lambda p, o, r: met.append(p.count()) or within(p, o, r))
    found = resolve.resolve_outlets(capture.clips(spark, ["বিজয় স্টোরে", "রহমান স্টোরে", "", None]), capture.outlets(spark)).collect()
    assert met == [1] and {r.clip_id: r.outlet.gps_candidates for r in found} == {0: 3, 1: 3, 2: 3, 3: 3}
    assert {r.clip_id: r.outlet.raw for r in found} == {0: "বিজয় স্টোরে", 1: "রহমান স্টোরে", 2: None, 3: None}
