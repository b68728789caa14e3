"""Resolvers, assembly, confidence, clarification, import and evaluation: golden cases, brute force and edges."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import bangla, compat, text
from sightline.operators import assemble, clarify, evaluation, quantities, resolve, state
from sightline.plans import capture
from sightline.plans.registry import QUERIES, SQL
from sightline.sources import bridge, imports

SF = "/root/testdata/sf0.001"


TWO_AMOUNTS = "প্রাণ ম্যাঙ্গো দেড় ডজন আর দুই ডজন"


@pytest.fixture(scope="module")
def annotated(spark):
    """A function from (clip, confidence) to the annotated clip; all are annotated once."""
    said = [capture.CLEAN, capture.CLEAN, "আজকে দোকান বন্ধ ছিল", " ", None, TWO_AMOUNTS]
    found = capture.annotations(spark, capture.clips(spark, said, declared=[None, "OUT-1182", *[None] * 4]))
    rows = spark.createDataFrame(found.collect(), found.schema)
    return lambda *clip, confidence=0.95: rows.filter(F.col("clip_id").isin(*clip)).withColumn("words", text.transcript_words("text", confidence))


def products(spark, said, brands=None):
    of = capture.clips(spark, said, brands)
    return [r.skus for r in resolve.resolve_products(of, capture.skus(spark), capture.aliases(spark)).orderBy("clip_id").collect()]


def test_products_of_known_phrases(spark):
    said = ["প্রাণ ম্যাঙ্গো জুস", "প্রাণ", "ইউনিলিভার", "চানাচুর", "হারপিক", None, "", "দেড় ডজন", capture.CORRUPTED]
    full, brand, maker, alias, single, *none, corrupted = products(spark, said)
    assert (full[0].candidates[0].sku_id, full[0].candidates[0].score, full[0].margin) == ("SKU-404", 0.9833, 0.3883)
    assert len(brand[0].candidates) == 4 and brand[0].margin == 0
    assert {c.sku_id for c in maker[0].candidates} == {"SKU-501", "SKU-502", "SKU-504"} and maker[0].margin == 0
    assert alias[0].candidates[0].via_alias == "চানাচুর" and alias[0].candidates[0].score == 1
    assert single[0].margin == single[0].candidates[0].score == 0.85
    assert none == [[], [], []]
    assert [m.candidates[0].sku_id for m in corrupted] == ["SKU-404", "COMP-WHEEL"]
    assert all(capture.CORRUPTED[m.s : m.e] == m.raw for m in corrupted)
    assert products(spark, ["চানাচুর"], [["Lux"]]) == [[]]
    none = resolve.resolve_products(capture.clips(spark, ["প্রাণ"]), capture.skus(spark).limit(0), capture.aliases(spark)).first()
    assert none.skus == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def alike(a, b):
    if not a or not b:
        return 0.0
    near = lambda x, y: 1 - distance(x, y) / max(len(x), len(y))
    bones = [x.translate({ord(v): None for v in "aeiou"}) for x in (a, b)]
    return 1.0 if a == b else max(near(a, b), 0.95 * near(*bones) if all(bones) else 0)


def test_similar_keys_are_all_found(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    keys = [r.key for r in rows.select(text.latin_key("w").alias("key")).distinct().collect()] + ["stor", "store", "staar", "a", "ab", "pran", "prn", "surfeksel", "srfksl", "canacur", "kanakur"]
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r.left, r.right) for r in resolve.similar_keys(table, table).collect()}
    assert got == {(a, b) for a in keys for b in keys if alike(a, b) >= 0.7}


def test_products_equal_brute_force(spark):
    """All windows against all products of the tenant, in plain Python."""
    parts = bridge.table(spark, SF, "skus").filter("active").collect()
    words = sorted({w for p in parts for w in [*p.name.split(), p.pack, p.brand.replace(" ", "")]})
    keyed = spark.createDataFrame([(w,) for w in words], "w string").select("w", bangla.phonetic_key("w").alias("k"), resolve.folded(F.col("w")).alias("f")).collect()
    key, fold = {r.w: r.k for r in keyed}, {r.w: r.f for r in keyed}
    joins = {key[a] + "".join(key[x] for x in b) for p in parts for a, *b in [p.name.split()]}
    joins |= {"".join(key[w] for w in p.name.split()[i:j]) for p in parts for i in range(9) for j in range(i + 1, 10)}
    folds = {r.k: r.f for r in spark.createDataFrame([(k,) for k in joins], "k string").select("k", text.latin_key("k").alias("f")).collect()}
    import re

    def score(window, p):
        cores = [w for w in f"{p.name} {p.pack}".split() if not re.match(text.PACK_TOKEN, w)]
        packs = [w for w in f"{p.name} {p.pack}".split() if re.match(text.PACK_TOKEN, w)]
        used, total = set(), 0.0
        for c in cores:
            best = max(range(len(window)), key=lambda i: (alike(fold[c], fold[window[i]]), -i))
            if alike(fold[c], fold[window[best]]) >= 0.7:
                used.add(best)
                total += alike(fold[c], fold[window[best]])
        bonus = 0.0
        for c in packs:
            hit = next((i for i, w in enumerate(window) if alike(fold[c], fold[w]) >= 0.9), None)
            if hit is not None:
                used.add(hit)
                bonus = 0.08
        name = min(1, total / len(cores) * (0.55 + 0.45 * len(used) / len(window)) + bonus) if total else 0
        brand = fold[p.brand.replace(" ", "")]
        word = max(alike(brand, fold[w]) for w in window)
        whole = alike(brand, folds["".join(key[w] for w in window)]) if len(window) > 1 else 0
        best, cover = max(word, whole), 1 if whole > word else 1 / len(window)
        return max(name, min(0.85, best * (0.55 + 0.45 * cover) * 0.85) if best >= 0.85 else 0)

    some = [p for p in parts if int(p.sku_id[4:]) % 9 == 1]
    table = spark.createDataFrame([(p.sku_id, p.company_id, p.name, None) for p in some], "clip_id string, company_id string, text string, brands array<string>")
    got = {r.clip_id: r.skus for r in resolve.resolve_products(table, bridge.table(spark, SF, "skus").withColumn("manufacturer", F.lit(None).cast("string")), capture.aliases(spark)).collect()}
    for p in some:
        said, spans = p.name.split(), []
        for i in range(len(said)):
            for n in range(1, min(4, len(said) - i) + 1):
                found = sorted((-int(score(said[i : i + n], q) * 1e4 + 0.5) / 1e4, q.sku_id) for q in parts if q.company_id == p.company_id and score(said[i : i + n], q) >= 0.55)
                if found:
                    spans.append((found[0][0], -len(" ".join(said[i : i + n])), i, n, found[:5]))
        kept = []
        for s in sorted(spans, key=lambda s: s[:2]):
            if all(s[2] + s[3] <= k[2] or k[2] + k[3] <= s[2] for k in kept):
                kept.append(s)
        expected = [[(i, pytest.approx(-s, abs=1e-4)) for s, i in k[4]] for k in sorted(kept, key=lambda k: k[2])]
        assert [[(c.sku_id, c.score) for c in m.candidates] for m in got[p.sku_id]] == expected


def test_outlets(spark):
    said = capture.clips(spark, ["বজোই স্তোর", None, ""], declared=[None, None, "OUT-9002"])
    near, silent, closed = [r.outlet for r in resolve.resolve_outlets(said, capture.outlets(spark)).orderBy("clip_id").collect()]
    assert [(c.outlet_id, c.score) for c in near.candidates[:2]] == [("OUT-1182", 0.7935), ("OUT-1183", 0.6044)]
    assert silent.raw is None and silent.candidates[0].outlet_id == "OUT-1183" and silent.gps_candidates == 3
    assert closed.declared and closed.candidates[0].outlet_id == "OUT-9002"
    wide = resolve.resolve_outlets(capture.clips(spark, [""]), capture.outlets(spark), radius_m=5000.0).first().outlet
    assert wide.gps_candidates == 4
    assert resolve.resolve_outlets(said.limit(0), capture.outlets(spark)).count() == 0


def test_confidence_flags_a_narrow_margin(spark, annotated):
    known = annotated(0, confidence=0.78)
    rows = assemble.scored(assemble.assembled(known), known).orderBy("place").collect()
    assert [r.status for r in rows] == ["needs_clarification"] * 2
    assert all(0.5 < rows[0].field_confidence[c] < 0.8 for c in ("outletId", "skuId", "quantity"))
    assert rows[0].field_confidence["type"] == 0.9 and "priceDelta" not in rows[0].field_confidence
    declared = annotated(1)
    assert assemble.scored(assemble.assembled(declared), declared).first().field_confidence["outletId"] == 1


def test_locks(spark, annotated):
    known = annotated(0)
    row = known.crossJoin(spark.createDataFrame([((None, "OUT-1", None, None, 1.5, "kg", -5.0, None, None),)], f"o struct<{assemble.OBSERVATION.replace(' ', ':').replace(',:', ',')}>"))
    done = row.select(assemble.locked_numbers(F.col("o"), F.col("quantities")).alias("x"), assemble.identity_allowed(F.col("o"), assemble.vocabulary(F.col("outlet"), F.col("skus"))).alias("ok"), assemble.valid_observation(F.col("o")).alias("valid")).first()
    assert (done.x.observation.quantity, done.x.observation.unit, done.x.observation.price_delta) == (None, None, -5.0)
    assert [(r.field, r.value) for r in done.x.rejected] == [("quantity", 1.5)] and not done.ok and not done.valid
    assert [assemble.field_name(x) for x in ("outlet_id", "sku", "competitor_brand")] == ["outletId", "skuId", "competitorBrand"]


def test_nothing_said_is_nothing_observed(spark, annotated):
    known = annotated(2, 3, 4)
    assert [(r.clip_id, r.observation.type) for r in assemble.assembled(known).collect()] == [(2, "retailer_complaint")]


def test_clarifications_and_answers(spark, annotated):
    known = annotated(5, confidence=0.7)
    done = assemble.scored(assemble.assembled(known), known)
    done = spark.createDataFrame(done.collect(), done.schema)
    asked = {r.field: r for r in clarify.clarifications(done, known, "2024-01-01 00:00:00", timeout_hours=6).collect()}
    assert set(asked) == {"outletId", "skuId", "quantity"}
    assert [(o.value, o.label) for o in asked["quantity"].options] == [("18", "18 piece"), ("24", "24 piece")]
    assert asked["quantity"].question == "18 piece নাকি 24 piece?" and asked["outletId"].question == "কোন দোকান?"
    assert (asked["skuId"].expires_at - asked["skuId"].created_at).total_seconds() == 6 * 3600
    assert clarify.clarifications(done, known, "2024-01-01 00:00:00").drop("options").join(clarify.public(clarify.clarifications(done, known, "2024-01-01 00:00:00")), "field").count() == 3
    answered = clarify.settled(done, "skuId", F.lit("SKU-407"), F.lit(True)).first()
    assert answered.observation.sku_id == "SKU-407" and answered.field_confidence["skuId"] == 1 and "skuId" not in answered.flagged_fields
    kept = clarify.settled(done, "skuId", None, F.lit(True)).first()
    assert kept.observation.sku_id == done.first().observation.sku_id and "skuId" not in kept.flagged_fields and kept.status == "needs_clarification"
    fixed = clarify.corrected(done, {"skuId": F.lit("SKU-410")}).first()
    assert fixed.status == "corrected" and fixed.observation.sku_id == "SKU-410" and fixed.field_confidence["skuId"] == 1
    empty = clarify.corrected(done, {}).first()
    assert empty.status == "corrected" and empty.flagged_fields == done.first().flagged_fields
    ok = spark.createDataFrame([("pending", "A"), ("answered", "A"), ("auto_resolved", "A"), ("pending", "C")], "status string, v string")
    choices = F.array(F.struct(F.lit("A").alias("value")), F.struct(F.lit("B").alias("value")))
    assert [r[0] for r in ok.select(clarify.may_answer(F.col("status"), choices, F.col("v"))).collect()] == [True, False, True, False]


def test_spellings_to_learn_and_reviews(spark):
    found = resolve.resolve_products(capture.clips(spark, ["হইল", "প্রাণ", "চানাচুর", "হুইল", "প্রাণ"]), capture.skus(spark), capture.aliases(spark))
    found = spark.createDataFrame(found.collect(), found.schema)
    learn = clarify.to_learn(found.select(F.lit("acme-bd").alias("company_id"), "clip_id", F.col("clip_id").alias("at"), "skus"))
    assert {(r.surface, r.clip_id) for r in learn.collect()} == {("প্রাণ", 1), ("প্রাণ", 4)}
    counts = state.surface_counts(learn)
    reviews = spark.createDataFrame([("acme-bd", "প্রাণ", "approve", "SKU-407")], "company_id string, surface string, verdict string, sku_id string")
    rows, approved = clarify.reviewed(counts, reviews)
    assert [(r.status, r.occurrences) for r in rows.collect()] == [("approved", 2)]
    again = resolve.resolve_products(capture.clips(spark, ["প্রাণ"]), capture.skus(spark), approved).first().skus[0]
    assert again.candidates[0].sku_id == "SKU-407" and again.candidates[0].via_alias == "প্রাণ"


def test_import(spark, tmp_path):
    path = tmp_path / "skus.csv"
    path.write_bytes('﻿skuId , name,brand,pack,isCompetitor\r\nS1,"Juice, ""fresh""",PRAN,250ml,\r\n,,,,\r\n ,Drink,PRAN\r\nS2,"two\nlines",Lux,,yes\r\nS2,Soap,Lux,,no'.encode())
    rows = imports.read_csv(spark, str(path))
    good, skipped = imports.sku_rows(rows, "c")
    assert [tuple(r) for r in skipped.collect()] == [(3, "skuId: String must contain at least 1 character(s)")]
    assert sorted((r.sku_id, r.name, r.pack, r.is_competitor, r.active) for r in good.collect()) == [("S1", 'Juice, "fresh"', "250ml", False, True), ("S2", "Soap", None, False, True), ("S2", "two\nlines", None, True, True)]
    report = imports.report(good, skipped).first()
    assert (report.parsed, report.imported, report.skipped[0].row) == (4, 3, 3)
    there = good.limit(0).drop("row").withColumn("token", F.lit("t"))
    kept = imports.upserted(there.union(spark.createDataFrame([("c", "S2", "old", "Lux", None, None, False, False, "secret")], there.schema)), good, ["company_id", "sku_id"])
    assert {r.sku_id: (r.name, r.token) for r in kept.collect()} == {"S1": ('Juice, "fresh"', None), "S2": ("Soap", "secret")}
    with pytest.raises(ValueError, match="missing required column.*outletId"):
        imports.outlet_rows(rows, "c")


def test_import_of_outlets_and_reps(spark):
    cells = [(2, "O1", "a", "23.7", "90.4"), (3, "O2", "b", "", "1"), (4, "O3", "c", "91", "-181"), (5, "", "", "0", "0"), (6, "O4", "d", "x", "1")]
    good, skipped = imports.outlet_rows(spark.createDataFrame(cells, "row int, outletId string, name string, lat string, lng string"), "c")
    assert [r.outlet_id for r in good.collect()] == ["O1"]
    assert {r.row: r.reason for r in skipped.collect()} == {3: imports.NOT_NUMBERS, 6: imports.NOT_NUMBERS, 4: "geo.lat: Number must be less than or equal to 90; geo.lng: Number must be greater than or equal to -180", 5: "; ".join(f"{c}: {imports.EMPTY_TEXT}" for c in ("outletId", "name"))}
    good, _ = imports.rep_rows(spark.createDataFrame([(2, "R", "r", "PRAN;Lux|Surf Excel")], "row int, repId string, name string, brandPortfolio string"), "c")
    assert good.first().brand_portfolio == ["PRAN", "Lux", "Surf Excel"]


def test_word_error_rate(spark):
    rows = spark.createDataFrame([("a b c", "a b", 1 / 3), ("a b", "a b c", 1 / 2), ("", "a", 1.0), ("", "", 0.0), (None, "", 0.0), ("a b", "b a", 1.0), ("x, y.", "x y", 0.0)], "a string, b string, w double")
    assert all(abs(r.w - r.got) < 1e-9 for r in rows.select("w", evaluation.wer(F.col("a"), F.col("b")).alias("got")).collect())
    assert evaluation.error_rates(rows.limit(0).selectExpr("a as reference", "b as heard")).first().asDict() == {"clips": 0, "wer": 0.0, "cer": 0.0}


def test_matching_takes_each_prediction_once(spark):
    kinds = "type string, outlet_id string, sku_id string, competitor_brand string, quantity double, price_delta double"
    rows = [("c1", [("a", "o", "s", None, 1.0, None), ("b", "", None, None, None, None)], [("b", None, None, None, None, None), ("a", "o", "s", None, 2.0, None), ("z", None, None, None, None, None)]), ("c2", None, [("a", None, None, None, None, None)]), ("c3", [("a", None, None, None, None, None)], [])]
    table = spark.createDataFrame(rows, f"clip_id string, truth array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>, predicted array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")
    got = {(r.clip_id, r.t and r.t.type, r.p and r.p.type) for r in evaluation.matched(table).collect()}
    assert got == {("c1", "a", "a"), ("c1", "b", "b"), ("c1", None, "z"), ("c2", None, "a"), ("c3", "a", None)}
    tallies = {r.field: tuple(r)[1:] for r in evaluation.field_tallies(evaluation.scored_fields(evaluation.matched(table))).collect()}
    assert tallies["type"] == (2, 0, 1, 2) and tallies["quantity"] == (0, 1, 0, 0) and tallies["outletId"] == (1, 0, 0, 0)


def test_reports(spark, tmp_path):
    tallies = spark.createDataFrame([("type", 8, 1, 1, 1)], "field string, correct long, wrong long, missed long, spurious long")
    assert "| `type` | 8 | 1 | 1 | 1 | 80.0% | 80.0% | 80.0% |" in evaluation.markdown(tallies).first().text
    for day, accuracy in (("2024-01-01", 0.9), ("2024-01-02", 0.87)):
        evaluation.write_snapshot(spark.createDataFrame([(day, accuracy)], "run_at string, accuracy double"), str(tmp_path), day)
    assert evaluation.latest_snapshot(spark, str(tmp_path), "run_at string, accuracy double").first().accuracy == 0.87
    runs = spark.createDataFrame([("1", 0.9), ("2", 0.87), ("3", 0.86)], "run_at string, accuracy double")
    rows = evaluation.with_deltas(runs, "accuracy").withColumn("bad", evaluation.regressed(F.col("accuracy"), F.col("accuracy") - F.col("accuracy_delta"))).orderBy("run_at").collect()
    assert [r.bad for r in rows] == [False, True, False]
    for name, body in {"b": '{"clip_id": "2", "dialect": "dhaka", "observations": []}', "a": '{"clip_id": "1",\n"dialect": "sylhet", "observations": []}', "c": '{"nothing": 1}', "d": "not json"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    labels = evaluation.load_labels(spark, str(tmp_path / "*.json"), "clip_id string, dialect string, observations array<string>")
    assert [r.clip_id for r in labels.collect()] == ["2"]
    assert evaluation.calibration_error(runs.limit(0).selectExpr("accuracy as conf", "true as correct")).first().asDict() == {"ece": 0.0, "brier": 0.0}


def test_small_expressions(spark):
    one = spark.range(1)
    words = F.from_json(F.lit('[{"w":"b","conf":0.5},{"w":"zz","conf":1},{"w":" ","conf":1},{"w":"a","conf":0.1}]'), "array<struct<w:string,conf:double>>")
    row = one.select(text.attach_spans(F.lit("a b a"), words).alias("x"), compat.price_text(F.lit(-5.0)).alias("p"), compat.price_text(F.lit(1234.5)).alias("q"), compat.band_name(F.lit("0.5")).alias("b"), compat.geo_point(F.lit(1.0), F.lit(2.0)).alias("g"), compat.clamp01(F.lit(float("nan"))).alias("c"), compat.clamp01(F.lit(7.0)).alias("d")).first()
    assert [(x.w, x.s, x.e) for x in row.x] == [("b", 2, 3), ("zz", 3, 3), ("a", 4, 5)]
    assert (row.p, row.q, row.b, row.g.coordinates, row.c, row.d) == ("৳5 less", "৳1,234.5 more", "50-60", [2.0, 1.0], 0.0, 1.0)
    segs = F.from_json(F.lit('[{"start":0,"end":1,"conf":0.2},{"start":1,"end":2,"conf":0.6}]'), "array<struct<start:double,end:double,conf:double>>")
    row = one.select(compat.confidence_at(segs, F.lit(1.0)).alias("a"), compat.confidence_at(segs, F.lit(9.0)).alias("b"), compat.mean_confidence(F.filter(segs, lambda s: s["conf"] > 1)).alias("c"), compat.mean_confidence(F.filter(segs, lambda s: s["conf"] > 1), 0.75).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (0.2, 0.4, None, 0.75)
    assert one.select(text.span_of(text.tokens(F.lit("a bb c")), F.lit(1), F.lit(2)).alias("s")).first().s.asDict() == {"s": 2, "e": 6}
    assert one.select(text.strip_edges(F.lit("(ab),")).alias("s")).first().s == "ab"
    assert one.select(text.phonetic_keys(F.lit("প্রাণ ম্যাঙ্গো জুস"), bangla.phonetic_key).alias("k")).first().k == ["pran", "mango", "jus"]


def test_decomposed_vowel_signs_sound_alike(spark):
    rows = spark.createDataFrame([("কো", "কো"), ("কৌ", "কৌ")], "a string, b string")
    assert all(r[0] for r in rows.select(bangla.phonetic_key("a") == bangla.phonetic_key("b")).collect())


def test_quantities_behind_a_spoilt_prefix(spark):
    rows = [(0, "তিন সাড়ে"), (1, "তিন সাড়ে আধা"), (2, "তিন সাড়ে চার"), (3, "দুই হাজার শ"), (None, "এক"), (None, "দুই")]
    got = sorted(((r.doc_id, r.value) for r in quantities.quantities(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    assert got == sorted([(1, 0.5), (2, 7.5), (3, 2100.0), (None, 1.0), (None, 2.0)], key=str)


def test_reps_are_patched_within_their_tenant(spark):
    reps = spark.createDataFrame([("a", "R1", "T1", ["x"], True), ("b", "R1", "T1", ["x"], True)], "company_id string, rep_id string, territory_id string, brand_portfolio array<string>, active boolean")
    rows, changed = state.patch_reps(reps, spark.createDataFrame([("a", "R1", "T2", None, False), ("c", "R1", "T3", None, None)], reps.schema))
    assert sorted(map(tuple, rows.collect())) == [("a", "R1", "T2", ["x"], False), ("b", "R1", "T1", ["x"], True)] and changed.count() == 1
    assert state.one_row(rows, company_id="b", rep_id="R1").first().territory_id == "T1"
    assert compat.without_secrets(reps.withColumn("invite_token", F.lit("x"))).columns == reps.columns


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and {"t3_part_names", "t0_conversations"} == set(QUERIES) - set(SQL)
