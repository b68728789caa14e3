"""The whole flow and its ends: extraction, replies, recogniser replies, uploads, traces, scratch tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sightline.functions import bangla, sql, text
from sightline.operators import assemble, clarify, evaluation, extract, matching, quantities, replies, resolve
from sightline.plans import capture, flow
from sightline.sources import bridge, recognised, scratch, traces, uploads
from sightline.sources.keyed_table import KeyedTable

SF = "/root/testdata/sf0.001"


def test_extract_equals_its_stages(spark):
    """Conversations against the catalogue, and clips that fail: the same observations as the stages give one by one."""
    clips = flow.conversation_clips(spark, SF).limit(12).unionByName(capture.clips(spark, [capture.CLEAN, None, "  \t", capture.CORRUPTED, "হুইল"], [None, None, None, None, ["Lux"]]).drop("words").withColumn("clip_id", F.concat(F.lit("x"), "clip_id")))
    tables = capture.skus(spark), capture.aliases(spark), capture.outlets(spark)
    seen = Observation()
    got = {r.clip_id: r for r in extract.extract(clips, *tables, seen=seen).collect()}
    assert len(got) == 17 and seen.get["clips"] == 17 and seen.get["failed"] == 2
    assert {k: r.fault.message for k, r in got.items() if r.status == "failed"} == {"x1": "there is no transcript", "x2": "the transcript is blank"}
    good = extract.transcribed(clips).filter("fault is null").drop("fault")
    known = assemble.annotated(good, resolve.resolve_outlets(good, tables[2]), resolve.resolve_products(good, *tables[:2]), quantities.quantities(good.select(F.col("clip_id").alias("doc_id"), "text")))
    steps = assemble.scored(assemble.assembled(known), known)
    expected = sorted((r.clip_id, r.place, r.observation, sorted(r.field_confidence.items()), r.flagged_fields, r.status) for r in steps.collect())
    found = sorted((k, o.place, o.observation, sorted(o.field_confidence.items()), o.flagged_fields, o.status) for k, r in got.items() for o in r.observations)
    assert found == expected and len(found) > 15
    assert [o.observation.sku_id for o in got["x3"].observations] == ["SKU-404", None]
    counts = [tuple(r) for r in extract.stage_counts(extract.extract(clips.limit(0), *tables)).collect()]
    assert counts == [(s, 0, 0) for s in extract.STAGES]


ENTRY = {"type": "demand_signal", "outletId": None, "skuId": "SKU-404", "competitorBrand": None, "quantity": 18, "unit": "piece", "priceDelta": None, "severity": "low", "verbatimBn": "x"}


def test_replies_are_whole_or_faults(spark):
    clips = capture.clips(spark, [capture.CLEAN, capture.CORRUPTED, "হুইল", "বিজয় স্টোরে", "হারপিক"])
    known = capture.annotations(spark, clips)
    keys = {r.clip_id: r.key for r in known.select("clip_id", replies.reply_key(replies.prompt(F.col("text"), F.col("outlet"), F.col("skus"), F.col("quantities"))).alias("key")).collect()}
    assert len(set(keys.values())) == 5 and all(k.startswith("observations:") and len(k) == 29 for k in keys.values())
    told = {0: [ENTRY, {**ENTRY, "quantity": 17, "priceDelta": 5, "skuId": None}], 1: [{**ENTRY, "skuId": "SKU-1"}], 2: [], 3: [{**ENTRY, "skuId": None, "quantity": None, "more": 1}]}
    recorded = [(keys[k], json.dumps({"observations": v})) for k, v in told.items()] + [(keys[2], "~ not the least"), ("observations:0", "{}")]
    table = spark.createDataFrame(recorded, "key string, raw string")
    found, errors = replies.assembled_from_replies(known, table)
    rows = {(r.clip_id, r.place): r for r in found.collect()}
    assert set(rows) == {(0, 0), (0, 1), (3, 0)} and rows[0, 0].observation.quantity == 18 and rows[0, 0].rejected == []
    locked = rows[0, 1]
    assert (locked.observation.quantity, locked.observation.unit, locked.observation.price_delta) == (None, None, 5.0)
    assert [(x.field, x.value) for x in locked.rejected] == [("quantity", 17.0)]
    faults = {r.clip_id: (r.error, r.retryable) for r in errors.collect()}
    assert faults == {1: ("an observation names what was not offered", True), 4: (f"no reply is recorded for {keys[4]}", True)}
    flowed = {r.clip_id: r for r in extract.extract(clips, capture.skus(spark), capture.aliases(spark), capture.outlets(spark), table).collect()}
    assert {k: r.fault.stage for k, r in flowed.items() if r.fault} == {1: "05-assemble", 4: "05-assemble"}
    assert [len(flowed[k].observations) for k in range(5)] == [2, 0, 0, 1, 0] and flowed[0].observations[1].rejected[0].value == 17.0


@pytest.mark.parametrize(
    ("raw", "fault"),
    [
        ("{bad", 0), (None, 0), ("[1]", 1), ('{"other":1}', 1), ("null", 1), (json.dumps({"observations": [3]}), 1), (json.dumps({"observations": [{**ENTRY, "quantity": "many"}]}), 1),
        (json.dumps({"observations": [{k: v for k, v in ENTRY.items() if k != "unit"}]}), 2), (json.dumps({"observations": [ENTRY, {**ENTRY, "competitorBrand": "C"}]}), 3),
        (json.dumps({"observations": [{**ENTRY, "severity": "worst"}]}), 4), (json.dumps({"observations": [{**ENTRY, "verbatimBn": None}]}), 4), (json.dumps({"observations": []}), None),
    ],
)
def test_each_fault_of_a_reply(spark, raw, fault):
    words = F.expr("named_struct('outlet_ids', array('O'), 'sku_ids', array('SKU-404'), 'competitor_brands', cast(array() as array<string>))")
    said = spark.createDataFrame([(raw,)], "raw string").select(replies.parsed_reply(F.col("raw"), words).alias("x")).first().x
    assert said.fault == (None if fault is None else flow.FAULTS[fault])


def test_first_segment_that_holds_a_time():
    """Sorted or not, overlapping or touching: the same as looking at all segments for each word."""
    random.seed(4)
    for _ in range(300):
        starts = [random.randint(0, 20) / 2 for _ in range(random.randint(0, 8))]
        ends = [s + random.randint(-1, 8) / 2 for s in starts]
        times = [random.randint(-2, 30) / 2 for _ in range(random.randint(0, 12))]
        expected = [next((k for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if a <= t <= b), -1) for t in times]
        assert recognised.first_holding(times, starts, ends) == expected


def test_word_spans():
    assert recognised.word_spans("a b a", ["b", "zz", "a", "b"]) == [(2, 3), (3, 3), (4, 5), (2, 3)]
    assert recognised.word_spans("", ["x"]) == [(0, 0)] and recognised.word_spans("x", []) == []


def test_hosted_replies(spark):
    segments = [{"start": 0, "end": 2, "avg_logprob": -0.5, "no_speech_prob": 0.1, "compression_ratio": 1.5}, {"start": 2, "end": 4}, {"start": 4, "end": 5, "avg_logprob": -1, "compression_ratio": 3}]
    words = [{"word": " এক ", "start": 0.5, "end": 1}, {"word": "", "start": 1}, {"word": "দুই", "start": 2, "end": 3}, {"word": "তিন", "start": 4.5}, {"word": "চার", "start": 9}]
    long = [{"word": f"w{k}", "start": k / 10, "end": k / 10} for k in range(10_000)]
    given = [
        (1, json.dumps({"text": " এক দুই তিন চার ", "segments": segments, "words": words, "duration": 5.5})), (2, json.dumps({"text": "a b", "segments": segments[:1], "language": "en"})), (3, "{}"), (4, "not json"), (5, None), (6, "[]"),
        (7, json.dumps({"text": " ".join(w["word"] for w in long), "words": long, "segments": [{"start": k, "end": k + 0.95, "avg_logprob": -(k % 9) / 10} for k in range(1000)]})),
    ]
    found, errors = recognised.hosted_transcripts(spark.createDataFrame(given, "clip_id int, raw string"))
    got = {r.clip_id: r for r in found.collect()}
    assert {r.clip_id for r in errors.collect()} == {4, 5, 6} and set(got) == {1, 2, 3, 7}
    one = got[1]
    mean = (0.5459 + 0.75 + 0.1839) / 3
    assert [(w.w, w.s, w.e) for w in one.words] == [("এক", 0, 2), ("দুই", 3, 6), ("তিন", 7, 10), ("চার", 11, 14)]
    assert [w.conf for w in one.words] == pytest.approx([0.5459, 0.5459, 0.1839, mean]) and (one.duration_sec, one.language, one.confidence_derived) == (5.5, "bn", True)
    assert [(w.w, w.conf, w.start) for w in got[2].words] == [("a", 0.5459, 0.0), ("b", 0.5459, 0.0)] and got[2].language == "en"
    assert (got[3].text, got[3].words) == ("", [])
    assert len(got[7].words) == 10_000 and all(got[7].text[w.s : w.e] == w.w for w in got[7].words)
    assert got[7].words[25].conf == pytest.approx(0.8187) and got[7].words[0].conf == 1.0


def test_local_replies(spark):
    segments = [{"text": " এক দুই ", "offsets": {"from": 0, "to": 1500}, "tokens": [{"p": 0.5}, {"p": 0.7}, {}]}, {"text": "", "tokens": []}, {"text": "তিন", "offsets": {"from": 1500, "to": 2500}}, {"text": "চার", "tokens": [{"p": 7}]}]
    given = [(1, json.dumps({"transcription": segments[:3]})), (2, json.dumps({"transcription": [segments[3]]})), (3, json.dumps({"transcription": []})), (4, "{}"), (5, "?")]
    found, errors = recognised.local_transcripts(spark.createDataFrame(given, "clip_id int, raw string"))
    got = {r.clip_id: r for r in found.collect()}
    assert {r.clip_id for r in errors.collect()} == {4, 5}
    assert got[1].text == "এক দুই তিন" and [(w.w, w.s, w.start, w.end) for w in got[1].words] == [("এক", 0, 0.0, 1.5), ("দুই", 3, 0.0, 1.5), ("তিন", 7, 1.5, 2.5)]
    assert [w.conf for w in got[1].words] == pytest.approx([0.6, 0.6, 0.75]) and got[1].duration_sec == 2.5 and not got[1].confidence_derived
    assert got[2].words[0].conf == 1.0 and got[3].words == [] and got[3].duration_sec is None


UPLOAD = "client_uuid string, audio_base64 string, mime_type string, source string, lat double, lng double, declared_outlet_id string, recorded_at string, extra int"


def test_uploads_are_parted(spark):
    at = "2024-01-09T10:00:00.000Z"
    rows = [
        ("good-uuid", "YWJj", None, None, 1.0, 2.0, None, at, 1), ("good-uuid2", "YWJj", "image/png", "photo", None, None, "O", "2024-01-09T10:00:00Z", 2), ("short", "YWJj", None, None, None, None, None, at, 3),
        ("no-audio-1", None, None, None, None, None, None, at, 4), ("no-audio-2", "", None, None, None, None, None, at, 5), ("not-base64", "!!!", None, None, None, None, None, at, 6), ("too-large-1", "YWJjZGVm", None, None, None, None, None, at, 7),
        ("all-wrong", "YWJj", None, "film", 1.0, None, None, "yesterday", 8), (None, "YWJj", None, "voice", None, None, None, None, 9), ("x" * 129, "YWJj", None, None, None, None, None, "2024-13-09T10:00:00Z", 10),
    ]
    good, bad = uploads.parted(spark.createDataFrame(rows, UPLOAD), most_bytes=5)
    assert [(r.extra, bytes(r.audio), r.source, r.mime_type) for r in good.orderBy("extra").collect()] == [(1, b"abc", "voice", "audio/webm"), (2, b"abc", "photo", "image/png")]
    reasons = {r.extra: r.reasons for r in bad.collect()}
    assert reasons[3] == ["client_uuid must have 8 to 128 characters"] and reasons[4] == reasons[5] == ["audio_base64 is missing"]
    assert reasons[6] == ["audio_base64 is not base64"] and reasons[7] == ["audio is too large"] and len(reasons[8]) == 3 and len(reasons[9]) == 2 and len(reasons[10]) == 2
    assert "audio" not in bad.columns and good.count() + bad.count() == len(rows)


def test_traces_hold_no_binaries(spark, tmp_path):
    kind = "struct<a:binary,b:array<struct<c:binary,d:int>>,e:map<string,binary>,f:string>"
    rows = spark.createDataFrame(
        [("c1", "2024-01-09 10:00:00", 2, "b", 5.0, False, (b"abc", [(b"12345", 1), (None, 2), None], {"k": b"x"}, "t"), "out", None), ("c1", "2024-01-09 10:00:01", 1, "a", 2.5, True, None, "out", None), ("c2", "2024-01-10 00:00:00", 1, "a", 1.0, False, (None, None, None, None), None, "it broke")],
        f"clip_id string, traced_at string, seq int, stage string, ms double, cached boolean, input {kind}, output string, error string",
    ).withColumn("traced_at", F.to_timestamp("traced_at"))
    for _ in range(2):  # a batch that runs again
        traces.write_traces(rows, str(tmp_path), 3)
    traces.write_traces(rows.filter("clip_id = 'c2'").withColumn("clip_id", F.lit("c3")), str(tmp_path), 4)
    back = {r.clip_id: r for r in spark.read.json(str(tmp_path)).collect()}
    assert set(back) == {"c1", "c2", "c3"} and str(back["c1"].day) == "2024-01-09" and back["c2"].failed and not back["c1"].failed
    first, second = back["c1"].stages
    assert (back["c1"].total_ms, first.stage, second.stage) == (7.5, "a", "b") and first.input is None
    assert second.input.a == "<3 bytes>" and [x and x.c for x in second.input.b] == ["<5 bytes>", None, None] and second.input.e.k == "<1 bytes>" and second.input.f == "t"
    assert back["c2"].stages[0].error == "it broke"


def test_products_in_scope_equal_a_filtered_catalogue(spark):
    """Clips with brands: the same as resolving against a catalogue of those brands and the competitors."""
    parts = bridge.table(spark, SF, "skus").withColumn("manufacturer", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "company_id string, sku_id string, surface string")
    for brands in (["Brand#1", "Brand#7"], ["no such brand"], []):
        said = parts.filter("sku_id like '%3'").select(F.col("sku_id").alias("clip_id"), "company_id", F.concat_ws(" ", "name", "pack", "brand").alias("text"), F.array(*map(F.lit, brands)).cast("array<string>").alias("brands"))
        scoped = parts.filter(F.col("is_competitor") | F.col("brand").isin(brands)) if brands else parts
        got, expected = ({r.clip_id: r.skus for r in resolve.resolve_products(s, c, none).collect()} for s, c in ((said, parts), (said.withColumn("brands", F.lit(None).cast("array<string>")), scoped)))
        assert got == expected and any(got.values())


def test_without_a_name_outlets_rank_by_nearness(spark):
    """A text that names no shop leaves scores as near as they are."""
    said = capture.clips(spark, ["আজ"])
    found = resolve.resolve_outlets(said, capture.outlets(spark)).first().outlet
    assert [c.score for c in found.candidates] == [round(1 - c.distance_m / 120, 4) for c in found.candidates] or all(abs(c.score - (1 - c.distance_m / 120)) < 1e-3 for c in found.candidates)


def test_scratch_tables_are_removed_by_purpose(spark):
    with scratch.made_for("a test"):
        one = scratch.written(spark.range(3))
        two = scratch.written(spark.range(4), kept=True)
    other = scratch.written(spark.range(5))
    assert one.count() == 3 and scratch.clear(spark, "a test") == 1 and scratch.clear(spark, "a test") == 0
    assert two.count() == 4 and other.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.range(1).crossJoin(one).collect()


def test_functions_in_sql(spark):
    assert {"latin_key", "phonetic_key", "haversine_m"} <= set(sql.register(spark))
    words = spark.createDataFrame([("Phones",), ("ম্যাঙ্গো",), ("হুইল",), ("(১২),",), (None,), ("White  Plus",)], "w string")
    words.createOrReplaceTempView("some_words")
    named = {"latin_key": text.latin_key, "bangla_key": bangla.bangla_key, "phonetic_key": bangla.phonetic_key, "key_skeleton": text.skeleton, "strip_edges": text.strip_edges, "normal_word": bangla.normal_word, "western_digits": bangla.western_digits}
    mine = words.select(*(f("w").alias(name) for name, f in named.items()))
    theirs = spark.sql("select " + ", ".join(f"{name}(w) as {name}" for name in named) + " from some_words")
    assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
    row = spark.sql("select half_up(2.345, 2) as a, haversine_m(0, 0, 0, 1) as b, key_ratio('abc', 'abd') as c, key_ratio('', '') as d, confidence_tone(0.7) as e").first()
    assert (row.a, row.c, row.d, row.e) == (2.35, pytest.approx(2 / 3), 1.0, "mid") and row.b == pytest.approx(111194.93, abs=0.01)


def test_points_look_across_the_180th_meridian(spark):
    outlets = spark.createDataFrame([("c", f"O{k}", lat, lng, True) for k, (lat, lng) in enumerate([(0.0, 179.9995), (0.0, -179.9995), (60.0, -179.999), (60.0, 179.999), (0.0, 0.0)])], "company_id string, outlet_id string, lat double, lng double, active boolean")
    points = spark.createDataFrame([(1, "c", 0.0, 179.9999), (2, "c", 0.0, -179.9998), (3, "c", 60.0, 179.9995), (4, "c", 0.0, 0.0001)], "point_id int, company_id string, lat double, lng double")
    got = {(r.point_id, r.outlet_id) for r in matching.within_radius(points, outlets, 120.0).collect()}
    every = points.join(outlets.select("company_id", "outlet_id", F.col("lat").alias("a"), F.col("lng").alias("b")), "company_id")
    assert got == {(r.point_id, r.outlet_id) for r in every.filter(text.haversine_m("lat", "lng", "a", "b") <= 120.0).collect()} and len(got) == 7
    few = {(r.point_id, r.outlet_id, r.rank) for r in matching.nearest_outlets(points, outlets, 120.0, 1).collect()}
    assert few == {(1, "O0", 1), (2, "O1", 1), (3, "O3", 1), (4, "O4", 1)}


def test_last_snapshot_alone_is_read(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        evaluation.write_snapshot(spark.createDataFrame([(day, 0.5)], "run_at string, accuracy double"), str(tmp_path), day)
    last = evaluation.latest_snapshot(spark, str(tmp_path), "run_at string, accuracy double")
    assert last.first().run_at == "2024-01-02" and all("2024-01-02" in f for f in last.inputFiles())
    assert evaluation.latest_snapshot(spark, str(tmp_path / "none"), "run_at string, accuracy double").count() == 0


def test_prompts_are_inserted_with_their_timers(spark, tmp_path):
    schema = "clip_id long, place int, field string, created_at timestamp"
    table = KeyedTable.create(spark, str(tmp_path / "prompts"), schema + ", prompt_id string, batch long", ["prompt_id"], 4)
    asked = lambda *clips: spark.createDataFrame([(c, 0, "skuId", datetime.datetime(2024, 1, 1)) for c in clips], schema)
    insert = clarify.insert_prompts(table, str(tmp_path / "events"))
    insert(asked(1, 2), 0)
    insert(asked(2, 3, 3), 1)
    insert(asked(2, 3, 3), 1)  # a batch that runs again
    events = spark.read.parquet(str(tmp_path / "events"))
    assert sorted(r.clip_id for r in table.read().collect()) == [1, 2, 3]
    assert events.count() == 3 and events.select("prompt_id").distinct().count() == 3 and {r.kind for r in events.collect()} == {"create"}
