"""Each streaming form ends where its batch form does."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from sightline.operators import state
from sightline.sources.keyed_table import KeyedTable
from sightline.streaming import feed, retries, status, twins

ROWS = [(k % 7, f"s{k % 3}", f"u{k % 5}", k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)) for k in range(60)]
SCHEMA = "company_id int, surface string, sku_id string, clip_id int, at timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    def start(rows, schema, files=3):
        for k in range(files):
            spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return start


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", twins.ROCKS_DB)


def run(query, tmp_path):
    query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)


def test_insert_batches_equals_insert_new(spark, stream, tmp_path):
    keys = ["company_id", "surface"]
    table = KeyedTable.create(spark, str(tmp_path / "out"), SCHEMA, keys, 4)
    rows = twins.dedupe(stream(ROWS, SCHEMA), keys, "at")
    run(rows.writeStream.foreachBatch(twins.insert_batches(table, ["at"])), tmp_path)
    batch = spark.createDataFrame(ROWS, SCHEMA)
    expected = state.insert_new(batch.limit(0), batch, keys, ["at"])
    assert shown(table.read()) == shown(expected)
    twins.insert_batches(table, ["at"])(batch, 0)  # a batch that runs again
    twins.insert_batches(table, ["at"])(batch, 99)  # rows that came before, in a new batch
    assert shown(table.read()) == shown(expected)


def test_latest_status(spark, stream, tmp_path):
    found = state.latest_status(stream(ROWS, SCHEMA), "company_id", "surface", "at", "clip_id")
    run(found.writeStream.outputMode("complete").format("memory").queryName("latest_status"), tmp_path)
    assert sorted(map(tuple, spark.table("latest_status").collect())) == sorted(map(tuple, state.latest_status(spark.createDataFrame(ROWS, SCHEMA), "company_id", "surface", "at", "clip_id").collect()))


def test_counted_surfaces(spark, stream, tmp_path):
    kinds = SCHEMA.replace("company_id int", "company_id string").replace("clip_id int", "clip_id long")
    rows = [(str(r[0]), *r[1:]) for r in ROWS]
    table = KeyedTable.create(spark, str(tmp_path / "out"), twins.SURFACES, ["company_id", "surface"], 4)
    run(stream(rows, kinds).writeStream.foreachBatch(twins.count_batches(table)), tmp_path)
    expected = state.surface_counts(spark.createDataFrame(rows, kinds)).select("company_id", "surface", "occurrences", "suggested", "sample_clips")
    assert shown(twins.counted(table)) == shown(expected)
    before = dict(table.state["folders"])
    twins.count_batches(table)(spark.createDataFrame(rows[40:], kinds), 2)  # a batch that runs again
    assert table.state["folders"] == before
    twins.count_batches(table)(spark.createDataFrame(rows[:1], kinds), 3)
    changed = [b for b in before if table.state["folders"][b] != before[b]]
    assert len(changed) == 1 and len(before) > 1  # no other bucket is written


def test_prompts_equal_their_fold(spark, stream, rocks, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    events = [("p1", 0, "create", None), ("p1", 2, "answer", "A"), ("p1", 3, "answer", "B"), ("p2", 0, "create", None), ("p3", 1, "create", None), ("p3", 2, "cancel", None), ("p3", 3, "answer", "D"), ("p4", 1, "create", None), ("x", 30, "create", None), ("p2", 31, "answer", "C"), ("y", 80, "create", None), ("z", 140, "create", None)]
    rows = [(p, day + datetime.timedelta(hours=h), kind, v) for p, h, kind, v in events]
    schema = "prompt_id string, at timestamp, kind string, value string"
    changes = twins.prompts(stream(rows, schema, files=4), delay="12 hours")
    got = {}

    def keep(batch, number):
        got.update({r.prompt_id: tuple(r)[1:] for r in batch.collect()})

    run(changes.writeStream.outputMode("update").foreachBatch(keep), tmp_path)
    timeouts = [(p, day + datetime.timedelta(hours=h + 24), "timeout", None) for p, h, kind, _ in events if kind == "create"]
    fold = {r.prompt_id: tuple(r)[1:] for r in state.fold_prompts(spark.createDataFrame(rows + timeouts, schema)).collect()}
    assert {p: got[p] for p in ("p1", "p2", "p3", "p4")} == {p: fold[p] for p in ("p1", "p2", "p3", "p4")}


def test_status_changes_equal_their_fold(spark, stream, rocks, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    life = [("a", "queued processing processed processing failed"), ("b", "processing queued queued processing failed queued processing processed"), ("c", "queued processed"), ("d", "nonsense"), ("e", "queued")]
    rows = sorted(((c, day + datetime.timedelta(minutes=k), s) for c, log in life for k, s in enumerate(log.split())), key=lambda r: r[1]) + [("e", day + datetime.timedelta(hours=1), None)]
    schema = "clip_id string, at timestamp, status string"
    run(status.status_changes(stream(rows, schema)).writeStream.outputMode("append").format("memory").queryName("status_changes"), tmp_path)
    log = status.status_log(spark.createDataFrame(rows, schema))
    assert shown(spark.table("status_changes")) == shown(log.select("clip_id", "at", "before", "asked", "accepted"))
    refused = {(r.clip_id, r.before, r.asked) for r in log.filter("not accepted").collect()}
    assert refused == {("b", None, "processing"), ("b", "queued", "queued"), ("b", "failed", "queued"), ("c", "queued", "processed"), ("d", None, "nonsense"), ("e", "queued", None)}
    assert {r.clip_id: r.status for r in status.current_status(log).collect()} == {"a": "failed", "b": "processed", "c": "queued", "e": "queued"}


def test_feed_equals_latest_and_survives_a_restart(spark, rocks, tmp_path):
    schema = "company_id string, observation_id string, created_at timestamp, body string"
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)
    rows = [(f"co{k % 3}" if k % 11 else ["", None][k % 2], f"o{k % 40}", at(k * 7 % 50), f"b{k}" if k % 5 else None) for k in range(90)]
    snapshot = spark.createDataFrame([("co1", "old", at(45), "x"), ("co1", "o4", at(1), "y"), ("co2", "older", at(-3), "z")], schema)
    table = KeyedTable.create(spark, str(tmp_path / "table"), feed.OUT, ["company_id"], 4)
    for k in range(3):  # three runs of the query, each from the checkpoint of the one before
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run(feed.live(source, snapshot, most=8).writeStream.outputMode("update").foreachBatch(feed.shown_in(table)), tmp_path)
    assert shown(table.read()) == shown(feed.latest(spark.createDataFrame(rows, schema).union(snapshot), most=8))
    told = feed.notices(spark.createDataFrame(rows, schema), F.lit("observations:created"), "observation_id", "body")
    assert told.count() == sum(bool(r[0]) for r in rows) and '"body"' not in told.filter("payload like '%\"o30\"%'").first().payload


def test_fan_out_keeps_tenants_apart(spark, stream, tmp_path):
    rows = [("co1", "clip:status", "{}"), ("co2", "clip:status", "{}"), ("co1", "observations:created", "[]")]
    source = stream(rows, "company_id string, kind string, payload string", files=1)
    feed.fan_out(source, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert shown(spark.read.json(str(tmp_path / "out" / "company_id=co1"))) == [("clip:status", "{}"), ("observations:created", "[]")]


def work(payload, attempt):
    """'3' is done at the third attempt; '404' and '503' are refusals."""
    if payload in ("404", "503"):
        raise retries.ProviderError(f"HTTP {payload}", int(payload))
    if attempt < int(payload):
        raise ValueError(f"not before {payload}")
    return f"done {payload}"


def test_attempts_pauses_dead_letters_and_restart(spark, rocks, tmp_path):
    schema = "job_id string, payload string"
    done = KeyedTable.create(spark, str(tmp_path / "done"), retries.OUT, ["job_id"], 2)
    dead = KeyedTable.create(spark, str(tmp_path / "dead"), retries.OUT, ["job_id"], 2)
    tried = []

    def keep(batch, number):
        tried.extend(map(tuple, batch.select("job_id", "attempt", "status", "due").collect()))
        retries.routed(done, dead)(batch, number)

    def go(until, seconds=60):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = retries.attempted(source, work, backoff_ms=1500).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
        query = query.trigger(processingTime="200 milliseconds").foreachBatch(keep).start()
        end = time.time() + seconds
        while not until() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.2)
        query.stop()

    jobs = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "9"), ("e", "404"), ("f", "503"), ("a", "404")]
    spark.createDataFrame(jobs, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    go(lambda: len(tried) >= 6)  # first attempts; then the query is stopped and started from its checkpoint
    assert {x[:3] for x in tried if x[1] == 1} == {("a", 1, "done"), ("e", 1, "dead"), *((j, 1, "waiting") for j in "bcdf")}
    go(lambda: dead.read().count() >= 3 and done.read().count() >= 3)
    assert {r.job_id: (r.attempt, r.value) for r in done.read().collect()} == {"a": (1, "done 1"), "b": (2, "done 2"), "c": (3, "done 3")}
    assert {r.job_id: (r.attempt, r.error) for r in dead.read().collect()} == {"d": (3, "not before 9"), "e": (1, "HTTP 404"), "f": (3, "HTTP 503")}


def test_settled_attempts_equal_a_loop(spark):
    rows = [(f"j{k // 5}", datetime.datetime(2024, 1, 1, 0, k % 5), k % 7 == 0, None if k % 13 == 0 else k % 3 == 0, [None, 400, 429, 500, 404][k * k % 5]) for k in range(200)]
    schema = "job_id string, at timestamp, ok boolean, by_provider boolean, http_status int"
    got = {r.job_id: tuple(r)[1:] for r in retries.settled_attempts(spark.createDataFrame(rows, schema)).collect()}
    for job in {r[0] for r in rows}:
        for attempt, (_, at, ok, by_provider, code) in enumerate((r for r in rows if r[0] == job), 1):
            again = not by_provider or code is None or code == 429 or code >= 500
            found = "done" if ok else "waiting" if again and attempt < 3 else "dead"
            if found != "waiting":
                break
        assert got[job] == (attempt, found, None)
    one = retries.settled_attempts(spark.createDataFrame([r for r in rows if r[0] == "j2"][:2], schema)).first()
    assert (one.attempts, one.status, one.due) == (2, "waiting", datetime.datetime(2024, 1, 1, 0, 1, 4))
