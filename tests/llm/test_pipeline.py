"""The pipeline's stages, each against brute force on what the stage before kept."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import mixing, toxicity
from sightline.llm.store import materialize
from sightline.sources import scratch

from .test_core import SF, WORD, brute_components, brute_removal, frame


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == columns
    raw, mild, single, cut, mixed = ([tuple(r) for r in k.collect()] for k in kept)

    scores = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in scores.filter("predicted = 1").collect()}
    assert sorted(mild) == sorted(r for r in raw if r[0] not in bad)

    groups = brute_components([(r[0], r[1], None) for r in mild])
    assert sorted(r[0] for r in single) == sorted(k[0] for k in groups if k[0] == k[2])

    removed = Counter({(r[0], hashlib.sha256(" ".join(WORD.findall(r[1])).encode()).hexdigest()) for r in cut})
    assert removed == Counter((k[0], k[3]) for k in brute_removal([(r[0], r[1], None) for r in single]))
    assert all(r[4] == len(r[1]) for r in cut)

    taken = Counter()
    for r in mixed:
        taken[r[0]] += len(WORD.findall(r[1]))
    expected = {r.doc_id: r.taken for r in mixing.mix_to_weights(kept[3]).collect() if r.taken}
    assert taken == expected

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect())
    sha = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ids = [(r[0], library.encode(r[1], add_special_tokens=False).ids) for r in mixed]
    assert last == Counter((i, len(x), sha(x)) for i, x in ids)


def test_rows_with_null_and_repeated_ids(spark):
    """Rows belong together by id and text; other columns may have the stages' own names."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a, "s"), (None, a + " z", "s"), (None, b, "s"), (None, None, "s"), (7, c, "s"), (7, c, "s"), (7, "other words", "t"), (9, c + " z", "s"), (3, "", None), (5, "x" * 1_000_000, "s")]
    docs = frame(spark, rows).withColumnsRenamed({"hash": "row_a", "tag": "kept", "size": "row", "n": "component"})
    single = corpus_pipeline.keep_one_of_group(spark, docs, SF)
    assert single.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in single.collect())
    alike = {(None, a), (None, a + " z")}
    assert len(alike & set(kept)) == 1
    assert Counter({k: n for k, n in kept.items() if k not in alike}) == Counter([(None, b), (None, None), (7, c), (7, "other words"), (3, ""), (5, "x" * 1_000_000)])
    cut = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter([(None, ""), (None, "z"), (None, b), (None, ""), (7, ""), (7, ""), (7, "other words"), (9, "z"), (3, ""), (5, "x" * 1_000_000)])
    assert corpus_pipeline.keep_one_of_group(spark, docs.limit(0), SF).count() == corpus_pipeline.cut_repeats(spark, docs.limit(0), SF).count() == 0


def test_odd_tables_in_every_stage(spark, tmp_path):
    """No labels reject nothing; null and repeated ids, and tables without rows, pass through all stages."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "idiot text", "s"), (None, None, "s"), (7, "idiot " * 50, "t"), (7, "idiot " * 50, "t"), (8, "", None), (9, "stupid moron", None), (5, "x" * 300_000, "s")]
    docs = frame(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    mixed = stages["source_mix"](spark, docs, str(tmp_path))
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    size = Counter()
    for _, t, source in rows:
        size[source] += len(WORD.findall(t or ""))
    assert mixed.columns == docs.columns and words and all(words[x] <= 2 * size[x] for x in words)
    encoded = stages["bpe"](spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in encoded.collect()) == Counter(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_a_stage_removes_what_the_one_before_left(spark):
    docs = frame(spark, [(k, " ".join(f"w{k % 3} v{i}" for i in range(60)), "s") for k in range(9)])
    left = lambda: {p for (_, purpose), found in scratch._left.items() for p in found if purpose in ("keep_one_of_group", "cut_repeats")}
    single = materialize(corpus_pipeline.keep_one_of_group(spark, docs, SF), kept=True)
    before = left()
    cut = materialize(corpus_pipeline.cut_repeats(spark, single, SF), kept=True)
    assert before and not before & left() and cut.count() == single.count() == 3


def test_batches_of_texts_are_small(spark):
    """A stage's Python tasks get a few MB of texts at once, however many rows a partition has; a lower limit of the session stays."""
    seen = lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]}) for b in batches)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.range(3000).select(F.repeat(F.lit("word "), 1000).alias("text")).repartition(1)
    corpus_pipeline.STAGES[0][1](spark, docs, SF)
    try:
        got = long.mapInArrow(seen, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 3000
        assert max(r.bytes for r in got) < corpus_pipeline.BATCH_BYTES + (1 << 20)
        spark.conf.set(corpus_pipeline.BATCH_LIMIT, "20k")
        corpus_pipeline.STAGES[0][1](spark, docs, SF)
        assert spark.conf.get(corpus_pipeline.BATCH_LIMIT) == "20k"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
