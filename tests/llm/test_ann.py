"""Nearest neighbours against brute force: recall, exact scores and order, odd vectors."""

from collections import defaultdict

import numpy as np

from sightline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vector string"


def brute(rows, k, queries):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        score = x @ x[ids == q][0]
        order = [j for j in np.lexsort([ids, -score]) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(spark, rows, k=20, every=20, **options):
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    got = defaultdict(list)
    for r in ann.nearest(table, lambda c: c % every == 0, k=k, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = run(spark, rows, trees=3, leaf=64, rounds=2)
    expected = brute(rows, 20, got)
    assert len(got) == sum(i % 20 == 0 for i, _ in rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in got]) >= 0.9
    known = {q: dict(brute(rows, len(rows), [q])[q]) for q in list(got)[:5]}
    for q in known:
        assert all(abs(known[q][i] - s) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))


def test_unequal_norms_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.standard_normal(8) * rng.uniform(0.2, 3)]) for i in range(300)]
    rows += [(1001 + 20 * i, rows[0][1]) for i in range(40)] + [(5001 + i, rows[7][1]) for i in range(3)]
    got = run(spark, rows)
    expected = brute(rows, 20, got)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in got]) >= 0.9


def test_recall_as_shipped(spark):
    """10,000 random vectors and 4,000 near copies of one of them, under the settings that the query uses."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((10_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:1] + 0.003 * rng.standard_normal((4_000, 48)) / 48**0.5
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(np.concatenate([x, near]).astype(np.float32))]
    got = run(spark, rows, every=200)
    for some in ([q for q in got if q < 10_000], [q for q in got if q >= 10_000]):
        expected = brute(rows, 20, some)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in some]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (160, [1.0, 0.0])]
    got = run(spark, bad + good)
    assert got == {0: [(2, 1.0), (160, 1.0), (1, 0.0)], 160: [(0, 1.0), (2, 1.0), (1, 0.0)]}
    assert run(spark, bad) == {} and run(spark, []) == {}
    assert run(spark, [(0, [1.0, 2.0])]) == {}


def test_unequal_lengths_and_repeated_ids(spark):
    """A shorter vector counts as if zeros followed; of an id's vectors the least counts."""
    got = run(spark, [(0, [1.0, 0.0]), (1, [2.0, 1.0, 5.0]), (3, [4.0]), (4, [9.0, 9.0]), (4, [0.5, 9.0]), (20, [0.0, 1.0, 1.0])])
    assert got == {0: [(3, 4.0), (1, 2.0), (4, 0.5), (20, 0.0)], 20: [(4, 9.0), (1, 6.0), (0, 0.0), (3, 0.0)]}
