"""Mixing, Jaccard join and substring removal against brute force and on edge cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightline.llm import jaccard_join, mixing, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, tag string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x", "y", 3) for i, t, s in rows], SCHEMA)


def odd_rows():
    long = " ".join(f"w{k}" for k in range(30_000))
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "b"), (5, "ONE  two", "b"), (6, long, "a"), (7, long + " end", None)]
    rows += [(8, "x y z " + shared + " q", "c"), (9, "r " + shared, "c"), (9, "r " + shared, "c"), (None, shared, "d"), (None, None, None)]
    rows += [(20, " ".join(["la", "lo"] * 40), "e"), (21, "été là " * 50, "e"), (22, "\x0b\x0cword", "b")]
    return rows


def corpus(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_components(rows, width=5, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text, _ in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return Counter(out)


@pytest.mark.parametrize("rows", ["odd", "corpus"])
def test_jaccard_join(spark, rows):
    rows = odd_rows() if rows == "odd" else corpus(spark)
    got = jaccard_join.link_documents(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_jaccard_join_frequent_classes(spark, monkeypatch):
    """Crowded signatures, pairs and triples: many variants of few texts, with low class limits."""
    rng = np.random.default_rng(5)
    rows = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(150)]
        for _ in range(40):
            mine = list(words)
            for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
                mine[at] = f"n{rng.integers(1e9)}"
            rows.append((len(rows), " ".join(mine[: int(rng.integers(110, 151))]), "s"))
    for limits in ((32, 1024), (3, 20), (-1, 10), (-99, -99)):
        monkeypatch.setattr(jaccard_join, "FREQUENT", limits[0])
        monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", limits[1])
        got = jaccard_join.link_documents(frame(spark, rows), small=2, block=16).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == brute_components(rows)


def test_marks_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(500):
        x = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.7, 1)], rng.integers(0, 2**64, int(rng.integers(1, 30)), dtype=np.uint64)]))
        a, b = (jaccard_join.marks(s, jaccard_join.mark_bits(len(s))) for s in (x, y))
        assert jaccard_join._may_link(len(x), a, len(y), b, 80) or not jaccard_join._alike(x, y, 80)


def test_prefixes_share_a_signature():
    """Any two sets at the threshold share one, whatever the classes are."""
    rng = np.random.default_rng(1)
    classes = rng.integers(1, 4, 1 << jaccard_join.SLOT_BITS).astype(np.uint8)
    for kinds in (classes, np.full_like(classes, 1), np.full_like(classes, 2), np.full_like(classes, 3)):
        for _ in range(300):
            n = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = x[rng.permutation(len(x))[: max(1, int(len(x) * rng.uniform(0.8, 1)))]]
            y = np.unique(np.concatenate([y, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                a, b = (jaccard_join.prefix_signatures(s, 80, kinds) for s in (x, y))
                assert len(np.intersect1d(a, b))


def brute_removal(rows, width=35):
    found = [WORD.findall(t or "") for _, t, _ in rows]
    count = Counter(tuple(w[i : i + width]) for w in found for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _, _), w in zip(rows, found, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("rows", ["odd", "corpus"])
def test_substring_removal(spark, rows):
    rows = odd_rows() if rows == "odd" else corpus(spark)
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_removal(rows)


@pytest.mark.parametrize("rows", ["odd", "corpus"])
def test_mixing(spark, rows):
    rows = odd_rows() if rows == "odd" else corpus(spark)
    got = mixing.mix_to_weights(frame(spark, rows)).collect()
    again = mixing.mix_to_weights(frame(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        target |= {s: 2 * size[s] for s in full} or {s: level * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-5)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_to_weights(none).count() == 0
    assert jaccard_join.link_documents(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
