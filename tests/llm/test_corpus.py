"""Line removal, importance resampling and the filter audit against plain Python, and on edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import filter_audit, importance, line_dedup

from .test_core import SCHEMA, SF, corpus, frame, odd_rows

LOWER = {c: c + 32 for c in range(65, 91)}
EDGE = "\x20\x09\x0a\x0b\x0c\x0d"


def odd_lines():
    boiler, late = "  All Rights Reserved by the Firm \t", "all rights reserved BY THE FIRM"
    rows = odd_rows() + [(30, f"one\n{boiler}\ntwo", "a"), (31, f"{late}\n{late}", "a"), (40, f"\n{boiler.upper()}\n", "b"), (33, boiler + "\x1f", "b")]
    rows += [(50 + k, "é" * 19 + f"x\nshort\n{'ü' * 19}\n\n" + "tail of document\r\n" * (k % 3), "c") for k in range(4)]
    rows += [(70, "two documents hold this line\nand this", "c"), (71, "Two documents hold this line", "c"), (71, "Two documents hold this line", "c")]
    rows += [(None, "a line without an id of its own", "d"), (None, "a line without an id of its own", "d"), (80, "a line without an id of its own", "d")]
    return rows + [(None, "only rows without an id hold it", "d")] * 3 + [(90, "x" * (1 << 20) + "\n" + boiler, "e")]


def key_of(line):
    return line.strip(EDGE).translate(LOWER)


def brute_lines(rows, least_docs=3, least_chars=20):
    holders = defaultdict(list)
    for doc_id, text, _ in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [len(found := holders.get(key_of(x), [])) >= least_docs and max(found) != (-1 if doc_id is None else doc_id) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc_id, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("rows", [odd_lines, corpus], ids=["odd", "corpus"])
@pytest.mark.parametrize("bits", [6 + 8, 28], ids=["full", "wide"])
def test_line_removal(spark, rows, bits):
    """A filter that is full suspects every line, and gives the same."""
    rows = rows() if rows is odd_lines else corpus(spark)
    got = line_dedup.drop_repeated_lines(frame(spark, rows), most_bits=bits)
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_lines(rows)


def test_line_removal_in_pairs_and_without_rows(spark):
    rows = odd_lines()
    got = line_dedup.drop_repeated_lines(frame(spark, rows), least_docs=2, least_chars=4).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_lines(rows, 2, 4)
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(frame(spark, rows), least_docs=1)


def test_two_filters_miss_no_repeat(spark):
    """Lines of different rows, in one task or two, are all found; few others are."""
    rng = np.random.default_rng(5)
    lines = [f"line number {k} of many" for k in range(4000)]
    texts = ["\n".join(lines[k] for k in rng.integers(0, 4000, 30)) for _ in range(200)]
    held = Counter(x for t in texts for x in set(t.split("\n")))
    table = line_dedup.twice_seen(frame(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(5).select("text"), 17, 4)
    part = next(iter(line_dedup.slices(pa.array(["\n".join(lines)]))))
    found = line_dedup._in(table, line_dedup.Lines(part, 4).hash)
    assert all(found[k] for k, x in enumerate(lines) if held[x] > 1)
    assert sum(found[k] for k, x in enumerate(lines) if held[x] < 2) < 0.02 * 4000


def brute_resample(rows, target, percent=25, least_words=20, order=2, buckets=10_000, seed=7):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def read(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    found = [read(t) for _, t, _ in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in read(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (doc_id, _, _), (n, f) in zip(rows, found, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((x[3] for x in out if x[4] >= least_words), reverse=True)
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_of_odd_rows(spark, order):
    rows = odd_rows() + [(k, f"Das Ä{k} ist (ein) Wort\t" * (k % 9) + "Z_z" * 7, "s") for k in range(200, 240)] + [(300, "x y " * 30, "s")] * 4
    target = ["Das ist ein Wort", None, "", "la lo la lo été"]
    texts = spark.createDataFrame([(k, t, "u") for k, t in enumerate(target)], "item_id long, text string, url string")
    got = importance.resample(frame(spark, rows), texts, percent=40, order=order, buckets=97).collect()
    every, drawn = brute_resample(rows, target, 40, order=order, buckets=97)
    assert Counter(tuple(r)[:4] for r in got) == Counter(tuple(x[:4]) for x in every)
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1)) and [r.score for r in ranked] == drawn
    assert ranked == sorted(ranked, key=lambda r: (-r.score, r.doc_id is None, r.doc_id))
    assert importance.resample(spark.createDataFrame([], SCHEMA), texts).count() == 0
    assert {r.weight for r in importance.resample(frame(spark, rows[:3]), texts.limit(0)).collect()} == {0}


def test_resampling_draws_towards_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = docs.filter("lang = 'de' and doc_id % 2 = 0")
    drawn = importance.resample(docs, target).filter("rank is not null").join(docs.select("doc_id", "lang"), "doc_id")
    share = docs.filter("lang = 'de'").count() / docs.count()
    assert drawn.filter("lang = 'de'").count() / drawn.count() > 1.5 * share


def brute_audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    marks = defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id}
        good, bad = labels.get(doc_id, (0, 0)) if doc_id is not None else (0, 0)
        marks[source or ""].append(({f for f in fails if fails[f]}, good, bad))
    out = []
    for part, docs in marks.items():
        shapley, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                earlier = set(order[:step])
                gone = [d for d in docs if f in d[0] and not d[0] & earlier]
                shapley[f] += len(gone)
                steps.append([part, "".join(order), step + 1, sum(not d[0] & (earlier | {f}) for d in docs), len(gone), sum(f in d[0] and bool(d[0] & earlier) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def odd_documents():
    text = " ".join(f"w{k}" for k in range(250))
    rows = [(5, text, "a"), (3, text, "b"), (9, text, None), (3, text, "b"), (9, text, ""), (None, text, "a"), (None, text, "a"), (1, None, "a"), (2, "", "c"), (4, "", None)]
    rows += [(10 + k, text + " A#"[: k % 4] * (k + 1), "abc"[k % 3]) for k in range(20)] + [(40, "same " * 300, "a"), (41, "É" * 100 + "A B", "d"), (42, "w" * (1 << 20), "d"), (43, "w\x1fx " * 300, "d")]
    return rows + [(60 + k, "copied " * 10, "a") for k in range(30, 0, -1)]


@pytest.mark.parametrize("fold", [64 << 20, 1000], ids=["whole", "often"])
def test_filter_audit(spark, monkeypatch, fold):
    monkeypatch.setattr(filter_audit, "FOLD_BYTES", fold)
    rows = odd_documents()
    known = [(1, 1, 1), (3, 1, 0), (3, 0, 1), (9, None, 1), (12, 1, None), (63, 1, 1), (65, 0, 0), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    best = {i: tuple(max(int(r[k] == 1) for r in known if r[0] == i) for k in (1, 2)) for i, _, _ in known}
    got = filter_audit.audit(frame(spark, rows).repartition(3), labels)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, best)
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert sum(r.removed for r in filter_audit.audit(frame(spark, rows), labels.limit(0)).collect() if r.good_lost or r.toxic_lost) == 0


def test_copies_are_the_ids_above_the_least(spark):
    rows = odd_documents()
    got = Counter(r.doc_id for r in filter_audit.copy_ids(frame(spark, rows)).collect())
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    assert got == Counter(i for i, t, _ in rows if i is not None and least[t or ""] < i)


def test_hashes_may_collide(monkeypatch):
    """Texts of one hash are told apart whole."""
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda x: 7)
    limits = (0, 0, 100)
    rows = [(4, "a", "p"), (2, "b", "p"), (3, "a", "q"), (9, "b", "q"), (1, "c", "p")]
    sent = [x for half in (rows[:2], rows[2:]) for x in filter_audit._folded(half, limits)]
    assert sorted((i, bool(mask & filter_audit.COPY)) for i, _, mask, _ in filter_audit._chained(sent)) == [(1, False), (2, False), (3, False), (4, True), (9, True)]
