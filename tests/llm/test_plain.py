"""Fingerprints, language and toxicity models against plain Python: loops and dictionaries, no arrays."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import fingerprints, language_id, toxicity

from .test_core import corpus, odd_rows
from .test_tokens import odd_texts

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def plain_mix(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & MASK
    return x ^ x >> 32


VALUES = [plain_mix((b + 1) * BASE & MASK) for b in range(256)]


def plain_hash(raw):
    total = 0
    for b in reversed(raw):
        total = (total * BASE + VALUES[b]) & MASK
    return plain_mix((total + len(raw)) & MASK)


def plain_fingerprint(text):
    raw = (text or "").encode()
    if not raw:
        return "3::"
    rolled = [(plain_hash(raw[i - 6 : i + 1]) >> 32) + 1 for i in range(6, len(raw))]
    block = 3
    while sum(r % block == 0 for r in rolled) >= 64:
        block *= 2
    signatures = []
    for size in (block, 2 * block):
        cuts = sorted({0, len(raw), *(i + 7 for i, r in enumerate(rolled) if r % size == 0)})
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        signatures.append("".join(letters[plain_hash(raw[a:b]) >> 58] for a, b in itertools.pairwise(cuts)))
    return f"{block}:{signatures[0]}:{signatures[1]}"


def test_fingerprints_equal_a_byte_loop(spark):
    texts = [t for _, t, _ in odd_rows()] + odd_texts(300) + [t for _, t, _ in corpus(spark)[:100]] + ["a", "abcdefg", "aaaaaaaaaaaaaaaa" * 50]
    assert fingerprints.fingerprints(pa.array(texts)) == [plain_fingerprint(t) for t in texts]


class PlainFtrl:
    """One coordinate at a time; the bias, key None, is not regularised."""

    def __init__(self, classes, alpha, l1, l2):
        self.alpha, self.l1, self.l2, self.classes = alpha, l1, l2, range(classes)
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, key, c):
        z, l1, l2 = self.z[key, c], 0 if key is None else self.l1, 0 if key is None else self.l2
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((1 + math.sqrt(self.n[key, c])) / self.alpha + l2)

    def scores(self, row):
        return [sum(x * self.weight(key, c) for key, x in row.items()) for c in self.classes]

    def step(self, row, label):
        row = {**row, None: 1.0}
        p = plain_softmax(self.scores(row))
        for (key, x), c in itertools.product(row.items(), self.classes):
            g = x * (p[c] - (c == label))
            w, n = self.weight(key, c), self.n[key, c]
            self.z[key, c] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[key, c] = n + g * g


def plain_softmax(scores):
    e = [math.exp(s - max(scores)) for s in scores]
    return [x / sum(e) for x in e]


def plain_grams(text):
    """Occurrences of each slot of the 1- to 3-grams; None without a letter."""
    if not any(map(str.isalpha, text or "")):
        return None
    codes = [ord(c) for c in text.replace("İ", "i").replace("Σ", "σ").lower()]
    found = Counter()
    for order in (1, 2, 3):
        for i in range(len(codes) - order + 1):
            h = 0
            for c in codes[i : i + order]:
                h = plain_mix((h * 0x100000001B3 + c + 1) & MASK)
            found[h >> 49] += 1
    return found


def test_language_equals_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").select("doc_id", "text", "lang")
    sample = 25
    keyed = docs.withColumn("at", F.xxhash64("doc_id", "text")).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).collect()
    rows = [(r, plain_grams(r.text)) for r in keyed]
    taught = [(r, g) for r, g in rows if r.fold != 2 and r.lang is not None]
    sizes = Counter(r.lang for r, _ in taught)
    languages = sorted(sizes)
    assert len(languages) > 1 and max(sizes.values()) > sample
    frequency = Counter(slot for _, g in taught if g for slot in g)

    def row_of(grams):
        values = {s: (1 + math.log(n)) * (math.log((1 + len(taught)) / (1 + frequency[s])) + 1) for s, n in grams.items()}
        length = math.sqrt(sum(x * x for x in values.values()))
        return {s: x / length for s, x in values.items()}

    chosen = {(r.lang, r.at): g for r, g in taught if (r.at % (1 << 30)) / (1 << 30) < sample / sizes[r.lang]}
    examples = [(languages.index(lang), row_of(g)) for (lang, at), g in sorted(chosen.items(), key=lambda x: x[0][1]) if g]
    plain = PlainFtrl(len(languages), 0.5, 0.2, 0.05)
    for _ in range(2):
        for k, (label, row) in enumerate(examples):
            if k % 5:
                plain.step(row, label)

    training = docs.filter("lang is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = language_id.train(training.select("text", "lang", F.col("doc_id").alias("key")), sample)
    assert model["languages"] == languages
    kept = [(label, plain.scores({**row, None: 1.0})) for label, row in examples[::5]]
    loss = lambda t: -np.mean([math.log(max(plain_softmax([s / t for s in scores])[label], 1e-12)) for label, scores in kept])
    assert loss(model["temperature"]) < min(map(loss, np.geomspace(0.05, 20, 400))) + 1e-5

    got = {r.doc_id: r for r in language_id.identify(docs, sample=sample).collect()}
    for r, g in rows:
        assert got[r.doc_id].held_out == (r.fold == 2)
        if g is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        p = plain_softmax([s / model["temperature"] for s in plain.scores({**row_of(g), None: 1.0})])
        assert abs(got[r.doc_id].score - max(p)) < 1e-3
        assert p[languages.index(got[r.doc_id].lang_pred)] > max(p) - 1e-4


def path_cost(text, costs):
    s = [0, 0, *(x for c in text for x in toxicity.symbols(c)), 0]
    return sum(float(costs[a, b, c]) for a, b, c in zip(s, s[1:], s[2:], strict=False))


def test_restored_text_costs_least_of_all_paths():
    rng = np.random.default_rng(5)
    costs = rng.random((28, 28, 28)) * 4
    for text, spaced in (("1d10t", False), ("$t|_|p1d", False), ("aa11bbb", False), ("s t |", True), ("a.1-3", True), ("ö0ü", False), ("", False)):
        every = {}
        for path in itertools.product(*toxicity.lattice(text, spaced)):
            said = "".join(letters for letters, _ in path)
            cost = path_cost(said, costs) + sum(extra for _, extra in path)
            every[said.strip()] = min(cost, every.get(said.strip(), math.inf))
        best = toxicity.restore(text, costs, spaced)
        assert every[best] <= min(every.values()) + 1e-9


def plain_disguised(text):
    """(what is restored, whether it is spaced out) of each disguise in a text."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    letter = lambda b: 97 <= b <= 122 or b >= 128
    sign = lambda b: chr(b) in toxicity.LEET
    out, run = [], []
    for word in [*re.findall(rb"[^\x20\x09-\x0D]+", lower), b"  "]:
        near = list(itertools.pairwise(word))
        leet = any(sign(a) and letter(b) for a, b in near) or any(letter(a) and (48 <= b <= 57 or b in b"@$") and sign(b) for a, b in near)
        stretched = any(a == b == c and 97 <= a <= 122 for a, b, c in zip(word, word[1:], word[2:], strict=False))
        letters, dots = sum(map(letter, word)), sum(b in b".-_*" for b in word)
        if (letters and (leet or stretched) and letters * 5 >= len(word) * 2) or (dots >= 2 and dots * 2 + 1 >= len(word) and letters >= 2):
            raw = word.decode().strip(".,;:?\"'()[]{}")
            out.append((raw, sum(c in " .-_*" for c in raw) * 2 + 1 >= len(raw)))
        one = word.decode()
        if len(one) == 1 and (one.isalpha() if len(word) > 1 else letter(word[0]) or sign(word[0])):
            run.append(one)
            continue
        if len(run) >= 3:
            out.append((" ".join(run), True))
        run = []
    return out


def plain_features(text, costs):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    found = set()
    for raw in [lower, *(toxicity.restore(x, costs, spaced).encode() for x, spaced in plain_disguised(text))]:
        for word in re.findall(rb"[a-z\x80-\xff]+", raw):
            found |= {word} | {(k, word[:k]) for k in (4, 5, 6) if len(word) > k}
    return found


def plain_model(spark, docs, labels):
    """Scores of (doc_id, text) rows by a dictionary of features, learned from the rows outside fold 0."""
    costs = toxicity.language_model(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("at"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold")).collect()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r, plain_features(r.text, costs)) for r in keyed]
    taught = sorted([(r.at, toxic[r.doc_id], f) for r, f in rows if r.fold and toxic.get(r.doc_id) is not None], key=lambda x: x[:2])
    counts = [Counter(x for _, label, f in taught if label == side for x in f) for side in (0, 1)]
    sizes = Counter(label for _, label, _ in taught)
    tells = lambda x: abs(math.log((counts[1][x] + 0.5) / sizes[1]) - math.log((counts[0][x] + 0.5) / sizes[0]))
    kept = {x for x in counts[0] | counts[1] if counts[0][x] + counts[1][x] >= 4 and tells(x) >= 1}
    model = PlainFtrl(2, 0.5, 0.7, 0.02)
    for _ in range(5):
        for _, label, f in taught:
            model.step(dict.fromkeys(f & kept, 1.0), label)
    return {r.doc_id: plain_softmax(model.scores({**dict.fromkeys(f & kept, 1.0), None: 1.0}))[1] for r, f in rows}


def test_toxicity_equals_plain_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    disguised = [(10_000_000 + k, t) for k, t in enumerate(["1d10t", "you i d i o t s", "soooo s.t.u.p.i.d", "s c h ö n e r", "end!", "", "4start", "ll", "lo", "a b", "$t0p", "x_y_z"])]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(disguised, "doc_id long, text string")).coalesce(1)
    expected = plain_model(spark, docs, labels)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(expected)
    for r in got:
        assert abs(r.score - expected[r.doc_id]) < 1e-6, r.doc_id


def test_scores_do_not_depend_on_the_rows_beside():
    costs = np.random.default_rng(7).random((28, 28, 28)) * 4
    texts = ["some end!", "hello", "4start", "abc", "7", "xl", "ll", "lab", "", "a$", "b"]
    restored = lambda rows: toxicity.Restorer(costs).restored(next(toxicity.slices(pa.array(rows))))
    alone = [(k, found) for k, t in enumerate(texts) if t for _, found in restored([t])]
    assert sorted(restored(texts)) == sorted(alone)
    grams = lambda rows: [x and dict(zip(*map(list, x), strict=True)) for x in language_id._features(pa.array(rows))]
    assert grams(["ΑΣ", "Β", "ΑΣ"]) == grams(["ΑΣ"]) + grams(["Β"]) + grams(["ΑΣ"]) == [plain_grams(t) for t in ("ΑΣ", "Β", "ΑΣ")]
