"""Toxicity scores of texts whose spelling may be disguised.

A noisy channel turns words into leetspeak, stretched letters and spaced-out letters. Words that
look disguised become lattices of what each sign may stand for, and Viterbi decoding under a
character trigram model of the corpus restores the likeliest spelling. The score is a sparse
logistic regression over the words, and beginnings of words, of the text and its restorations.
"""

from __future__ import annotations

import itertools
import os
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .language_id import fold
from .linear import Ftrl
from .store import materialize
from .textkit import BYTE_VALUES, LOWER, Slice, U, Words, mix, powers, slices, words

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}
SEPARATORS = " .-_*"
#: Costs (negative log probabilities) of the channel.
SIGN_COST, STRETCH_COST, GAP_COST = 0.7, 0.3, 1.0
PREFIXES = (4, 5, 6)
#: Labelled rows that the classifier is fitted on at most, by label.
SAMPLE = {1: 3000, 0: 5000}
#: A feature of the model occurs in so many rows of the sample at least, and e times as often with one label as with the other.
LEAST_ROWS, LEAST_TELL = 4, 1.0
#: Log odds of texts where no labels of both kinds teach a difference: nothing is then called toxic.
UNTAUGHT = -500.0
#: Signs after which a decoder puts away what all its paths agree on, and of the longest text that a memo keeps.
PIECE = 200
EPOCHS = 5
SLICE_BYTES = 1 << 19

SYMBOLS = 28  # 0: not a letter, 1 to 26: a to z, 27: any byte of another letter
SYMBOL_OF = np.zeros(256, np.int64)
SYMBOL_OF[97:123] = np.arange(1, 27)
SYMBOL_OF[128:] = 27
IS_LETTER = SYMBOL_OF > 0
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[ord(c) for c in LEET]] = True


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs of a letter after the two before it, from all letters of all texts: an array of 28**3."""

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for part in slices(batch.column("text"), SLICE_BYTES):
            s = SYMBOL_OF[LOWER[part.data]]
            inside = np.ones(len(s), bool)
            for k in (0, 1):  # of three letters, none may belong to the row before
                begins = part.offsets[:-1] + k
                inside[begins[begins < part.offsets[1:]]] = False
            at = np.flatnonzero(inside & (np.concatenate([s[:1] > 0, (s[1:] > 0) | (s[:-1] > 0)]) if len(s) else inside))
            total += np.bincount((s[at - 2] * SYMBOLS + s[at - 1]) * SYMBOLS + s[at], minlength=len(total))

    counts = sketch.dense(docs.select("text"), SYMBOLS**3, np.int64, fill).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(0)
    after_one = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
    return -np.log((counts + 20 * after_one) / (counts.sum(2, keepdims=True) + 20))


def lattice(text: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """What each stretch of ``text`` (lower case) may stand for, with its cost."""
    k = 0
    while k < len(text):
        letter, n = text[k], 1
        while k + n < len(text) and text[k + n] == letter:
            n += 1
        choices = [(c, SIGN_COST) for c in LEET.get(letter, "")] or [(letter, 0.0)]
        if letter in SEPARATORS and spaced:
            yield [("", 0.0), (" ", GAP_COST)]
        elif letter.isalpha() or letter in LEET:
            once = [(c, cost + STRETCH_COST * (n > 1)) for c, cost in choices]
            yield once + [(c * 2, cost + STRETCH_COST * (n > 2)) for c, cost in choices] * (n > 1)
        else:
            yield [(" ", 0.0)]
        k += n


def symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


def symbols(letter: str) -> list[int]:
    """A symbol for each byte, as the character model counts them."""
    return [symbol(letter)] * (len(letter.encode()) if letter.isalpha() else 1)


def restore(text: str, costs: np.ndarray, spaced: bool = False) -> str:
    """The least-cost path through the lattice of ``text``, under the character model.

    A text may have any length: what all paths agree on is put away after each ``PIECE`` steps.
    """
    states, done = {(0, 0): (0.0, "")}, []
    for k, choices in enumerate(itertools.chain(lattice(text, spaced), [[(" ", 0.0)]]), 1):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (p, q), (cost, path) in states.items():
            for letters, extra in choices:
                a, b, total = p, q, cost + extra
                for c in itertools.chain.from_iterable(map(symbols, letters)):
                    total += float(costs[a, b, c])
                    a, b = b, c
                if (a, b) not in after or total < after[a, b][0]:
                    after[a, b] = (total, path + letters)
        states = after
        if k % PIECE == 0:
            common = os.path.commonprefix([path for _, path in states.values()])
            done.append(common)
            states = {at: (cost, path[len(common) :]) for at, (cost, path) in states.items()}
    return ("".join(done) + min(states.values())[1]).strip()


class Restorer:
    """Finds disguised words of a slice and restores them; a bounded memo keeps restored words."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.memo = costs, {}

    def restored(self, part: Slice) -> list[tuple[int, bytes]]:
        """(row, restored text) of every disguised word of the slice."""
        data = LOWER[part.data]
        w = words(part)
        if not len(w.start):
            return []
        letter, sign = IS_LETTER[data], IS_SIGN[data]
        ahead, behind = np.append(letter[1:], False), np.concatenate([[False], letter[:-1]])
        begins, ends = part.offsets[:-1][np.diff(part.offsets) > 0], part.offsets[1:][np.diff(part.offsets) > 0]
        ahead[ends - 1] = behind[begins] = False  # the next byte is another text's
        digit_or_at = sign & ((data < 58) & (data > 47) | (data == 64) | (data == 36))
        leet = sign & ahead | digit_or_at & behind
        stretched = np.zeros(len(data), bool)
        stretched[2:] = letter[2:] & (data[2:] < 128) & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
        stretched[begins] = stretched[np.minimum(begins + 1, ends - 1)] = False
        dotted = np.isin(data, [ord(c) for c in SEPARATORS[1:]])
        size = w.end - w.start
        count = lambda marks: np.add.reduceat(marks.astype(np.int32), w.start)
        letters = count(letter)
        hit = (letters > 0) & ((count(leet) > 0) | (count(stretched) > 0)) & (letters * 5 >= size * 2)
        hit |= (count(dotted) * 2 + 1 >= size) & (count(dotted) >= 2) & (letters >= 2)
        alone = (size == 1) & ((letters == 1) | sign[w.start])
        wide = np.flatnonzero((size > 1) & (size <= 4) & (count((data & 0xC0) == 0x80) == size - 1))  # one code point of several bytes
        alone[wide] = [data[w.start[k] : w.end[k]].tobytes().decode().isalpha() for k in wide.tolist()]
        return self._each(part, data, w, np.flatnonzero(hit)) + self._runs(part, data, w, alone)

    def _each(self, part: Slice, data: np.ndarray, w: Words, hits: np.ndarray) -> list[tuple[int, bytes]]:
        rows = np.searchsorted(w.of_row, hits, "right") - 1
        out = []
        for row, k in zip(rows.tolist(), hits.tolist(), strict=True):
            raw = data[w.start[k] : w.end[k]].tobytes().decode().strip(".,;:?\"'()[]{}")
            out.append((row, self._of(raw, sum(c in SEPARATORS for c in raw) * 2 + 1 >= len(raw))))
        return out

    def _runs(self, part: Slice, data: np.ndarray, w: Words, alone: np.ndarray) -> list[tuple[int, bytes]]:
        """Three or more single letters in a row, of one document."""
        row = np.searchsorted(w.of_row, np.arange(len(alone)), "right") - 1
        begins = alone & ~np.concatenate([[False], alone[:-1] & (row[1:] == row[:-1])])
        ends = alone & ~np.append(alone[1:] & (row[1:] == row[:-1]), False)
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        long = last - first >= 2
        return [(int(row[a]), self._of(" ".join(data[w.start[a] : w.end[b]].tobytes().decode().split()), True)) for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)]

    def _of(self, raw: str, spaced: bool) -> bytes:
        if (found := self.memo.get((raw, spaced))) is None:
            found = restore(raw, self.costs, spaced).encode()
            if len(self.memo) > 100_000:
                self.memo.clear()
            if len(raw) <= PIECE:
                self.memo[raw, spaced] = found
        return found


def features(part: Slice, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words and word beginnings of each text of a slice, and of its restorations."""
    rows, hashes = _word_features(LOWER[part.data], part.offsets)
    restored = restorer.restored(part)
    if not restored:
        return rows, hashes
    texts = [t for _, t in restored]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    more, extra = _word_features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    return np.concatenate([rows, np.array([r for r, _ in restored])[more]]), np.concatenate([hashes, extra])


def _word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spaced = np.where(IS_LETTER[data], data, np.uint8(32))
    w = words(Slice(0, len(offsets) - 1, spaced, offsets))
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUES[spaced] * up[:-1])])
    row = np.searchsorted(w.of_row, np.arange(len(w.start)), "right") - 1
    rows, hashes = [row], [w.hash]
    for k in PREFIXES:
        long = w.end - w.start > k
        start = w.start[long]
        rows.append(row[long])
        hashes.append(mix((total[start + k] - total[start]) * down[start] + U(k << 32)))
    return np.concatenate(rows), np.concatenate(hashes)


def train(labelled: DataFrame, costs: np.ndarray, rates: tuple[float, float] = (1.0, 1.0)) -> dict:
    """A model (sorted feature hashes, weights, bias) from a bounded sample of (text, toxic).

    ``rates``: the shares of the clean and of the toxic rows that the sample has; the bias is that for all rows.
    """

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            found = []
            for part in slices(batch.column("text"), SLICE_BYTES):
                rows, hashes = features(part, restorer)
                found += [np.unique(hashes[rows == i]).tobytes() for i in range(part.last - part.first)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("at"), pa.array(found, pa.binary())], ["toxic", "at", "x"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, keys, found = [], [], []
        for batch in batches:
            labels += batch.column("toxic").to_pylist()
            keys += batch.column("at").to_pylist()
            found += [np.frombuffer(x.as_buffer(), U) for x in batch.column("x")]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(_fit(np.array(labels), np.array(keys), found, rates))], pa.binary())})

    fitted = labelled.mapInArrow(extract, "toxic int, at long, x binary").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0].model)


def _fit(labels: np.ndarray, keys: np.ndarray, found: list[np.ndarray], rates: tuple[float, float] = (1.0, 1.0)) -> dict:
    if len(np.unique(labels)) < 2:
        return {"hashes": np.zeros(0, U), "weights": np.zeros(0), "bias": UNTAUGHT}
    every, where = np.unique(np.concatenate(found), return_inverse=True)
    of_row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    toxic = np.bincount(where, labels[of_row], len(every))
    clean = np.bincount(where, 1 - labels[of_row], len(every))
    tells = np.abs(np.log((toxic + 0.5) / labels.sum()) - np.log((clean + 0.5) / (1 - labels).sum()))
    kept = np.flatnonzero((toxic + clean >= LEAST_ROWS) & (tells >= LEAST_TELL))  # of a bounded sample, so their number is bounded too
    slot = np.full(len(every), -1)
    slot[kept] = np.arange(len(kept))
    ends = np.cumsum([0, *(len(x) for x in found)])
    model = Ftrl(len(kept), 2, alpha=0.5, l1=0.7, l2=0.02)
    for _ in range(EPOCHS):
        for i in np.lexsort([labels, keys]):
            mine = slot[where[ends[i] : ends[i + 1]]]
            mine = mine[mine >= 0]
            model.step(mine, np.ones(len(mine)), int(labels[i]))
    w = model.weights()
    w = w[:, 1] - w[:, 0]
    used = np.flatnonzero(w[:-1])
    return {"hashes": every[kept[used]], "weights": w[used], "bias": float(w[-1] - np.log(rates[1] / rates[0]))}


class Scorer:
    def __init__(self, model: dict, costs: np.ndarray):
        self.model, self.restorer = model, Restorer(costs)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(model["hashes"] >> U(48)).astype(np.int64)] = True

    def column(self, texts: pa.Array) -> Iterator[float]:
        known, weights = self.model["hashes"], self.model["weights"]
        for part in slices(texts, SLICE_BYTES):
            rows, hashes = features(part, self.restorer)
            some = self.maybe[(hashes >> U(48)).astype(np.int64)]
            rows, hashes = rows[some], hashes[some]
            total = np.full(part.last - part.first, self.model["bias"])
            if len(hashes):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                once = np.unique(rows[hit] * len(known) + at[hit])
                total += np.bincount(once // len(known), weights[once % len(known)], len(total))
            yield from (1 / (1 + np.exp(-np.clip(total, -500, 500)))).tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document of (doc_id, text).

    ``labels`` has (doc_id, toxic); a document with several labels counts as toxic if any is, and
    null labels count as none; of rows that share a doc_id one is learned from. Rows outside fold ``held_out`` teach the classifier, up to ``sample``
    of each label, chosen by a hash of doc_id; the bias is corrected for the shares chosen. The character model counts all texts. Null and
    empty texts get the score of a text without features; without labels of both kinds, in an empty table for one, there is
    nothing to learn, and every score is 0; a text, a line or a word may have any length; equal texts get equal scores; a null doc_id has the fold of '';
    other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = learned_score(docs, labels, folds, held_out, sample)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learned_score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: dict[int, int] = SAMPLE) -> Callable[[Column], Column]:
    """A function from a text column to its toxicity, 0 to 1, learned as ``score_toxicity`` says."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    costs = language_model(docs)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id"), folds) != held_out).withColumn("at", F.xxhash64("doc_id"))
    known = materialize(known)
    sizes = dict(known.groupBy("toxic").count().collect())
    rates = tuple(min(1.0, sample[label] / max(1, sizes.get(label, 0))) for label in (0, 1))
    share = F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    chosen = materialize(known.filter(F.pmod("at", F.lit(1 << 30)) / (1 << 30) < share))  # about sum(sample) rows of 20 bytes
    text = F.min(F.struct(F.xxhash64("text"), "text")).alias("least")  # of rows that share an id one is learned from
    labelled = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "at").agg(text)
    model = train(labelled.select("toxic", "at", "least.text"), costs, rates)
    shared = docs.sparkSession.sparkContext.broadcast((model, costs))
    scorers: list[Scorer] = []  # of the worker

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(*shared.value))
        return pa.array(list(scorers[0].column(texts)), pa.float64())

    return score
