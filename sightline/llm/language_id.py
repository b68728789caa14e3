"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .linear import Ftrl, softmax, temperature
from .textkit import U, mix, slices

SLOT_BITS = 15
ORDERS = (1, 2, 3)
#: Rows that the classifier is fitted on, for each language at most; document frequencies use all.
SAMPLE_PER_LANGUAGE = 1000
#: Languages that one model may hold; more are an error, none is left out.
MAX_LANGUAGES = 1000
EPOCHS = 2
CALIBRATION_SHARE = 5
UNKNOWN = "und"
SLICE_BYTES = 1 << 19


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(slots, counts) of each whole text's character n-grams; None if it has no letter."""
    for part in slices(texts, SLICE_BYTES):
        raw = part.data.tobytes().decode()
        codes = np.frombuffer(raw.replace("İ", "i").replace("Σ", "σ").lower().encode("utf-32-le"), np.uint32).astype(U)
        at = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])[part.offsets].tolist()
        grams, running = [], np.zeros(len(codes), U)
        for order in range(1, max(ORDERS) + 1):
            running = mix(running[: len(codes) - order + 1] * U(0x100000001B3) + codes[order - 1 :] + U(1)) if len(codes) >= order else running[:0]
            grams.append((running >> U(64 - SLOT_BITS)).astype(np.int64))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if not any(map(str.isalpha, raw[a:b])):
                yield None
                continue
            counts = np.bincount(np.concatenate([grams[k - 1][a : max(a, b - k + 1)] for k in ORDERS]), minlength=1 << SLOT_BITS)
            slots = np.flatnonzero(counts)
            yield slots, counts[slots]


def _tf_idf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[slots]
    return values / max(np.sqrt(values @ values), 1e-12)


def train(rows: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> dict:
    """A model from (text, lang, key): languages, weights, idf and temperature; a few MB at most.

    Document frequencies are counted over all rows. The classifier is fitted on about ``sample`` rows
    for each language: those with a hash of ``key`` and text below the share that makes so many, equal rows
    once. A fifth of them is kept from training, to fit the temperature.
    """
    rows = rows.select("text", "lang", F.xxhash64("key", "text").alias("at"))
    sizes = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the weights of one model would not fit")
    languages = sorted(sizes)
    if not languages:
        return {"languages": []}

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for found in _features(batch.column("text")):
            if found:
                total[found[0]] += 1

    frequency = sketch.dense(rows.select("text"), 1 << SLOT_BITS, np.int64, fill)
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1
    share = F.lit(None).cast("double")
    for name in languages:
        share = F.when(F.col("lang") == name, sample / sizes[name]).otherwise(share)
    chosen = rows.filter((F.pmod("at", F.lit(1 << 30)) / (1 << 30)) < share).groupBy("lang", "at").agg(F.first("text").alias("text"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(x and (x[0].astype(np.uint16), _tf_idf(*x, idf).astype(np.float32))) for x in _features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("at"), pa.array(found, pa.binary())], ["lang", "at", "x"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = sorted((r["at"], languages.index(r["lang"]), r["x"]) for batch in batches for r in batch.to_pylist())
        examples = [(label, pickle.loads(x)) for _, label, x in examples]
        examples = [(label, *x) for label, x in examples if x]
        model = Ftrl(1 << SLOT_BITS, len(languages), alpha=0.5, l1=0.2, l2=0.05)
        for _ in range(EPOCHS):
            for k, (label, slots, values) in enumerate(examples):
                if k % CALIBRATION_SHARE:
                    model.step(slots.astype(np.int64), values, label)
        w = model.weights().astype(np.float32)
        kept = examples[::CALIBRATION_SHARE]
        scores = np.array([v @ w[s.astype(np.int64)] + w[-1] for _, s, v in kept]).reshape(len(kept), len(languages))
        t = temperature(scores, np.array([label for label, *_ in kept], np.int64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((w, t))], pa.binary())})

    fitted = chosen.mapInArrow(extract, "lang string, at long, x binary").repartition(1).mapInArrow(fit, "model binary")
    w, t = pickle.loads(fitted.first()[0])
    return {"languages": languages, "weights": w, "idf": idf.astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of (doc_id, held_out, text): the likeliest language and its calibrated probability.

    Null texts and texts without a letter are 'und' with score 0, as is everything if no
    language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for found in _features(batch.column("text")):
                if found is None or not m["languages"]:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax((_tf_idf(*found, m["idf"]) @ m["weights"][found[0]] + m["weights"][-1]) / m["temperature"])
                names.append(m["languages"][int(np.argmax(p))])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (of '' for null), modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document of (doc_id, text, lang).

    Learns from text and non-null lang of documents outside fold ``held_out``; lang, source and
    doc_id are no inputs of a prediction. Texts count whole. Equal texts get equal predictions;
    a null doc_id has the fold of ''; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    model = train(docs.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("text", "lang", F.col("doc_id").alias("key")), sample)
    return predict(docs.select("doc_id", "held_out", "text"), model)
