"""Context-triggered piecewise hashing of documents.

A rolling hash of seven bytes decides where chunks end, so an edit moves only the chunks it
touches. A fingerprint is ``block:signature:signature of the doubled block``: one character for
each chunk. Two fingerprints compare by edit distance where their block sizes meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import BYTE_VALUES, SLICE_BYTES, U, run_hash, slices

ROLLING = 7
LEAST_BLOCK = 3
LENGTH = 64
#: A doubled-block signature shorter than this says too little to be compared with its like.
SHORT = 16
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprints(texts: pa.Array) -> list[str]:
    """The fingerprint of each whole text of a string column (null: of the empty text, '3::')."""
    out = []
    for part in slices(texts, SLICE_BYTES):
        values = BYTE_VALUES[part.data]
        level = _levels(values)
        for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
            mine = level[a:b].copy()
            mine[: ROLLING - 1] = -1  # the window would reach into the row before
            out.append(_fingerprint(values[a:b], mine))
    return out


def _levels(values: np.ndarray) -> np.ndarray:
    """For each byte the largest k so that the rolling hash there is -1 modulo 3 * 2**k, else -1."""
    level = np.full(len(values), -1, np.int8)
    if len(values) < ROLLING:
        return level
    at = np.arange(len(values) - ROLLING + 1)
    rolled = (run_hash(values, at, at + ROLLING) >> U(32)) + U(1)
    hit = np.flatnonzero(rolled % U(LEAST_BLOCK) == 0)
    parts = rolled[hit] // U(LEAST_BLOCK)
    level[hit + ROLLING - 1] = np.log2((parts & (~parts + U(1))).astype(np.float64)).astype(np.int8)
    return level


def _fingerprint(values: np.ndarray, level: np.ndarray) -> str:
    """The least block that leaves at most LENGTH chunks, and the block twice as large."""
    if not len(values):
        return f"{LEAST_BLOCK}::"
    ends = np.flatnonzero(level >= 0)
    level = level[ends]
    at_least = np.cumsum(np.bincount(level, minlength=34)[::-1])[::-1]
    k = int(np.argmax(at_least < LENGTH))
    signatures = []
    for depth in (k, k + 1):
        cut = np.unique(np.append(ends[level >= depth] + 1, len(values)))
        hashes = run_hash(values, np.concatenate([[0], cut[:-1]]), cut)
        signatures.append(LETTERS[(hashes >> U(58)).astype(np.int64)].tobytes().decode())
    return f"{LEAST_BLOCK << k}:{signatures[0]}:{signatures[1]}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: 1 - edit distance / longer length, at a block size of both.

    With equal blocks the better of both signatures counts (of the doubled ones, if long enough);
    if one block is twice the other, the signatures of that block; else 0. Equal fingerprints: 1.
    """
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    block_a, block_b = part(a, 1).cast("long"), part(b, 1).cast("long")

    def alike(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longest)

    doubled = F.when(F.least(F.length(part(a, 3)), F.length(part(b, 3))) >= SHORT, alike(part(a, 3), part(b, 3))).otherwise(0.0)
    return (
        F.when(a == b, 1.0)
        .when(block_a == block_b, F.greatest(alike(part(a, 2), part(b, 2)), doubled))
        .when(block_a == 2 * block_b, alike(part(a, 2), part(b, 3)))
        .when(block_b == 2 * block_a, alike(part(a, 3), part(b, 2)))
        .otherwise(0.0)
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each (doc_id, text), of its edited text and of the next document, compared.

    Order: descending doc_id, nulls last, equal ids by text; after the last comes the first. The
    edited text has its last third (rounded down) of code points replaced by the first as many,
    or all, of the next document. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, next_fingerprint, near_edited, near_next. Null texts count as empty;
    a single document is next to itself; other columns are ignored; no rows give no rows.

    Documents are dealt to ranges of doc_id once; the first document of each range also goes,
    marked, to the range before it, so that no text is moved twice and no order is global.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 and not docs.isEmpty() else []
    cuts = np.unique(np.array(marks, np.int64))

    def own_range(ids: pa.Array) -> np.ndarray:  # 0 holds the largest ids, the last range the smallest and the nulls
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return len(cuts) - np.searchsorted(cuts, known, "right")

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(own_range(ids), pa.int32())

    heads = docs.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # one row a range
    before = {h.head: heads[k - 1].range for k, h in enumerate(heads)}

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array) -> pa.Array:
        rows = zip(own_range(ids).tolist(), ids.to_pylist(), strict=True)
        return pa.array([[r, before[x]] if x in before else [r] for r, x in rows], pa.list_(pa.int32()))

    dealt = docs.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("ahead", "range"))
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), "text")
    found = ordered.select("doc_id", "text", "ahead").mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return found.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, marks = [], [], []
    done = False
    for batch in batches:
        if done:
            continue
        ahead = batch.column("ahead").to_pylist()
        if 1 in ahead:  # the first row from the next range ends this one
            batch, done = batch.slice(0, ahead.index(1) + 1), True
        ids += batch.column("doc_id").to_pylist()
        texts += batch.column("text").to_pylist()
        marks = fingerprints(pa.array(texts, pa.string())) if not marks else marks + fingerprints(batch.column("text"))
        if len(texts) < 2:
            continue
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(marks[:-1]),
                pa.array(fingerprints(pa.array(edited, pa.string()))),
                pa.array(marks[1:]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
        )
        ids, texts, marks = ids[-1:], texts[-1:], marks[-1:]
