"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length token window.

Every window of every document is hashed. Equal windows hold the same *anchor*, the smallest
hash among their shorter word runs, so a window whose anchor occurs only once is known to be
unique. Anchors (a tenth as many as windows) are counted in Spark first; the windows with a
repeated anchor are then counted in Spark one by one, by their own hash, and the repeated
ones merge into maximal intervals of removed words. A window is known by two hashes, 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .store import materialize, row_key
from .textkit import Slice, U, Words, mix, run_hash, slices, sliding, window_hash, words

WINDOW = 35
ANCHOR = 12
#: The filter of repeated anchors takes 16 bits for each, 2**28 bits (32 MB) at most; beyond
#: that more windows are counted, and without a filter all of them, with the same result.
BLOOM_MAX_BITS = 28

KEY = "row_a long, row_b long"
ROW = ["row_a", "row_b"]


def remove_repeats(docs: DataFrame, width: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text), row_a, row_b (store.row_key) of every document of (doc_id, text).

    A word goes if a window of ``width`` words that covers it also starts anywhere else, in the
    same document or another; windows are those of the input. ``kept_sha256`` digests the other words
    joined by one space, and ``kept`` is that, or the whole text if no word goes. Words are runs of bytes other than space and U+0009 to U+000D.

    Null and empty texts have no words and keep ''; texts of fewer than ``width`` words keep all;
    equal rows repeat each other and so lose every word that a window covers; a null doc_id is
    an id like any other; a word and a text may have any length; other columns are ignored; no rows give no rows.
    """
    anchor = min(anchor, width)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    found = _scan(docs, "hash long", lambda h: (_anchor_rows(h, width, anchor),))
    again = materialize(found.groupBy("hash").count().filter("count > 1").select("hash"))
    bits = min(BLOOM_MAX_BITS, max(10, int(16 * max(1, again.count())).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(sketch.bloom(again, bits))
    suspects = lambda h: _suspects(h, width, anchor, table.value, bits)

    counted = _scan(docs, "hash long, proof int", lambda h: _window_rows(h, width, suspects(h))).groupBy("hash", "proof").count()
    repeated = materialize(counted.filter("count > 1").select("hash", "proof"))
    windows = _scan(docs, f"{KEY}, hash long, proof int, at int", lambda h: _window_rows(h, width, suspects(h)))
    starts = windows.join(repeated, ["hash", "proof"], "left_semi").groupBy(*ROW).agg(F.collect_set("at").alias("starts"))

    any_suspect = lambda h: bool(suspects(h).any())
    clean = docs.mapInArrow(lambda it: _digests(it, width, lambda h: not any_suspect(h)), OUT)
    texts = docs.mapInArrow(lambda it: _texts(it, any_suspect), f"doc_id long, {KEY}, text string")
    marked = texts.join(starts, ROW, "left")
    return clean.unionByName(marked.select("doc_id", *ROW, "text", "starts").mapInArrow(lambda it: _digests(it, width), OUT))


OUT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, {KEY}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Slice, Words]]:
    for batch in batches:
        for part in slices(batch.column("text")):
            yield batch, part, words(part)


def _scan(docs: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows made from each document's word hashes; ``rows_of`` gives the hashes and, as the schema asks, their proofs and places."""
    names = [c.split()[0] for c in schema.split(", ")]
    keyed = names[0] in ROW

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, w in _rows(batches):
            got = [rows_of(w.hash[a:b]) for a, b in zip(w.of_row[:-1], w.of_row[1:], strict=True)]
            columns = [np.concatenate([g[k] for g in got]) for k in range(len(names) - 2 * keyed)]
            columns = [pa.array(c.view(np.int64) if c.dtype == U else c) for c in columns]
            if keyed:
                which = pa.array(np.repeat(np.arange(part.first, part.last), [len(g[0]) for g in got]))
                columns = [batch.column(c).take(which) for c in ROW] + columns
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(task, schema)


def _anchors(hashes: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``anchor`` words, and for each window the least of those in it."""
    runs = window_hash(hashes, anchor)
    return runs, sliding(np.minimum, runs, width - anchor + 1)


def _anchor_rows(hashes: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """The runs that are the anchor of a window: each place counts, even with an equal hash."""
    runs, least = _anchors(hashes, width, anchor)
    if not len(least):
        return runs[:0]
    edge = np.zeros(width - anchor, U)
    return runs[sliding(np.maximum, np.concatenate([edge, least, edge]), width - anchor + 1) == runs]


def _suspects(hashes: np.ndarray, width: int, anchor: int, table: np.ndarray, bits: int) -> np.ndarray:
    return sketch.in_bloom(table, _anchors(hashes, width, anchor)[1], bits)


#: Sets the second hash of a window apart from the first.
PROOF = U(0xA0761D6478BD642F)


def _window_rows(hashes: np.ndarray, width: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, proof, place) of the windows of a mask; the proof is half of a hash of otherwise mixed words."""
    at = np.flatnonzero(mask)
    proof = (run_hash(mix(hashes ^ PROOF), at, at + width) >> U(32)).astype(np.uint32).view(np.int32)
    return run_hash(hashes, at, at + width), proof, at.astype(np.int32)


def _texts(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    for batch, part, w in _rows(batches):
        rows = [part.first + i for i in range(part.last - part.first) if wanted(w.hash[w.of_row[i] : w.of_row[i + 1]])]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in ("doc_id", *ROW, "text")], ["doc_id", *ROW, "text"])


def _digests(batches: Iterator[pa.RecordBatch], width: int, wanted=None) -> Iterator[pa.RecordBatch]:
    for batch, part, w in _rows(batches):
        marked = "starts" in batch.schema.names
        out: list[list] = [[], [], [], [], []]
        done = []
        for i in range(part.last - part.first):
            a, b = w.of_row[i], w.of_row[i + 1]
            if wanted and not wanted(w.hash[a:b]):
                continue
            done.append(part.first + i)
            starts = batch.column("starts")[part.first + i].values if marked else None
            kept_words, removed = part.text(i).split(), 0
            if starts is not None and len(starts):
                # +1 where a removed window starts, -1 behind it: intervals merge by themselves
                step = np.zeros(b - a + 1, np.int32)
                at = starts.to_numpy()
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                kept_words = [kept_words[k] for k in np.flatnonzero(~gone)]
            kept = b" ".join(kept_words)
            for column, value in zip(out, (batch.column("doc_id")[part.first + i].as_py(), int(b - a), removed, hashlib.sha256(kept).hexdigest(), (kept if removed else part.text(i)).decode()), strict=True):
                column.append(value)
        if out[0]:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            keys = [batch.column(c).take(pa.array(done)) for c in ROW]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, types, strict=True)), *keys], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *ROW])
