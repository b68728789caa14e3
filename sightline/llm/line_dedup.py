"""Removal of lines that many documents hold, found by two Bloom filters.

One pass puts the hash of every line into a filter of hashes seen once and, if it was there, into a
filter of hashes seen twice. Tasks do so for their own lines, and the filters of all tasks are then merged:
what two of them have seen once has been seen twice. Only lines in the second filter, the suspected
repeats, are sent over the network, as digests, and counted exactly; texts without a suspect never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, row_key
from .textkit import BYTE_VALUES, IS_WORD, LOWER, Slice, U, run_hash, slices

ROW = ["row_a", "row_b"]
#: Bits of either filter for each line, and at most: 2**28 bits are 32 MB. Beyond some 130 million different
#: lines the filters fill, more lines are suspected and counted, in the end all of them, with the same result.
BITS_A_LINE = 16
MOST_BITS = 28
#: Bits that a line sets in one 64-bit word of a filter.
PROBES = 4
#: Filters are merged by pieces of so many 64-bit words.
PIECE = 1 << 14
#: Text that is worked on at once; every byte takes some 100 in arrays meanwhile.
SLICE_BYTES = 1 << 18

OUT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string, row_a long, row_b long"


def drop_repeated_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, most_bits: int = MOST_BITS) -> DataFrame:
    r"""doc_id, n_lines, n_dropped, kept_sha256, kept (text), row_a, row_b (store.row_key) of every document of (doc_id, text).

    Texts are split at \n. A line's key is the line without space and U+0009 to U+000D at its ends, A-Z lower-cased.
    Keys of ``least_chars`` code points or more that ``least_docs`` (2 at least) or more documents hold lose all their lines
    but those of the largest doc_id that holds them. ``kept`` has the other lines, unchanged, joined by \n.

    Null and empty texts are one empty line; a line repeated within one document counts once and stays or goes in all its
    places; each row is a document of its own, so equal rows count apart, and rows that tie for the largest doc_id all keep
    their lines; a null doc_id is less than any other; a line and a text may have any length; other columns are ignored; no
    rows give no rows.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    n_lines = docs.select(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(most_bits, max(13, int(BITS_A_LINE * n_lines).bit_length()))
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(docs.select("text"), bits, least_chars))
    suspects = materialize(docs.mapInArrow(lambda it: _suspects(it, twice.value, least_chars), "doc_id long, row_a long, row_b long, key binary"))
    counted = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    repeated = materialize(counted.filter(F.col("n") >= least_docs).select("key", "keeper"))
    gone = suspects.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(*ROW).agg(F.collect_set("key").alias("gone"))  # of one row, no more than its lines

    texts = docs.mapInArrow(lambda it: _suspected(it, twice.value, least_chars), "doc_id long, text string, row_a long, row_b long")
    marked = texts.join(gone, ROW, "left").select("doc_id", "text", *ROW, "gone").mapInArrow(lambda it: _without_gone(it, least_chars), OUT)
    return docs.mapInArrow(lambda it: _clean(it, twice.value, least_chars), OUT).union(marked)


class Lines:
    """Lines of a slice: byte ranges, the row of each, and the byte ranges and hashes of the keys that are long enough."""

    def __init__(self, part: Slice, least_chars: int):
        data, rows = part.data, np.arange(len(part.offsets) - 1)
        breaks = np.flatnonzero(data == 10)
        start = np.concatenate([part.offsets[:-1], breaks + 1])
        row = np.concatenate([rows, np.searchsorted(part.offsets, breaks, "right") - 1])
        order = np.lexsort((start, row))
        self.row, self.start = row[order], start[order]
        last = np.append(self.row[1:] != self.row[:-1], True)
        self.end = np.where(last, part.offsets[self.row + 1], np.append(self.start[1:], 0) - 1)
        inside = np.flatnonzero(IS_WORD[data])
        first, behind = np.searchsorted(inside, self.start), np.searchsorted(inside, self.end)
        filled = np.flatnonzero(first < behind)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        a, b = inside[first[filled]], inside[behind[filled] - 1] + 1
        long = chars[b] - chars[a] >= least_chars
        self.keyed, self.key_start, self.key_end = filled[long], a[long], b[long]
        self.lower = LOWER[data]
        self.hash = run_hash(BYTE_VALUES[self.lower], self.key_start, self.key_end)

    def key(self, k: int) -> bytes:
        """Digest of the k-th key."""
        return hashlib.blake2b(self.lower[self.key_start[k] : self.key_end[k]], digest_size=16).digest()


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a filter of 2**bits bits that each hash belongs to, and its bits there."""
    mask = np.zeros(len(hashes), U)
    for k in range(PROBES):
        mask |= U(1) << ((hashes >> U(6 * k)) & U(63))
    return ((hashes * U(0x9E3779B97F4A7C15)) >> U(64 - bits + 6)).astype(np.int64), mask


def _in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, mask = _places(hashes, len(table).bit_length() + 5)
    return table[at] & mask == mask


def twice_seen(texts: DataFrame, bits: int, least_chars: int) -> np.ndarray:
    """The filter, as 2**bits / 64 words, of the line hashes that at least two rows of the only column of ``texts`` hold.

    Few tasks read much each, so that all their filters together stay small against the input.
    """
    size = (1 << bits) // 64

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, U), np.zeros(size, U)
        for batch in batches:
            for part in slices(batch.column(0), SLICE_BYTES):
                lines = Lines(part, least_chars)
                row, order = lines.row[lines.keyed], np.lexsort((lines.row[lines.keyed], lines.hash))
                h, row = lines.hash[order], row[order]
                same = np.append(False, h[1:] == h[:-1])
                h = h[~(same & np.append(False, row[1:] == row[:-1]))]  # once a row
                more = np.append(False, h[1:] == h[:-1])
                at, mask = _places(h, bits)
                more |= once[at] & mask == mask
                np.bitwise_or.at(twice, at[more], mask[more])
                np.bitwise_or.at(once, at, mask)
        for k in range(0, size, PIECE):
            if once[k : k + PIECE].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // PIECE], pa.int32()), "once": [once[k : k + PIECE].tobytes()], "twice": [twice[k : k + PIECE].tobytes()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = piece = None
        for batch in batches:
            for p, a, b in zip(*(batch.column(c) for c in ("piece", "once", "twice")), strict=True):
                a, b = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                if once is None:
                    piece, once, twice = p.as_py(), a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "twice": [twice.tobytes()]})

    merged.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    tasks = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    pieces = tasks.mapInArrow(local, "piece int, once binary, twice binary").groupBy("piece").applyInArrow(merged, "piece int, twice binary")
    out = np.zeros(size, U)
    for r in pieces.toLocalIterator():  # 2**bits / 8 bytes in all
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.twice, U)
    return out


def _suspects(batches: Iterator[pa.RecordBatch], twice: np.ndarray, least_chars: int) -> Iterator[pa.RecordBatch]:
    """doc_id, row key and digest of each suspected key of a row, once a row."""
    for batch in batches:
        for part in slices(batch.column("text"), SLICE_BYTES):
            lines = Lines(part, least_chars)
            found = {}
            for k in np.flatnonzero(_in(twice, lines.hash)):
                found[lines.row[lines.keyed[k]], lines.key(k)] = None
            if found:
                which = pa.array([part.first + int(r) for r, _ in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in ("doc_id", *ROW)), pa.array([key for _, key in found], pa.binary())], ["doc_id", *ROW, "key"])


def _suspected(batches: Iterator[pa.RecordBatch], twice: np.ndarray, least_chars: int) -> Iterator[pa.RecordBatch]:
    """The rows that have suspected lines."""
    for batch in batches:
        for part in slices(batch.column("text"), SLICE_BYTES):
            if len(rows := np.flatnonzero(_has_suspects(part, twice, least_chars))):
                yield batch.take(pa.array(part.first + rows)).select(["doc_id", "text", *ROW])


def _clean(batches: Iterator[pa.RecordBatch], twice: np.ndarray, least_chars: int) -> Iterator[pa.RecordBatch]:
    """The result of the rows that have no suspected lines."""
    for batch in batches:
        for part in slices(batch.column("text"), SLICE_BYTES):
            if len(rows := np.flatnonzero(~_has_suspects(part, twice, least_chars))):
                yield _result(batch, part, rows, [(part.text(i), 0) for i in rows], [part.text(i).count(b"\n") + 1 for i in rows])


def _without_gone(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """The result of rows with ``gone``, the digests of the keys that they lose, or null."""
    for batch in batches:
        for part in slices(batch.column("text"), SLICE_BYTES):
            lines = Lines(part, least_chars)
            rows, found = np.arange(part.last - part.first), []
            first = np.searchsorted(lines.row, np.append(rows, len(rows)))
            first_key = np.searchsorted(lines.keyed, first)
            for i in rows:
                gone, text, out = batch.column("gone")[part.first + int(i)].as_py(), part.text(i), None
                if gone:
                    out, gone = np.zeros(first[i + 1] - first[i], bool), set(gone)
                    for k in range(first_key[i], first_key[i + 1]):
                        out[lines.keyed[k] - first[i]] = lines.key(k) in gone
                    text = b"\n".join(part.data[lines.start[x] : lines.end[x]].tobytes() for x in first[i] + np.flatnonzero(~out))
                found.append((text, 0 if out is None else int(out.sum())))
            yield _result(batch, part, rows, found, np.diff(first))


def _has_suspects(part: Slice, twice: np.ndarray, least_chars: int) -> np.ndarray:
    lines = Lines(part, least_chars)
    suspected = np.zeros(part.last - part.first, bool)
    suspected[lines.row[lines.keyed[_in(twice, lines.hash)]]] = True
    return suspected


def _result(batch: pa.RecordBatch, part: Slice, rows: np.ndarray, kept: list[tuple[bytes, int]], n_lines) -> pa.RecordBatch:
    which = pa.array(part.first + rows)
    digests, texts = pa.array([hashlib.sha256(x).hexdigest() for x, _ in kept], pa.string()), pa.array([x.decode() for x, _ in kept], pa.string())
    counts = [pa.array(x, pa.int64()) for x in (n_lines, [n for _, n in kept])]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), *counts, digests, texts, *(batch.column(c).take(which) for c in ROW)], [c.split()[0] for c in OUT.split(", ")])
