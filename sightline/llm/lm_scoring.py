"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are interpolated bigram models of the same form over one vocabulary, all words of
all documents, so that a per-token loss difference compares like with like. No pair or word is dropped.

Documents are dealt by hash into chunks of bounded size. A chunk asks for the counts of its distinct
words and pairs, with its own counts, at the *part* that each belongs to by hash; a part, of bounded size too, adds up
what all chunks ask and answers each in the order it asked. With the answers a chunk scores its
documents. So each pair crosses the network once for a chunk, packed with its neighbours in a
few bytes, and no key, however frequent, has more rows than there are chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, row_key, shared_dir
from .textkit import Slice, U, mix, slices, words

#: Share of the bigram estimate, and the pseudo-count of each word in the unigram estimate.
BIGRAM_SHARE, SMOOTHING = 0.6, 0.5
#: What stands before the first word of a text.
START = U(0x5354415254)
#: Bytes of text of a chunk, and of requests of a part: they set memory and files, not results.
CHUNK_BYTES, PART_BYTES = 6 << 20, 8 << 20
#: Buckets of the table of texts: Spark makes 100,000 at most.
MOST_BUCKETS = 1 << 15
#: Sets pairs apart from words.
PAIR_SALT = U(0x9E3779B97F4A7C15)

ROW = "doc_id long, row_a long, row_b long"
SCORES = f"{ROW}, n_tokens long, target_loss double, background_loss double"


def pack(values: np.ndarray) -> bytes:
    """Numbers, compressed; rising ones as differences, bytes of equal weight together."""
    shape = np.diff(values, prepend=values[:1] * 0) if values.dtype == U else values
    return zstandard.ZstdCompressor(level=1).compress(shape.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    found = np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(found, dtype=U) if kind is U else found


def _tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word before, hash of the word, first word of each row) of the words of a slice."""
    w = words(part, lower=True)
    before = np.concatenate([[START], w.hash[:-1]])[: len(w.hash)].astype(U)
    first = w.of_row[:-1]
    before[first[first < w.of_row[1:]]] = START
    return before, w.hash, w.of_row


class Chunk:
    """The words and pairs of a chunk's documents, each distinct one once, sorted."""

    def __init__(self, texts: pa.ChunkedArray):
        found = [_tokens(part) for piece in texts.chunks for part in slices(piece)]
        joined = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, U)
        before, word = joined(0), joined(1)
        self.lengths = np.concatenate([np.diff(f[2]) for f in found]) if found else np.zeros(0, np.int64)
        self.pairs, self.pair_of = np.unique(mix(before * U(3) + PAIR_SALT) + word, return_inverse=True)
        self.words, place = np.unique(np.concatenate([word, before]), return_inverse=True)
        self.word_of, self.before_of = place[: len(word)], place[len(word) :]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (target, background) counts: of pairs, of words, and of words as what stands before one."""
        side = np.repeat(~target, self.lengths).astype(np.int64)
        of = lambda place, n: np.bincount(2 * place + side, minlength=2 * n).reshape(n, 2)
        return of(self.pair_of, len(self.pairs)), of(self.word_of, len(self.words)), of(self.before_of, len(self.words))


ASK = "part int, chunk int, keys binary, counts binary"


def _asked(chunk: int, parts: int, first: int, keys: np.ndarray, *counts: np.ndarray) -> Iterator[tuple]:
    """Rows of a request: keys are sorted, so those of a part, equal shares of the hash range, stand together."""
    ends = np.searchsorted(keys >> U(32), np.arange(parts + 1, dtype=U) * U(1 << 32) // U(parts))
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if a < b:
            table = np.concatenate([c[a:b] for c in counts], 1)
            kind = np.uint8 if table.max() < 256 else np.uint32 if table.max() < 1 << 32 else np.uint64
            yield first + k, chunk, pack(keys[a:b]), np.dtype(kind).char.encode() + pack(np.ascontiguousarray(table.T, kind).reshape(-1))


def _counts(raw: bytes, n: int) -> np.ndarray:
    return unpack(raw[1:], np.dtype(raw[:1].decode()).type).reshape(-1, n).T.astype(np.int64)


def _answers(asked: pa.Table) -> pa.Table:
    """For each chunk that asked a part, the sums over all chunks, in the order of its keys; ``distinct``: how many keys the part has."""
    keys = [unpack(x.as_py(), U) for x in asked.column("keys")]
    counts = [_counts(x.as_py(), len(k)) for x, k in zip(asked.column("counts"), keys, strict=True)]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.stack([np.bincount(place, column, len(every)) for column in np.concatenate(counts).T], 1).astype(np.int64)
    out, at = [], 0
    for k in keys:
        mine = total[place[at : at + len(k)]]
        at += len(k)
        kind = np.uint8 if mine.max() < 256 else np.uint32 if mine.max() < 1 << 32 else np.uint64
        out.append(np.dtype(kind).char.encode() + pack(np.ascontiguousarray(mine.T, kind).reshape(-1)))
    sizes = pa.array([len(k) for k in keys], pa.int64())
    same = lambda x, kind: pa.array([x] * len(keys), kind)
    # every word is a token but the start of a text, which has no count as one
    is_word = (total[:, 0] + total[:, 1] > 0).sum()
    sums = total[:, :2].sum(0)
    return pa.table([asked.column("part"), asked.column("chunk"), sizes, pa.array(out, pa.binary()), same(int(is_word), pa.int64()), same(int(sums[0]), pa.int64()), same(int(sums[1]), pa.int64())], names=["part", "chunk", "n", "totals", "words", "target", "background"])


ANSWER = "part int, chunk int, n long, totals binary, words long, target long, background long"


def _losses(chunk: Chunk, answers: pa.Table, parts: int, size: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss of each document of a chunk under both models; nan without tokens."""
    order = answers.sort_by("part")
    found = [_counts(x.as_py(), n) for x, n in zip(order.column("totals"), order.column("n").to_pylist(), strict=True)]
    split = int(pc.sum(pc.less(order.column("part"), parts)).as_py() or 0)
    pairs = np.concatenate(found[:split]) if split else np.zeros((0, 2), np.int64)
    known = np.concatenate(found[split:]) if found[split:] else np.zeros((0, 4), np.int64)
    ends = np.cumsum(chunk.lengths)
    out = []
    for side, name in enumerate(("target", "background")):
        bigram = pairs[chunk.pair_of, side] / np.maximum(known[chunk.before_of, 2 + side], 1)
        unigram = (known[chunk.word_of, side] + SMOOTHING) / (size[name] + SMOOTHING * (size["words"] + 2))
        loss = -np.log(BIGRAM_SHARE * bigram + (1 - BIGRAM_SHARE) * unigram)
        begins = ends - chunk.lengths
        total = np.add.reduceat(np.append(loss, 0.0), np.minimum(begins, len(loss)))[: len(ends)] if len(ends) else np.zeros(0)
        out.append(np.where(chunk.lengths > 0, total / np.maximum(chunk.lengths, 1), np.nan))
    return out[0], out[1]


def score(docs: DataFrame, target_ids: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document of (doc_id, text).

    ``target_ids`` (doc_id) names the documents of the target model; all others are the background.
    Losses are mean nats per word; ``score`` is target minus background, lower for texts that are
    more like the target. Null, empty and all-space texts have no tokens, and null losses and score.
    Without target documents the target model is uniform. Equal texts get equal scores, but for
    rounding; a null doc_id is never a target; a text of any length counts whole, within one chunk; other
    columns are ignored; no rows give no rows. Words and pairs are told apart by 64-bit hashes.

    Texts are dealt once into a bucketed table of the session's catalog, whose warehouse all executors must share; its files are in the shared
    folder, and later steps read them without a shuffle. From ``most_buckets`` on, a bucket holds several chunks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-size // part_bytes))
    # a task that runs again deals a row alike; equal rows of different tasks do not meet in one chunk
    chunk = F.pmod(F.xxhash64("row_a", F.spark_partition_id()), F.lit(chunks)).cast("int")
    name, buckets = f"sightline_{uuid.uuid4().hex}", min(chunks, most_buckets)
    dealt = docs.withColumn("chunk", chunk).repartition(buckets, "chunk")
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "chunk").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    dealt = spark.table(name)

    targets = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    marked = materialize(dealt.select("chunk", "doc_id").distinct().join(targets, "doc_id", "left_semi"))

    def ask(texts: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        if len(texts):
            found = Chunk(texts.column("text"))
            target = pc.is_in(texts.column("doc_id"), marks.column("doc_id").combine_chunks()).to_numpy()
            pairs, single, before = found.counts(target)
            rows = [*_asked(texts.column("chunk")[0].as_py(), parts, 0, found.pairs, pairs), *_asked(texts.column("chunk")[0].as_py(), parts, parts, found.words, single, before)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["part", "chunk", "keys", "counts"])

    asked = dealt.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(ask, ASK)
    answers = materialize(asked.groupBy("part").applyInArrow(_answers, ANSWER))
    whole = answers.filter(F.col("part") >= parts).groupBy("part").agg(*(F.first(c).alias(c) for c in ("words", "target", "background")))
    sizes = whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "target", "background"))).first().asDict()

    def losses(texts: pa.Table, got: pa.Table) -> pa.Table:
        target, background, n = [], [], []
        if len(texts):
            found = Chunk(texts.column("text"))
            target, background = _losses(found, got, parts, sizes)
            n = found.lengths
        loss = [pa.array(np.asarray(x, float), pa.float64(), from_pandas=True) for x in (target, background)]
        return pa.table([*(texts.column(c) for c in ("doc_id", "row_a", "row_b")), pa.array(n, pa.int64()), *loss], names=["doc_id", "row_a", "row_b", "n_tokens", "target_loss", "background_loss"])

    scored = dealt.groupBy("chunk").cogroup(answers.select("chunk", "part", "n", "totals").groupBy("chunk")).applyInArrow(losses, SCORES)
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
