"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file is a sequence of zstandard frames in the public seekable format, so any zstandard
reader can read it. Each frame but the last holds the ids of whole documents, little-endian,
two bytes each for small vocabularies, else four. The last frame is the index: for each
document its id, whether that is null, its number of tokens and its frame. The seek table
behind it, a skippable frame, gives each frame's sizes and the low half of its xxh64.
A reader seeks to the table, reads the index, and decompresses only frames it wants.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pretokens import byte_letters, gather, split
from .store import materialize, shared_dir
from .textkit import slices

FRAME_IDS = 1 << 16
MEMO_WORDS = 300_000
SLICE_BYTES = 1 << 20

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_tokens", "<u4"), ("frame", "<u4")])


class Writer:
    """Writes one file; ``add`` documents, then ``close``."""

    def __init__(self, out, width: int):
        self.out, self.kind = out, np.dtype(f"<u{width}")
        self.press = zstandard.ZstdCompressor(level=1)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.pending: list[np.ndarray] = []
        self.size = 0
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids), len(self.table)))
        self.pending.append(ids.astype(self.kind))
        self.size += len(ids)
        self.n_ids += len(ids)
        if self.size >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self._frame(np.concatenate(self.pending).tobytes())
            self.pending, self.size = [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.press.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> None:
        self._flush()
        self._frame(bytes([self.kind.itemsize]) + np.array(self.index, INDEX).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class Reader:
    """Random access to one file: ``index`` lists its documents in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable zstandard file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.table, self.begin = table, np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        head = self.frame(frames - 1)
        self.kind = np.dtype(f"<u{head[0]}")
        self.index = np.frombuffer(head, INDEX, offset=1)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(length))

    def frame(self, number: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.begin[number], self.table[number, 0]), max_output_size=int(self.table[number, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[number, 2]:
            raise ValueError(f"frame {number} is damaged")
        return raw

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the index, ids) of all documents, or of the ``wanted`` places (ascending)."""
        places = np.arange(len(self.index)) if wanted is None else wanted
        n_tokens, frame_of = self.index["n_tokens"].astype(np.int64), self.index["frame"]
        starts = np.cumsum(n_tokens) - n_tokens
        now, ids, base = -1, None, 0
        for k in places.tolist():
            if frame_of[k] != now:
                now = int(frame_of[k])
                ids, base = np.frombuffer(self.frame(now), self.kind), starts[np.searchsorted(frame_of, now)]
            yield k, ids[starts[k] - base : starts[k] - base + n_tokens[k]]


class Encoder:
    """ids of whole texts as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Words of a slice are told apart by the vectorised splitter; the library's model encodes each
    new word once and a bounded memo keeps it. Rows that the splitter leaves go to the library whole.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.letters, self.memo = self.tokenizer.model, byte_letters(), {}

    def word(self, raw: bytes) -> list[int]:
        if (ids := self.memo.get(raw)) is None:
            ids = [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[raw] = ids
        return ids

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for part in slices(texts, SLICE_BYTES):
            found = split(part, clip=False)
            ids, lengths = gather(found.codes, [self.word(w) for w in found.distinct])
            ends = np.concatenate([[0], np.cumsum(lengths)])[found.first]
            for i in range(part.last - part.first):
                if found.unsafe[i]:
                    yield np.array(self.tokenizer.encode(part.text(i).decode(), add_special_tokens=False).ids, np.int64)
                else:
                    yield ids[ends[i] : ends[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode (doc_id, text) into files in ascending order of doc_id (nulls first, then by text).

    Returns the manifest: shard, path, n_docs, n_ids, start (ids in all shards before). Every document
    ends in ``end_id``; null and empty texts are that id alone. ``folder`` is a URI that driver and
    executors share (by default a new one under spark.checkpoint.dir). A file carries its task attempt
    in its name, and the manifest names only files of attempts that ended well, so a lost executor or
    a repeated task leaves no wrong file. Other columns are ignored; no rows give no files.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/sightline-tokens-{uuid.uuid4().hex}"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        encode = encoder(tokenizer_path)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        task, writer, end = TaskContext.get(), None, np.array([end_id])
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id"), encode.column(batch.column("text")), strict=True):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    writer = Writer(files.open_output_stream(path), width)
                writer.add(doc_id.as_py(), np.concatenate([ids, end]))
        if writer:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "n_docs": [len(writer.index)], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return shards.withColumns({"start": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "folder": F.lit(folder)})


def _by_file(manifest: DataFrame) -> DataFrame:
    """The manifest over as many partitions as it has files: a count of our own, which adaptive execution leaves alone."""
    files = materialize(manifest)
    return files.repartition(max(1, files.count()), "shard")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, each frame's checksum tested.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = pafs.FileSystem.from_uri(row["folder"])
                with files.open_input_file(row["path"]) as source:
                    reader = Reader(source)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()), np.int64, len(reader.index))
                n_tokens = reader.index["n_tokens"].astype(np.int64)
                ids = pa.array(reader.index["doc_id"].astype(np.int64), mask=reader.index["is_null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["start"] + np.cumsum(n_tokens) - n_tokens), pa.array(n_tokens), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _by_file(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids of the wanted documents only: frames without any of them stay compressed.

    ``doc_ids`` has one column, doc_id; it is dealt to the shards whose id range can hold it.
    """

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = pafs.FileSystem.from_uri(row["folder"])
                with files.open_input_file(row["path"]) as source:
                    index = Reader(source).index
                places = np.flatnonzero(index["is_null"] == 0)
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["doc_id"][places].astype(np.int64)), pa.array(places.astype(np.int64)), pa.array([row["path"]] * n, pa.string()), pa.array([row["folder"]] * n, pa.string())],
                    ["doc_id", "place", "path", "folder"],
                )

    def fetch(table: pa.Table) -> pa.Table:
        files, _ = pafs.FileSystem.from_uri(table.column("folder")[0].as_py())
        with files.open_input_file(table.column("path")[0].as_py()) as source:
            reader = Reader(source)
            places = np.sort(table.column("place").to_numpy())
            ids = [x.astype(np.int64) for _, x in reader.documents(places)]
        return pa.table({"doc_id": pa.array(reader.index["doc_id"][places].astype(np.int64)), "ids": pa.array(ids, pa.list_(pa.int64()))})

    index = _by_file(manifest).mapInArrow(ranges, "doc_id long, place long, path string, folder string")
    wanted = index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return wanted.groupBy("path").applyInArrow(fetch, "doc_id long, ids array<long>")
