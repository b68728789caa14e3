"""How filters of a corpus act together: every order of five filters, by part of the corpus.

Copies are found by a fingerprint-routed RDD. Each task first folds the copies that it holds itself, so that
a text leaves a task once, with the least id that has it; texts go to the task that their xxhash names, which
chains texts of one hash, compares them whole and keeps the least id of each. All other ids are
copies. What a document fails is a mask of five bits; masks are counted by part in
vectors that combineByKey() merges, and the vectors give every order of the filters.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Text that a task folds before it sends what it has, and that a partition of texts holds at most, beside what spark.sql.shuffle.partitions asks.
FOLD_BYTES = 64 << 20
PART_BYTES = 128 << 20

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def audit(docs: DataFrame, labels: DataFrame, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> DataFrame:
    """part, filter_order, step and counts: what each filter does at each step of all 120 orders, in each source.

    Filters fail documents of (doc_id, text, source): A with under ``least_words`` words, B with under ``distinct_percent``
    percent of them different, C with more than ``capital_percent`` percent of A-Z, D with one of ``#$%&*|``, E whose text some
    smaller doc_id has, in any source. ``labels`` has (doc_id, quality, toxic), 1 for yes; of several
    rows of an id a 1 counts.

    Null and empty texts are empty texts and copies of each other; a null source is the part '', with the empty
    one; a null doc_id is neither smaller nor larger than another and has no labels; rows of one doc_id are no copies of each
    other, and equal rows each count; a text may have any length; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    routed = routed_rows(docs, least_words, distinct_percent, capital_percent)
    rows = spark.createDataFrame(routed, "doc_id long, part string, mask int, n long")
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    marked = rows.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    vectors = marked.rdd.map(lambda r: (r[0], r[1:])).combineByKey(lambda v: _add(np.zeros((3, 32), np.int64), v), _add, np.add, partitionFunc=lambda part: xxhash.xxh64_intdigest(part))
    return spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), OUT)


def copy_ids(docs: DataFrame) -> DataFrame:
    """doc_id of every document of (doc_id, text) whose text some smaller doc_id has; rules as for ``audit``."""
    rows = routed_rows(docs.withColumn("source", F.lit("")) if "source" not in docs.columns else docs, 0, 0, 100)
    return docs.sparkSession.createDataFrame(rows.flatMap(lambda r: [(r[0],)] * r[3] if r[2] & COPY else []), "doc_id long")


def failures(text: bytes, n_chars: int, least_words: int, distinct_percent: int, capital_percent: int) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()  # at space and U+0009 to U+000D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (len(words) < least_words, 100 * len(set(words)) < distinct_percent * len(words), 100 * capitals > capital_percent * n_chars, len(text) > len(text.translate(None, MARKS)))
    return sum(x << k for k, x in enumerate(fails))


def routed_rows(docs: DataFrame, *limits: int) -> RDD:
    """(doc_id, part, mask, n) of all rows: n rows of one id and source, E included."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    size = docs.select(F.sum(F.octet_length(docs.columns[1]))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // PART_BYTES)
    return docs.rdd.mapPartitions(lambda rows: _folded(rows, limits)).partitionBy(tasks, lambda key: key).mapPartitions(_chained)


class Chains:
    """Texts by hash, told apart by comparing them whole; for each its mask, least id, and that id's rows by part."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, text: bytes, mask, doc_id: int, parts: Counter) -> Iterator[tuple]:
        """Takes in rows of one id; yields the rows that this shows to be copies. ``mask`` is a number or a function of the text."""
        chain = self.chains.setdefault(key, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            self.size += len(text) + 200
            chain.append([text, mask if isinstance(mask, int) else mask(text), doc_id, parts])
        elif doc_id == link[2]:
            link[3].update(parts)
        else:
            if doc_id < link[2]:
                doc_id, parts, link[2:] = link[2], link[3], [doc_id, parts]
            yield from ((doc_id, part, link[1] | COPY, n) for part, n in parts.items())


def _folded(rows: Iterable, limits: tuple[int, ...]) -> Iterator[tuple[int, tuple]]:
    """(hash, (text, mask, id, parts)) once a text, and (spread, row) of what is settled in this task."""
    seen, without_id = Chains(), Counter()

    def sent() -> Iterator[tuple[int, tuple]]:
        for key, chain in seen.chains.items():
            yield from ((key, (text, mask, doc_id, dict(parts))) for text, mask, doc_id, parts in chain)

    for doc_id, text, part in rows:
        raw, n_chars = text.encode(), len(text)
        if doc_id is None:
            without_id[part, failures(raw, n_chars, *limits)] += 1
            continue
        mask = lambda raw, n=n_chars: failures(raw, n, *limits)
        for row in seen.add(xxhash.xxh64_intdigest(raw), raw, mask, doc_id, Counter({part: 1})):
            yield xxhash.xxh64_intdigest(str(row[0])), row
        if seen.size > FOLD_BYTES:
            yield from sent()
            seen = Chains()
    yield from sent()
    yield from ((xxhash.xxh64_intdigest(part), (None, part, mask, n)) for (part, mask), n in without_id.items())


def _chained(pairs: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    seen = Chains()
    for key, row in pairs:
        if isinstance(row[0], bytes):
            text, mask, doc_id, parts = row
            yield from seen.add(key, text, mask, doc_id, Counter(parts))
        else:
            yield row
    for chain in seen.chains.values():
        yield from ((doc_id, part, mask, n) for _, mask, doc_id, parts in chain for part, n in parts.items())


def _add(vector: np.ndarray, row: tuple) -> np.ndarray:
    """Rows of all, good and toxic documents by mask."""
    mask, n, good, bad = row
    vector[:, mask] += [n, n * good, n * bad]
    return vector


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """A row for each step of each order of the filters."""
    masks = np.arange(32)
    total = lambda which, k=0: int(counts[k][which].sum())
    steps, shapley = [], Counter()
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            fails, reached = masks >> f & 1 == 1, masks & before == 0
            gone = fails & reached
            before |= 1 << f
            shapley[f] += total(gone)
            steps.append((order, step + 1, f, total(masks & before == 0), total(gone), total(fails & ~reached), total(masks == 1 << f), total(gone, 1), total(gone, 2)))
    for order, step, f, *found in steps:
        yield (part, "".join(FILTERS[x] for x in order), step, *found, shapley[f])
