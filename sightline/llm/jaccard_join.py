"""Exact Jaccard join on word n-gram sets with token-combination prefixes.

Texts are sets of shingle hashes. Two sets can reach the threshold only if each misses a few
shingles of the other, so a prefix of each set, in one common order, must share something:
single shingles for the rare classes, combinations of k shingles for the frequent classes.
Documents that share a signature are candidates, and candidates are verified on their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .store import materialize, row_key
from .textkit import U, mix, shingles, slices, words

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingle counts are kept by hash slot; they only set the order and the classes of shingles.
SLOT_BITS = 20
#: Shingles in slots with more than this above the mean are frequent, and very frequent.
FREQUENT, VERY_FREQUENT = 32, 1024
#: Members of a signature up to which all its pairs are verified at once.
SMALL = 4
#: Rows of a signature that one star is made of; those that may be larger are dealt by hash first.
SPLIT = 50_000
#: Rows, and shingles, of a crowded signature that one task compares; larger ones are dealt as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_hi, class_lo, component, row_a, row_b of every document of (doc_id, text).

    Documents with equal words form one class (class_hi, class_lo: a 128-bit digest); ``component`` tells
    components apart even if ids repeat (null: no words), and row_a, row_b are store.row_key. Classes
    are linked at the threshold, exactly: a signature held by few classes yields all their pairs;
    one held by many first yields a star around its most central class. Later its members that the
    links so far leave in different components are compared in blocks within a task, which
    gives out no more links than it takes to join them.

    Null, empty and all-space texts have no shingles, link with nothing and are their own
    component; a text of fewer than ``width`` words is one shingle; equal rows are one class;
    component_id is null only if no doc_id of the component is known; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    classes = materialize(docs.mapInArrow(lambda it: _classes(it, width), "doc_id long, row_a long, row_b long, hi long, lo long, n long"))
    counts = sketch.dense(docs.select("text"), 1 << SLOT_BITS, np.int64, lambda batch, into: _count(batch, into, width))
    slots = docs.sparkSession.sparkContext.broadcast((np.minimum(counts, 1 << 30).astype(np.int32), _slot_classes(counts)))

    signatures = docs.select("text").mapInArrow(lambda it: _signatures(it, width, percent, *slots.value), "sig long, part int, rank long, hi long, lo long")
    ordered = signatures.repartition("sig", "part").sortWithinPartitions("sig", "part", "rank", "hi", "lo")
    candidates = materialize(ordered.mapInArrow(lambda it: _star(it, percent, small), "sig long, a_hi long, a_lo long, hi long, lo long"))
    pairs = materialize(candidates.filter("a_hi is not null").select(_node("a_", "a"), _node("", "b")).distinct())
    crowded = candidates.filter("a_hi is null").select("sig", _node("", "node"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    texts = _texts(docs, wanted, width)
    links = materialize(_verified(texts, pairs, width, percent))
    labels = components(links)
    more = materialize(_across(crowded, labels, texts, width, percent, block))
    return _result(classes, labels if more.isEmpty() else components(links.union(more)))


def _node(prefix: str, name: str):
    return F.struct(F.col(prefix + "hi").alias("hi"), F.col(prefix + "lo").alias("lo")).alias(name)


def _result(classes: DataFrame, labels: DataFrame) -> DataFrame:
    least = classes.groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).select(_node("", "node"), "least")
    least = least.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    ids = least.filter("component is not null").groupBy(F.col("component").alias("_root")).agg(F.min("least").alias("lowest"))
    least = least.join(ids, F.col("component") == F.col("_root"), "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("lowest", "least").alias("component_id"))
    keyed = classes.withColumn("_node", _node("", "x"))
    out = keyed.join(least, F.col("_node") == F.col("node"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("n") > 0, F.col("component")).alias("component")
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.col("hi").alias("class_hi"), F.col("lo").alias("class_lo"), component, "row_a", "row_b")


def _documents(batches: Iterator[pa.RecordBatch]):
    """For each slice: its batch, the slice and the word hashes of each row."""
    for batch in batches:
        for part in slices(batch.column("text")):
            w = words(part, lower=True)
            yield batch, part, [w.hash[a:b] for a, b in zip(w.of_row[:-1], w.of_row[1:], strict=True)]


def _digest(row: np.ndarray) -> tuple[int, int]:
    found = np.frombuffer(hashlib.blake2b(row.tobytes(), digest_size=16).digest(), np.int64)
    return int(found[0]), int(found[1])


def _classes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, part, rows in _documents(batches):
        digests = np.array([_digest(row) for row in rows], np.int64)
        sizes = np.array([len(shingles(row, width)) for row in rows], np.int64)
        own = [batch.column(c).slice(part.first, part.last - part.first) for c in ("doc_id", "row_a", "row_b")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes)], ["doc_id", "row_a", "row_b", "hi", "lo", "n"])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - SLOT_BITS)).astype(np.int64)


def _count(batch: pa.RecordBatch, into: np.ndarray, width: int) -> None:
    for _, _, rows in _documents([batch]):
        for_all = np.concatenate([shingles(row, width) for row in rows])
        into += np.bincount(_slot(for_all), minlength=len(into))


def _slot_classes(counts: np.ndarray) -> np.ndarray:
    """1 (rare), 2 (frequent) or 3 (very frequent) for each slot."""
    usual = counts.mean() + 6 * counts.mean() ** 0.5
    return (1 + (counts > usual + FREQUENT) + (counts > usual + VERY_FREQUENT)).astype(np.uint8)


def prefix_signatures(found: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """Signatures of a set of distinct hashes (sorted); sets that reach the threshold share one.

    A set of n may miss at most n * (100 - percent) // 100 of its shingles. Order them by class,
    then hash. A group of shingles of class k that has m in the prefix proves m - k + 1 misses
    if it shares no k of them, so the prefix grows until those proofs exceed the allowed misses.
    Rare shingles are groups of their own with k = 1. Frequent ones fall by hash into groups
    whose number depends on the set's size class, a power of two; sets near the end of a size class emit
    for the next one too, so sizes that can match meet in one of them. Sets under 32 use k = 1.
    """
    return _loaded_signatures(found, percent, classes, np.zeros(1 << SLOT_BITS, np.int32))[0]


def _loaded_signatures(found: np.ndarray, percent: int, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and for each the least of its shingles' slot counts: no more documents than that hold it."""
    n = len(found)
    need = n * (100 - percent) // 100 + 1
    kind, load = classes[_slot(found)], counts[_slot(found)]
    if np.count_nonzero(kind == 1) >= need:
        return found[kind == 1][:need], load[kind == 1][:need]
    order = np.argsort(kind, kind="stable")
    found, kind, load = found[order], kind[order], load[order]
    out = []
    for level in sorted({n.bit_length(), (n * 100 // percent).bit_length()}):
        if level < 6:
            out.append((found[:need], load[:need]))
            continue
        pairs, triples = 1 << (level - 4), 1 << (level - 5)
        group = np.where(kind == 1, np.arange(n), np.where(kind == 2, n + (found % U(pairs)).astype(np.int64), n + pairs + (found % U(triples)).astype(np.int64)))
        by_group = np.argsort(group, kind="stable")
        begins = np.concatenate([[True], group[by_group][1:] != group[by_group][:-1]])
        place = np.empty(n, np.int64)
        place[by_group] = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        proofs = np.cumsum(place >= kind - 1)
        stop = int(np.searchsorted(proofs, need)) + 1
        out.append((found[:stop][kind[:stop] == 1], load[:stop][kind[:stop] == 1]))
        for k in (2, 3):
            mine = by_group[(by_group < stop) & (kind[by_group] == k)]
            out.append(_combinations(found[mine], group[mine], load[mine], k, level))
    found, first = np.unique(np.concatenate([x for x, _ in out]), return_index=True)
    return found, np.concatenate([x for _, x in out])[first]


def _combinations(found: np.ndarray, group: np.ndarray, load: np.ndarray, k: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each k members of a group, and their least load; members of a group are adjacent, in hash order."""
    out, loads = [found[:0]], [load[:0]]
    salt = U(1000 * level + k)
    for i in range(1, len(found)):
        same = group[i:] == group[:-i]
        if not same.any():
            break
        first = mix(found[:-i] * U(3) + salt)
        least = np.minimum(load[:-i], load[i:])
        if k == 2:
            out.append(mix(first + found[i:])[same])
            loads.append(least[same])
            continue
        for j in range(i + 1, len(found)):
            both = same[: len(found) - j] & (group[j:] == group[:-j])
            if not both.any():
                break
            out.append(mix(mix(first[: len(both)] + found[i : i + len(both)]) + found[j:])[both])
            loads.append(np.minimum(least[: len(both)], load[j:])[both])
    return np.concatenate(out), np.concatenate(loads)


def _signatures(batches: Iterator[pa.RecordBatch], width: int, percent: int, counts: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures of each class; ``rank`` holds the size in its low half, and sorts central classes first.

    A class is central if its shingles are frequent on average: the text that many others vary.
    ``part`` is -1, or for signatures that more than ``SPLIT`` classes may hold, a hash of the class.
    """
    usual = counts.mean()
    for _, _, rows in _documents(batches):
        seen, got = {}, []
        for row in rows:
            if len(row) and (key := _digest(row)) not in seen:
                found = shingles(row, width)
                weight = min(int(16 * counts[_slot(found)].mean()), 0x7FFFFFFF)
                seen[key] = (0x7FFFFFFF - weight) << 32 | len(found)
                got.append(_loaded_signatures(found, percent, classes, counts))
        if got:
            lengths = [len(g) for g, _ in got]
            node = [np.repeat(np.array(x, np.int64), lengths) for x in (list(seen.values()), [k[0] for k in seen], [k[1] for k in seen])]
            parts = np.maximum(0, np.concatenate([x for _, x in got]) - usual).astype(np.int64) // SPLIT
            part = np.where(parts > 0, (node[1] & 0x7FFFFFFF) % (parts + 1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g for g, _ in got]).view(np.int64)), pa.array(part), *map(pa.array, node)], ["sig", "part", "rank", "hi", "lo"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a table sorted by its first two columns, as whole groups: batches of (rows, group starts)."""
    rest: list[np.ndarray] = []
    for batch in batches:
        table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if not len(table):
            continue
        changes = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(1)) + 1
        if rest and (table[0, :2] != rest[-1][-1, :2]).any():
            changes = np.append(0, changes)
        if len(changes):
            whole = np.concatenate([*rest, table[: changes[-1]]])
            rest = []
            if len(whole):
                yield whole, np.flatnonzero(np.concatenate([[True], (whole[1:, :2] != whole[:-1, :2]).any(1)]))
        rest.append(table[changes[-1] :] if len(changes) else table)
    if rest:
        yield np.concatenate(rest), np.zeros(1, np.int64)


def _star(batches: Iterator[pa.RecordBatch], percent: int, small: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each signature; the rows of crowded and of dealt signatures again, without a partner."""
    names = ["sig", "a_hi", "a_lo", "hi", "lo"]
    for table, begins in _groups(batches):
        fresh = np.ones(len(table), bool)
        fresh[1:] = (table[1:] != table[:-1]).any(1)
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(table))))[fresh]
        table = table[fresh]
        sizes = np.bincount(group, minlength=len(begins))
        starts = np.cumsum(sizes) - sizes
        n = table[:, 2] & 0xFFFFFFFF
        large = (sizes > small) | (table[starts, 1] >= 0)
        few = ~large[group]
        places = []
        for gap in range(1, small):
            near = np.flatnonzero((group[gap:] == group[:-gap]) & few[gap:])
            places.append((near, near + gap))
        crowded = np.flatnonzero(~few)
        for k in np.flatnonzero(large):
            left = np.arange(starts[k], starts[k] + sizes[k])
            while len(left) > 1:  # a star for those whose sizes fit the most central one, then for the rest
                lead, left = left[0], left[1:]
                fits = 100 * np.minimum(n[left], n[lead]) >= percent * np.maximum(n[left], n[lead])
                places.append((np.full(int(fits.sum()), lead), left[fits]))
                left = left[~fits]
        a, b = (np.concatenate([p[k] for p in places]) if places else crowded[:0] for k in (0, 1))
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        both = np.concatenate([table[a[fits], 3:], table[b[fits], 3:]], 1)
        swap = (both[:, 0] > both[:, 2]) | ((both[:, 0] == both[:, 2]) & (both[:, 1] > both[:, 3]))
        both[swap] = both[swap][:, [2, 3, 0, 1]]
        both = np.unique(both, axis=0)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), *(pa.array(both[:, k]) for k in range(4))], names)
        if len(crowded):
            none = pa.nulls(len(crowded), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(table[crowded, 0]), none, none, pa.array(table[crowded, 3]), pa.array(table[crowded, 4])], names)


def _across(crowded: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components within crowded signatures: enough to join all that are linked.

    Only signatures that still hold several components are read, and of those with equal members
    only one. Rows of a signature's largest component need no comparison with each other: they meet the
    other rows, and those each other, as pairs of blocks of bounded size. A task compares marks, and
    names the rows that a pair of different components may link; those meet again with their
    texts, and that task gives out a spanning forest of the links. No list of pairs leaves a task.
    """
    labels = labels.withColumnRenamed("node", "_node")
    rows = crowded.join(labels, crowded["node"] == labels["_node"], "left")
    rows = rows.select("sig", "node", F.xxhash64(F.coalesce("component", "node")).alias("label")).join(texts.select("node", "n"), "node")
    rows = materialize(rows.select("sig", "node", "label", "n"))
    members = [F.sum(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 40))).alias(f"members_{k}") for k in (0, 1)]
    by_label = rows.groupBy("sig", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), *members)
    most = F.max(F.struct("rows", "shingles", "label")).alias("most")
    mixed = by_label.groupBy("sig").agg(most, F.count("*").alias("labels"), *(F.sum(c).alias(c) for c in ("rows", "shingles", "members_0", "members_1"))).filter("labels > 1")
    mixed = mixed.groupBy("rows", "members_0", "members_1").agg(F.min(F.struct("sig", "most", "shingles")).alias("one"))
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    most = F.col("one.most")
    mixed = materialize(mixed.select("one.sig", most["label"].alias("common"), blocks(most["rows"], most["shingles"]).alias("much"), blocks(F.col("rows") - most["rows"], F.col("one.shingles") - most["shingles"]).alias("rest")))

    rows = rows.select("sig", "node", "label").join(mixed, "sig").join(texts.select("node", "n", "marks"), "node")
    common = F.col("label") == F.col("common")
    own = F.pmod(F.xxhash64("node"), F.when(common, F.col("much")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumns({"is_common": common, "own": own})
    # common rows meet each block of the rest; rows of the rest meet each common block (-1 - block) and each block of the rest
    others = F.when(F.col("is_common"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(-F.col("much"), F.col("rest") - 1))
    rows = rows.withColumn("other", F.explode(others))
    own = F.when(F.col("is_common"), -1 - F.col("own")).otherwise(F.col("own"))
    rows = rows.select("sig", F.least(own, "other").alias("x"), F.greatest(own, "other").alias("y"), own.alias("own"), "label", "node.hi", "node.lo", "n", "marks")
    rows = rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    maybe = rows.mapInArrow(lambda it: _by_key(it, ("sig", "x", "y"), lambda g: _maybe_linked(g, percent)), MEMBER).distinct()
    maybe = maybe.select("group", "label", _node("", "node")).join(texts.select("node", "text"), "node")
    maybe = maybe.select("group", "label", "node.hi", "node.lo", "text").repartition("group").sortWithinPartitions("group")
    found = maybe.mapInArrow(lambda it: _by_key(it, ("group",), lambda g: _forest(g, width, percent)), "a_hi long, a_lo long, b_hi long, b_lo long")
    return found.select(_node("a_", "a"), _node("b_", "b")).distinct()


MEMBER = "group long, label long, hi long, lo long"


def _by_key(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], of: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``of`` each group of a table that is sorted by ``key``."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if rest and any(table.column(c)[0] != rest[-1].column(c)[-1] for c in key):
            yield from of(pa.concat_tables(rest).combine_chunks()).to_batches()
            rest = []
        keys = np.stack([table.column(c).to_numpy() for c in key], 1)
        begins = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield from of(pa.concat_tables([*rest, table.slice(a, b - a)]).combine_chunks()).to_batches()
            rest = []
        rest.append(table.slice(begins[-1]))
    if rest:
        yield from of(pa.concat_tables(rest).combine_chunks()).to_batches()


def _maybe_linked(table: pa.Table, percent: int) -> pa.Table:
    """The rows that have a partner of another label, in their block or the other, that the marks allow."""
    labels, own, n, hi, lo = (table.column(c).to_numpy() for c in ("label", "own", "n", "hi", "lo"))
    bitmaps = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("marks")]
    width = np.array([len(x) for x in bitmaps])
    levels = {w: (at := np.flatnonzero(width == w), np.stack([bitmaps[k] for k in at])) for w in np.unique(width).tolist()}
    apart = own.min() != own.max()
    values, counts = np.unique(labels, return_counts=True)
    hit = np.zeros(len(labels), bool)
    for i in np.flatnonzero(labels != values[np.argmax(counts)]):
        fits = (labels != labels[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if apart:
            fits &= own != own[i]
        for w, (at, theirs) in levels.items():
            mine, theirs, at = bitmaps[i], theirs[fits[at]], at[fits[at]]
            if len(at):
                common = min(w, len(mine))
                mine, theirs = mine.reshape(-1, common), theirs.reshape(len(at), -1, common)
                mine, theirs = np.bitwise_or.reduce(mine, 0), np.bitwise_or.reduce(theirs, 1)
                most = np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[at] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
                near = at[100 * most >= percent * (n[i] + n[at] - most)]
                hit[near] = True
                hit[i] |= len(near) > 0
    at = np.flatnonzero(hit)
    at = at[np.lexsort([labels[at], lo[at], hi[at]])]
    # equal rows of several signatures get one key and so are compared once
    key = int(np.frombuffer(hashlib.blake2b(np.stack([hi[at], lo[at], labels[at]]).tobytes(), digest_size=8).digest(), np.int64)[0])
    return pa.table([pa.array(np.full(len(at), key)), *(pa.array(x[at]) for x in (labels, hi, lo))], names=["group", "label", "hi", "lo"])


def _forest(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between rows of different labels: one for each two labels that they join."""
    labels, hi, lo = (table.column(c).to_numpy().copy() for c in ("label", "hi", "lo"))
    sets = list(_sets(table.column("text").combine_chunks(), width))
    n = np.array([len(x) for x in sets])
    values, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    place = np.cumsum(times > 1) - 1  # a shingle of one row is in no intersection
    shared = times[of] > 1
    bits = np.zeros((len(n), (int((times > 1).sum()) + 7) // 8), np.uint8)
    np.bitwise_or.at(bits, (row[shared], place[of[shared]] >> 3), np.left_shift(np.uint8(1), (place[of[shared]] & 7).astype(np.uint8)))
    out = []
    for i in range(len(n)):
        at = np.flatnonzero((labels != labels[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        common = np.bitwise_count(bits[at] & bits[i]).sum(1, dtype=np.int64)
        for j in at[100 * common >= percent * (n[i] + n[at] - common)]:
            if labels[j] != labels[i]:
                a, b = sorted([(hi[i], lo[i]), (hi[j], lo[j])])
                out.append((*a, *b))
                labels[labels == labels[j]] = labels[i]
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=ENDS)


def mark_bits(n: int) -> int:
    """Bits of the marks of a set of n, a power of two: 16 for each member up to 4,096, then two at least."""
    return max(64, min(4096, 1 << (16 * n - 1).bit_length()), 1 << (2 * n - 1).bit_length())


def marks(found: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of a set: member h sets bit h mod ``bits``. Folding its halves together halves ``bits``.

    Each bit that one set has and another lacks proves a member that the other lacks, so bitmaps
    bound the intersection from above.
    """
    flags = np.zeros(bits, np.uint8)
    flags[(found & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def _may_link(n_a: int, marks_a: np.ndarray, n_b: int, marks_b: np.ndarray, percent: int) -> bool:
    while len(marks_a) > len(marks_b):
        marks_a = np.bitwise_or(*np.split(marks_a, 2))
    while len(marks_b) > len(marks_a):
        marks_b = np.bitwise_or(*np.split(marks_b, 2))
    most = min(n_a - int(np.bitwise_count(marks_a & ~marks_b).sum()), n_b - int(np.bitwise_count(marks_b & ~marks_a).sum()))
    return 100 * most >= percent * (n_a + n_b - most)


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, marks, text of each wanted class; a task sends a class once, however many copies it reads."""
    keyed = docs.select("text").mapInArrow(_keyed, "hi long, lo long, text string").select(_node("", "node"), "text")
    texts = keyed.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    marked = texts.select("node.*", "text").mapInArrow(lambda it: _marked(it, width), "hi long, lo long, n long, marks binary, text string")
    return materialize(marked.select(_node("", "node"), "n", "marks", "text"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch, part, rows in _documents(batches):
        keys = {i: key for i, row in enumerate(rows) if (key := _digest(row)) not in seen and not seen.add(key)}
        if keys:
            text = batch.column("text").take(pa.array([part.first + i for i in keys]))
            yield pa.RecordBatch.from_arrays([*(pa.array([k[x] for k in keys.values()], pa.int64()) for x in (0, 1)), text], ["hi", "lo", "text"])


def _marked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(batch.column("text"), width))
        bitmaps = [marks(x, mark_bits(len(x))).tobytes() for x in sets]
        n = pa.array([len(x) for x in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), n, pa.array(bitmaps, pa.binary()), batch.column("text")], ["hi", "lo", "n", "marks", "text"])


def _verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold: by marks first, then by texts."""
    ends = [F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "ab" for y in ("hi", "lo")]
    names = "a_hi long, a_lo long, b_hi long, b_lo long"

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(texts.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns)), x)
        return pairs.select(*ends, *(f"{x}_{c}" for x in "ab" for c in columns))

    maybe = beside(pairs, "n", "marks").mapInArrow(lambda it: _check_marks(it, percent), names)
    pairs = materialize(maybe.select(_node("a_", "a"), _node("b_", "b")))
    kept = beside(pairs, "text").mapInArrow(lambda it: _check_sets(it, width, percent), names)
    return kept.select(_node("a_", "a"), _node("b_", "b"))


ENDS = ["a_hi", "a_lo", "b_hi", "b_lo"]


def _check_marks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = (batch.column(c).to_pylist() for c in ("a_n", "b_n"))
        of_a, of_b = ([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("a_marks", "b_marks"))
        keep = [_may_link(*row, percent) for row in zip(n_a, of_a, n_b, of_b, strict=True)]
        yield batch.select(ENDS).filter(pa.array(keep, pa.bool_()))


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for part in slices(column):
        w = words(part, lower=True)
        yield from (shingles(w.hash[a:b], width) for a, b in zip(w.of_row[:-1], w.of_row[1:], strict=True))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _check_sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_alike(x, y, percent) for x, y in zip(_sets(batch.column("a_text"), width), _sets(batch.column("b_text"), width), strict=True)]
        yield batch.select(ENDS).filter(pa.array(keep, pa.bool_()))
