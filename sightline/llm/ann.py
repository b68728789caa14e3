"""Approximate nearest neighbours: an NN-descent graph by iterated Spark joins, searched greedily.

Distinct vectors are nodes; equal ones share a node. A few random-projection trees, fitted on a
bounded sample, give each node a poor first list of neighbours. In each round the neighbours of a node, and
some of the nodes that have it as theirs, meet there and are compared if one of them is new to the
list; each keeps the best it has met. Rounds end when few lists change. A query starts from its node's
neighbours and, round by round, expands the nearest nodes of its list that it has not expanded.

Vectors travel as codes: the leaf of the first tree and the distance from its centre in 8 bits a part, so
that the error follows the spread of the leaf, and near copies stay apart. Final scores are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize, shared_dir

#: Neighbours of a node in the graph, and how many of the nodes that have it as a neighbour it meets.
NEIGHBOURS, REVERSE = 40, 40
#: Trees for the first neighbours, nodes compared at once, and vectors that the trees are fitted on.
TREES, LEAF, TREE_SAMPLE = 4, 128, 20_000
#: Of each leaf or meeting, the best partners that a node hears of.
FROM_LEAF, FROM_MEETING = 24, 16
#: Rounds of descent end after so many, or when less than this share of the lists is new.
ROUNDS, FRESH_SHARE = 5, 0.05
#: Nodes that a query expands in a round, rounds, and nodes on its list; of these, so many for each result are scored exactly.
EXPAND, SEARCH_ROUNDS, LISTED, SCORED = 32, 5, 160, 3

PAIR = "node long, other long, near float, fresh boolean"


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, vector: without null and zero vectors and those with null or non-finite parts; of an id's vectors the least."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def dot(x: str, y: str) -> Column:
    """Inner product in double precision; a shorter vector counts as if zeros followed."""
    product = F.zip_with(x, y, lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda a, v: a + v)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; zeros follow shorter vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Coder:
    """Trees and leaf centres, fitted on a sample of vectors; turns vectors into codes and back. A few MB at most."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, top: float):
        self.width, self.top = sample.shape[1], top
        sample, rng = self.widened(sample), np.random.default_rng(7)
        depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 16)))))  # beyond, a leaf is cut along its line
        self.trees = [self._tree(sample, depth, rng) for _ in range(trees)]
        self.lines = rng.standard_normal((trees, self.width + 1))
        leaves = self.leaf_of(sample, 0)
        self.centres = np.zeros((1 << depth, self.width + 1))
        np.add.at(self.centres, leaves, sample)
        self.centres /= np.maximum(np.bincount(leaves, minlength=1 << depth), 1)[:, None]
        self.kind = np.dtype([("square", "<f8"), ("scale", "<f4"), ("leaf", "<i4"), ("part", "i1", (self.width + 1,))])

    @staticmethod
    def _tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the direction and the median of each part of the sample."""
        levels, parts = [], [np.arange(len(sample))]
        for _ in range(depth):
            directions, middles, following = [], [], []
            for part in parts:
                a, b = sample[rng.choice(part if len(part) else len(sample), 2)]
                direction = a - b if (a != b).any() else rng.standard_normal(sample.shape[1])
                value = sample[part] @ direction
                middle = float(np.median(value)) if len(part) else 0.0
                directions.append(direction)
                middles.append(middle)
                following += [part[value <= middle], part[value > middle]]
            levels.append((np.stack(directions), np.array(middles)))
            parts = following
        return levels

    def widened(self, x: np.ndarray) -> np.ndarray:
        """One more part makes all vectors equally long, so that the nearest have the largest inner products."""
        rest = np.sqrt(np.maximum(0, self.top**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], 1)

    def leaf_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for directions, middles in self.trees[tree]:
            at = 2 * at + (np.einsum("ij,ij->i", x, directions[at]) > middles[at])
        return at

    def encode(self, column: pa.Array) -> pa.Array:
        x = _matrix(column, self.width)
        out = np.zeros(len(x), self.kind)
        out["square"] = np.einsum("ij,ij->i", x, x)
        x = self.widened(x)
        out["leaf"] = self.leaf_of(x, 0)
        x -= self.centres[out["leaf"]]
        out["scale"] = np.maximum(np.abs(x).max(1) / 127, 1e-30)
        out["part"] = np.clip(np.rint(x / out["scale"][:, None]), -127, 127)
        return pa.array([row.tobytes() for row in out], pa.binary())

    def rows(self, codes: pa.Array | bytes) -> np.ndarray:
        if isinstance(codes, bytes):
            return np.frombuffer(codes, self.kind)
        _, where, data = codes.buffers()
        where = np.frombuffer(where, np.int32)[codes.offset : codes.offset + len(codes) + 1]
        return np.frombuffer(data, np.uint8)[where[0] : where[-1]].view(self.kind)

    def decode(self, rows: np.ndarray) -> np.ndarray:
        return self.centres[rows["leaf"]] + rows["part"] * rows["scale"][:, None].astype(np.float64)


def nodes_of(rows: DataFrame, trees: int, leaf: int) -> tuple[DataFrame, DataFrame, object]:
    """(node, code) of the distinct vectors, (vec_id, node), and the broadcast coder. A node's id is its least vec_id."""
    digest = F.sha2(F.array_join(F.transform("vector", lambda v: (v.cast("double") + 0.0).cast("string")), ","), 256)
    keyed = rows.withColumn("key", digest)
    least = materialize(keyed.groupBy("key").agg(F.min("vec_id").alias("node"), F.first("vector").alias("vector")))
    members = materialize(keyed.select("vec_id", "key").join(least.select("key", "node"), "key").select("vec_id", "node"))
    size = least.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(dot("vector", "vector")).alias("square")).first()
    share = F.lit(min(1.0, TREE_SAMPLE / max(1, size.n)))
    sample = least.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30) < share).orderBy("node").limit(TREE_SAMPLE).select("vector").collect()
    table = np.zeros((max(1, len(sample)), size.width))
    for k, row in enumerate(sample):
        table[k, : len(row.vector)] = row.vector
    coder = rows.sparkSession.sparkContext.broadcast(Coder(table, size.n, trees, leaf, size.square**0.5))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("node"), coder.value.encode(batch.column("vector"))], ["node", "code"])

    return materialize(least.select("node", "vector").mapInArrow(encode, "node long, code binary")), members, coder


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str], limit: int = 1 << 60) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted table, cut into parts of at most ``limit`` rows."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if rest and any(table.column(c)[0] != rest[-1].column(c)[-1] for c in keys):
            yield pa.concat_tables(rest).combine_chunks()
            rest = []
        values = np.stack([table.column(c).to_numpy() for c in keys], 1)
        begins = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, [len(table)]])
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            while a < b:
                held = sum(map(len, rest))
                step = min(b - a, limit - held)
                rest.append(table.slice(a, step))
                a += step
                if held + step == limit or (a == b and b < len(table)):
                    yield pa.concat_tables(rest).combine_chunks()
                    rest = []
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def _best(ids: np.ndarray, x: np.ndarray, keep: int, floor: np.ndarray | None = None, fresh: np.ndarray | None = None) -> pa.Table:
    """For each row the ``keep`` nearest others: those nearer than its floor, and new to it or new themselves, if given."""
    near = np.full((len(ids), len(ids)), -np.inf)
    keep = min(keep, len(ids) - 1)
    if keep > 0:
        square = np.einsum("ij,ij->i", x, x)
        near = np.minimum(0, 2 * (x @ x.T) - square[:, None] - square)
        np.fill_diagonal(near, -np.inf)
        if fresh is not None:
            near[~(fresh[:, None] | fresh)] = -np.inf
        if floor is not None:
            near[near <= floor[:, None]] = -np.inf
    best = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep > 0 else np.zeros((len(ids), 0), np.int64)
    value = np.take_along_axis(near, best, 1)
    fits = value > -np.inf
    n = fits.sum(1)
    return pa.table([pa.array(np.repeat(ids, n)), pa.array(ids[best][fits]), pa.array(value[fits].astype(np.float32)), pa.array(np.ones(n.sum(), bool))], names=["node", "other", "near", "fresh"])


def first_neighbours(nodes: DataFrame, coder, trees: int, leaf: int, keep: int) -> DataFrame:
    """(node, other, near, fresh): of each leaf that a node falls in, its nearest ``keep`` nodes.

    Leaves are ordered along a line and cut into parts of ``leaf`` nodes, so that none has to fit one task.
    """

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = coder.value.decode(coder.value.rows(batch.column("code")))
                for k in range(trees):
                    columns = [pa.array(np.full(len(x), k, np.int32)), pa.array(coder.value.leaf_of(x, k)), pa.array(x @ coder.value.lines[k]), *batch.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "place", "node", "code"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["tree", "leaf"], leaf):
            x = coder.value.decode(coder.value.rows(part.column("code").combine_chunks()))
            yield from _best(part.column("node").to_numpy(), x, keep).to_batches()

    routed = nodes.select("node", "code").mapInArrow(route, "tree int, leaf long, place double, node long, code binary")
    ordered = routed.repartitionByRange("tree", "leaf", "place").sortWithinPartitions("tree", "leaf", "place", "node")
    return ordered.mapInArrow(compare, PAIR)


def keep_nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(node, other, near, fresh, floor): the k nearest distinct others of each node; floor: the k-th nearness, or none."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some_runs(batches):
            node, other, near, fresh = (table.column(c).to_numpy() for c in ("node", "other", "near", "fresh"))
            order = np.lexsort([fresh, other, node])  # what was known before stays known
            first = np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (other[order][1:] != other[order][:-1])])
            order = order[first]
            order = order[np.lexsort([other[order], -near[order], node[order]])]
            node, other, near, fresh = node[order], other[order], near[order], fresh[order]
            begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(begins, len(node)))
            place = np.arange(len(node)) - np.repeat(begins, sizes)
            floor = np.repeat(np.where(sizes >= k, near[begins + np.minimum(sizes, k) - 1], -np.inf), sizes).astype(np.float32)
            kept = place < k
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (node, other, near, fresh, floor)], ["node", "other", "near", "fresh", "floor"])

    return pairs.repartition("node").sortWithinPartitions("node").mapInArrow(task, f"{PAIR}, floor float")


def _some_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal nodes, many at a time."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        node = table.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        if last or (rest and rest[-1].column("node")[-1].as_py() != node[0]):
            yield pa.concat_tables([*rest, table.slice(0, last)]).combine_chunks()
            rest = []
        rest.append(table.slice(last))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def known_by(graph: DataFrame, most: int, salt: int) -> DataFrame:
    """(host, node, fresh): for each node, at most ``most`` of those that have it as a neighbour, by hash; cut before any shuffle."""
    back = graph.select(F.col("other").alias("host"), "node", "fresh")
    turn = Window.partitionBy("host").orderBy(F.xxhash64("node", "host", F.lit(salt)), "node")
    return back.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= most).drop("_turn")


def descend(graph: DataFrame, nodes: DataFrame, coder, k: int, reverse: int, hear: int, salt: int) -> DataFrame:
    """One round: at each node it, its neighbours and some that have it meet; all keep the best."""
    known = nodes.join(graph.groupBy("node").agg(F.first("floor").alias("floor")), "node")
    guests = graph.select(F.col("node").alias("host"), F.col("other").alias("node"), "fresh").unionByName(known_by(graph, reverse, salt))
    guests = guests.unionByName(nodes.select(F.col("node").alias("host"), "node", F.lit(True).alias("fresh")))
    seated = guests.join(known, "node").select("host", "node", "fresh", "floor", "code")
    seated = seated.repartition("host").sortWithinPartitions("host", "node", F.desc("fresh"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for table in _runs(batches, ["host"]):
            ids = table.column("node").to_numpy()
            rows = np.unique(ids, return_index=True)[1]
            x = coder.value.decode(coder.value.rows(table.column("code").combine_chunks())[rows])
            out.append(_best(ids[rows], x, hear, table.column("floor").to_numpy()[rows], table.column("fresh").to_numpy()[rows]))
            if len(out) == 64:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    met = seated.mapInArrow(meet, PAIR)
    before = graph.select("node", "other", "near", F.lit(False).alias("fresh"))
    return keep_nearest(before.union(met), k)


def build_graph(nodes: DataFrame, coder, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(node, other, near, fresh, floor): up to k near neighbours of every node, written after each round."""
    graph = materialize(keep_nearest(first_neighbours(nodes, coder, trees, leaf, FROM_LEAF), k))
    for salt in range(rounds):
        graph = materialize(descend(graph, nodes, coder, k, reverse, FROM_MEETING, salt))
        share = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if (share or 0) < FRESH_SHARE:
            break
    return graph


STATE = "node long, code binary, ids binary, near binary, done binary, turn array<long>"


def search(graph: DataFrame, nodes: DataFrame, coder, starts: DataFrame, reverse: int = REVERSE, expand: int = EXPAND, rounds: int = SEARCH_ROUNDS, listed: int = LISTED) -> DataFrame:
    """(node, other, near): for each of ``starts`` (node) the nodes found by greedy search of the graph.

    A node's links lie packed beside each other, in buckets that every round reads without a shuffle; a
    query is one row, with its list. A round sends a query to the ``expand`` nearest nodes of its list that
    it was not at, scores their links there, and merges the best ``listed``. A query whose list is done rests.
    """
    links = graph.select(F.col("node").alias("host"), F.col("other").alias("node")).union(known_by(graph, reverse, -1).select("host", "node")).distinct()
    links = links.join(nodes, "node")
    buckets = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["host"]):
            ids, codes = table.column("node").to_numpy(), coder.value.rows(table.column("code").combine_chunks())
            yield pa.RecordBatch.from_pydict({"host": table.column("host")[:1].combine_chunks(), "links": pa.array([ids.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

    packed = links.repartition(buckets, "host").sortWithinPartitions("host").mapInArrow(pack, "host long, links binary, codes binary")
    name = f"sightline_{uuid.uuid4().hex}"
    spark = nodes.sparkSession
    packed.write.format("parquet").bucketBy(buckets, "host").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    packed = spark.table(name)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for own, codes, links in zip(*(batch.column(c) for c in ("code", "codes", "links")), strict=True):
                rows = coder.value.rows(codes.as_py())
                # <q, y> = (|q|^2 + |y|^2 - |q - y|^2) / 2, where the difference is what codes know well
                apart = coder.value.decode(rows)[:, :-1] - coder.value.decode(coder.value.rows(own.as_py()))[:, :-1]
                near = rows["square"] - np.einsum("ij,ij->i", apart, apart)
                best = np.argpartition(-near, listed)[:listed] if len(near) > listed else np.arange(len(near))
                out[0].append(np.frombuffer(links.as_py(), np.int64)[best].tobytes())
                out[1].append(near[best].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(x, pa.binary()) for x in out)], ["node", "ids", "near"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["node"]):
            node, code = table.column("node")[0].as_py(), table.column("code")[0].as_py()
            ids, near = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("near", np.float64)))
            done = np.frombuffer(table.column("done")[0].as_py(), bool)
            done = np.concatenate([done, np.zeros(len(ids) - len(done), bool)])
            order = np.lexsort([~done, ids])
            order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])[: len(order)] & (ids[order] != node)]
            order = order[np.lexsort([ids[order], -near[order]])][:listed]
            ids, near, done = ids[order], near[order], done[order].copy()
            turn = np.flatnonzero(~done)[:expand]
            done[turn] = True
            yield pa.RecordBatch.from_pydict({"node": [node], "code": [code], "ids": [ids.tobytes()], "near": [near.tobytes()], "done": [done.tobytes()], "turn": pa.array([ids[turn].tolist()], pa.list_(pa.int64()))})

    nothing = F.lit(b"")
    state = starts.join(nodes, "node").select("node", "code", nothing.alias("ids"), nothing.alias("near"), nothing.alias("done"), F.array("node").alias("turn"))
    state = materialize(state)
    for _ in range(1 + rounds):
        going = state.select("node", "code", F.explode("turn").alias("host"))
        heard = going.join(packed, "host").select("node", "code", "codes", "links").mapInArrow(visit, "node long, ids binary, near binary")
        rows = state.select("node", F.lit(0).alias("kind"), "code", "ids", "near", "done")
        rows = rows.union(heard.select("node", F.lit(1), F.lit(None).cast("binary"), "ids", "near", F.lit(None).cast("binary")))
        state = materialize(rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(merge, STATE))
        if state.filter(F.size("turn") > 0).isEmpty():
            break
    spark.sql(f"DROP TABLE {name}")
    return state.select("node", "ids", "near")


def nearest(vectors: DataFrame, queries_where, k: int = 20, id_column: str = "vec_id", column: str = "embedding", trees: int = TREES, leaf: int = LEAF, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries_where`` holds for, its k nearest other rows found.

    Nearness is the inner product of the original vectors in double precision; nearest first, ties
    to the smaller vec_id. Rows with a null id, and null and zero vectors or ones with null or
    non-finite parts, take no part; a shorter vector counts as if zeros followed. Equal vectors are one
    node of the graph and all count as candidates; of a node's vectors only the k + 1 smallest ids can
    be results, which is exact. Of repeated ids the row with the least vector counts. Other columns
    are ignored; no usable rows give no rows.
    """
    rows = materialize(usable(vectors, id_column, column))
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes, members, coder = nodes_of(rows, trees, leaf)
    graph = build_graph(nodes, coder, trees=trees, leaf=leaf, **options)
    queries = members.filter(queries_where(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "node")
    starts = queries.select("node").distinct()

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.int64)[: SCORED * k] for x in batch.column("ids")]
            if ids:
                node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(ids))], ["node", "other"])

    found = search(graph, nodes, coder, starts).mapInArrow(unpack, "node long, other long")
    found = found.union(starts.select("node", F.col("node").alias("other")))
    by_id = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = members.withColumn("_place", by_id).filter(F.col("_place") <= k + 1).select(F.col("node").alias("other"), "vec_id")
    pairs = queries.join(found, "node").join(few, "other").filter("vec_id <> query_id").select("query_id", "vec_id")
    exact = rows.withColumnRenamed("vec_id", "_id")
    scored = pairs.join(exact.withColumnsRenamed({"_id": "query_id", "vector": "x"}), "query_id").join(exact.withColumnsRenamed({"_id": "vec_id", "vector": "y"}), "vec_id")
    scored = scored.select("query_id", "vec_id", dot("x", "y").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
