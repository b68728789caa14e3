"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source that needs a fraction of a pass over its
documents takes those whose hash lies below a threshold. The threshold is found by summing
words by source and hash bucket, then only the bucket in which the budget ends is divided
again, until it holds one hash value; no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """The first 60 bits of md5 of the id as text (of '' for a null id)."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_passes: int) -> DataFrame:
    """(source, source_size) -> with target: share * all words, dealt by weight, at most max_passes * source_size.

    Sources in code-point order, null last, take the weights in turn. What a full source cannot
    take is dealt again by weight; that is a common level ``min(level * weight, cap)``, found
    here with one running sum over sources ordered by cap per weight. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_fill = Window.orderBy("_fill", F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * float(max_passes))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
        .withColumn("_level", F.min(F.when(F.col("_fill") >= F.col("_level"), F.struct("_fill", "_level"))).over(everything)["_level"])
    )
    target = F.least(F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")), F.col("_cap"))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def mix_to_weights(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_passes: int = 2, bits: int = 12) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document of (doc_id, text, source).

    ``taken`` counts the words that the mix takes of a document: whole passes, one more for
    documents below the source's threshold, and at the threshold itself the rest of the budget,
    dealt over the documents with that very hash in proportion to their sizes. The words taken of a
    source therefore miss floor(target) by less than the number of those documents, and no
    document gives more than ``max_passes`` times its size.

    Null and empty texts have size 0 and give 0; a null source is a source of its own; equal
    rows share a hash and so are treated alike; other columns are ignored; no rows give no rows.
    ``share`` must not exceed ``max_passes``. Equal input gives equal output, in any partitioning.
    """
    sized = materialize(_sized(docs))
    return _taken(sized, _plan(sized, weights, share, max_passes, bits)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_passes: int = 2, bits: int = 12) -> DataFrame:
    """The mix itself: each row of (doc_id, text, source, n_chars, ...) once for each pass over it.

    A pass that the budget ends within a document has that document's first words, joined by one
    space, and their n_chars. Other rules as for ``mix_to_weights``.
    """
    state = _plan(materialize(_sized(docs)), weights, share, max_passes, bits)
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    taken = _taken(_sized(docs, row), state).filter("taken > 0")
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)
    parts = taken.select("_row", "size", "taken", F.explode(passes).alias("_pass"))
    words = F.least(F.col("size"), F.col("taken") - F.col("_pass") * F.col("size"))
    whole = words == F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(whole, F.col("_row.text")).otherwise(cut)
    changed = {"text": text, "n_chars": F.when(whole, F.col("_row.n_chars")).otherwise(F.length(cut).cast("long"))}
    return parts.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("hash"), *more)


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, max_passes: int, bits: int) -> DataFrame:
    """One row a source: whole passes, and the hash at which the part pass ends."""
    if share > max_passes:
        raise ValueError("share exceeds max_passes: no mix of that size exists")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_passes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("passes", passes)
    state = state.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    state = materialize(state.withColumns({"prefix": F.lit(0).cast("long"), "at_edge": F.col("source_size"), "least": F.lit(0).cast("long"), "most": F.lit(1).cast("long")}))
    for depth in range(bits, HASH_BITS + bits, bits):
        if state.filter((F.col("rest") > 0) & (F.col("least") < F.col("most"))).isEmpty():
            break
        state = materialize(_refine(sized, state, min(depth, HASH_BITS), depth - bits))
    return state


def _refine(sized: DataFrame, state: DataFrame, depth: int, above: int) -> DataFrame:
    """Divide each source's boundary bucket, of ``above`` hash bits, into buckets of ``depth`` bits."""
    edge = state.filter((F.col("rest") > 0) & (F.col("least") < F.col("most"))).select(F.col("source").alias("_source"), "prefix", "rest")
    rows = sized.join(edge, sized["source"].eqNullSafe(edge["_source"]) & (F.shiftright("hash", HASH_BITS - above) == F.col("prefix")))
    buckets = rows.groupBy("source", F.shiftright("hash", HASH_BITS - depth).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.first("rest").alias("rest")
    )
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.sum("words").over(upto))
    found = buckets.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    found = found.groupBy(F.col("source").alias("_source")).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words", "least", "most")).alias("_new"))
    keep = state.join(found, state["source"].eqNullSafe(found["_source"]), "left")
    new = lambda name, old: F.coalesce(F.col("_new")[name], F.col(old)).alias(old)
    return keep.select("source", "source_size", "target", "passes", new("rest", "rest"), new("bucket", "prefix"), new("words", "at_edge"), new("least", "least"), new("most", "most"))


def _taken(sized: DataFrame, state: DataFrame) -> DataFrame:
    """With ``least == most`` the boundary is that hash; a ``rest`` of 0 takes what lies below it."""
    state = state.select(F.col("source").alias("_source"), "source_size", "target", "passes", "rest", "at_edge", "least", "most")
    once = (
        F.when((F.col("source_size") == 0) | (F.col("hash") > F.col("least")), F.lit(0))
        .when(F.col("hash") < F.col("least"), F.col("size"))
        .when(F.col("at_edge") > 0, F.floor(F.col("rest") * F.col("size") / F.col("at_edge")))
        .otherwise(0)
        .cast("long")
    )
    joined = sized.join(state, sized["source"].eqNullSafe(state["_source"]))
    return joined.withColumn("taken", F.col("passes") * F.col("size") + once)
