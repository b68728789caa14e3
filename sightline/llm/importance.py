"""Importance resampling towards a target corpus, over position tables of n-grams.

Each text becomes one row a word with its position; ``lead()`` over a document's positions appends the
words that follow, once for every order, and each run of words is hashed to a bucket. Buckets are counted
over all documents and over the target, and the log ratio of the two, the bucket's gain, is joined back to
every position. A document's mean gain plus noise that its id fixes is its score; the highest scores
are drawn. Ranks come from a histogram of the scores, which are whole numbers, so nothing is sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize, row_key

#: Words of text before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that one partition of the position table comes from at most, beside what spark.sql.shuffle.partitions asks: a word's
#: row takes some 80 bytes in its sort, which spills where memory ends, and more partitions would burden the shuffle of a large input.
PART_BYTES = 128 << 20

ROW = ["row_a", "row_b", "copy"]


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, order: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of (doc_id, text), towards the texts of ``target``.

    Features are all runs of 1 to ``order`` words. A document's weight is the floored mean gain of its
    features, in thousandths. Of the N documents with ``least_words`` or more, the floor(percent * N / 100)
    with the highest scores have a rank from 1; ties go to the smaller doc_id, a null one last.

    Null and empty texts have no features and weight 0, and so may be drawn only if ``least_words`` is 0; a text and a word may
    have any length; a null doc_id draws its noise as an empty id; equal rows each count and each take a rank, rows of one
    doc_id are ranked by a digest of their texts; an empty target or an empty table of documents counts as 0
    everywhere; other columns are ignored; no rows give no rows.
    """
    words = materialize(positions(docs.select("doc_id", "text"), order, buckets))
    wanted = positions(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets)
    gains = F.broadcast(materialize(_gains(_counts(words, order, "s"), _counts(wanted, order, "t"), buckets)))  # ``buckets`` rows
    scored = words
    for n in range(1, order + 1):
        scored = scored.join(gains.select(F.col("bucket").alias(f"bucket_{n}"), F.col("gain").alias(f"gain_{n}")), f"bucket_{n}", "left")
    sum_of = lambda parts: sum(parts[1:], parts[0])
    scored = scored.groupBy(*ROW).agg(
        F.first("doc_id").alias("doc_id"),
        F.count("bucket_1").alias("n_words"),
        F.sum(sum_of([F.col(f"bucket_{n}").isNotNull().cast("long") for n in range(1, order + 1)])).alias("n_features"),
        F.sum(sum_of([F.coalesce(f"gain_{n}", F.lit(0)) for n in range(1, order + 1)])).alias("gain"),
    )
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0).cast("long")
    scored = scored.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return _ranked(materialize(scored), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def positions(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """Row key, doc_id and bucket_1 .. bucket_n of every word position: the run of n words that begins there, null where the text ends first.

    Texts without words have one row of nulls. Texts are dealt by row once; equal rows are told apart by ``copy``.
    Everything after that stays in the same partitions, since a window over a row needs no other deal.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // PART_BYTES)
    rows = docs.select("doc_id", "text", *row_key()).repartition(parts, "row_a", "row_b")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("row_a", "row_b").orderBy("row_a")))
    words = rows.select(*ROW, "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    words = words.withColumn("word", _lower(F.col("word")))
    following = Window.partitionBy(*ROW).orderBy("pos")
    run, found = F.col("word"), []
    for n in range(1, order + 1):
        if n > 1:  # null, as concat() makes it, where no word follows
            run = F.concat(run, F.lit(" "), F.lead("word", n - 1).over(following))
        found.append((F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"bucket_{n}"))
    return words.select(*ROW, "doc_id", *found)


def _lower(word: Column) -> Column:
    """A-Z become a-z and nothing else changes; lower() does that to words of ASCII alone, and faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * g) for a Gumbel variable g that ``seed`` and the id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def _counts(words: DataFrame, order: int, name: str) -> DataFrame:
    """Features in each bucket: a row a bucket, added up in each task before it is sent."""
    bucket = F.explode(F.array(*(F.col(f"bucket_{n}") for n in range(1, order + 1)))).alias("bucket")
    return words.select(bucket).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def _gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all ``buckets``."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    whole = Window.partitionBy(F.lit(0))  # ``buckets`` rows
    ratio = (F.col("t") + 1) * (F.sum("s").over(whole) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """With rank. Scores are whole numbers between bounds that the gains and the noise set (some 50,000
    values), so a table of how many rows have a higher score is small at any input; only rows that
    may be drawn are ranked, each score on its own.
    """
    able = scored.filter(F.col("n_words") >= least_words)
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    levels = counts.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("higher"), F.floor(F.sum("n").over(whole) * percent / 100).alias("drawn"))
    levels = F.broadcast(materialize(levels.filter("higher < drawn")))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").isNull(), "doc_id", *ROW)
    drawn = able.join(levels, "score").withColumn("rank", F.col("higher") + F.row_number().over(within))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long"))
    rest = scored.join(levels, (F.col("n_words") >= least_words) & (scored["score"] == levels["score"]), "left_anti")
    return drawn.select(*scored.columns, "rank").union(rest.withColumn("rank", F.lit(None).cast("long")))
