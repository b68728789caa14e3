"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
into the shared folder and rereads it as the next stage's docs. A stage first removes the intermediate
tables of the one before it, whose result must have been written by then. Stages hold the session's Arrow batches
to BATCH_BYTES: at Spark's 64 MB both sides of each Python task hold all texts of a partition at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import jaccard_join, lexicon, mixing, substring_dedup, toxicity
from sightline.llm.store import clear, made_for, materialize, row_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES; one that is lower stays. It holds when the stage's result is written, so it is left set."""
    limit = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if limit > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that begins by removing what the one before it left."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            _small_batches(spark)
            if before:
                clear(spark, before)
            with made_for(stage.__name__):
                return stage(spark, docs, sf_dir)

        return run_stage

    return wrap


@_after(None)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject.

    Null and empty texts have the score of a text without features and so stay unless most labelled texts are
    toxic; without labels of both kinds all documents stay; texts of any length are scored whole; equal texts get equal scores, so repeated rows stay
    or go together; rows with a null or repeated doc_id are judged by their own text; an empty
    table stays empty; columns keep their names and values, whatever they are called.
    """
    score = toxicity.learned_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, held_out=0)
    return docs.filter(score(F.col("text")) < 0.5)


@_after("drop_toxic")
def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id.

    A null doc_id comes last, and of one doc_id the row with the least digest of its text. Of rows with equal doc_id
    and text one stays, the least by its other columns. Null texts and texts without words belong to
    no group and stay. Texts count whole, whatever their length; an empty table stays empty; other
    columns keep their names and values.
    """
    linked = jaccard_join.link_documents(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_a", "row_b")).alias("first")
    kept = linked.filter("component is not null").groupBy("component").agg(first).select("first.row_a", "first.row_b")
    kept = kept.union(linked.filter("component is null").select("row_a", "row_b").distinct())
    keyed = docs.select(F.struct("*").alias("row"), *row_key())
    single = keyed.join(kept, ["row_a", "row_b"], "left_semi").groupBy("row_a", "row_b").agg(F.min("row").alias("row"))
    return single.select(*(F.col("row")[c].alias(c) for c in docs.columns))


@_after("keep_one_of_group")
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur elsewhere.

    Where words go, ``text`` is the others joined by one space and ``n_chars`` its length; all else stays as
    it is. Rows belong together by doc_id and text, so null and repeated ids do no harm, and repeated rows cut each
    other's passages. Null and empty texts come out as ''; texts count whole; an empty table
    stays empty; columns may have any names.
    """
    cut = substring_dedup.remove_repeats(docs).select("row_a", "row_b", "n_removed", "kept").dropDuplicates(["row_a", "row_b"])
    rest = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), *row_key()).join(cut, ["row_a", "row_b"])
    text = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return rest.select(*(text[c].alias(c) if c in text else F.col("row")[c].alias(c) for c in docs.columns))


@_after("cut_repeats")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source ask.

    A null source is a source of its own; null and empty texts hold no words and go; rows of one doc_id are taken together;
    texts of any length may be cut where a budget ends; repeated rows each count; an empty
    table stays empty; other columns keep their names and values.
    """
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, max_passes=2)


@_after("mix_sources")
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix: one row for each row of ``docs``, doc_id null or repeated or not.

    Null and empty texts have no tokens; texts count whole; other columns are left out.
    """
    import public_tokenizers

    return lexicon.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_group),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the classifier, the merges or the exact join at this size; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
