"""Evaluation: error rates, matching of observations, precision and recall, calibration, gates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.compat import half_up
from ..functions.text import tokens


def cer(reference: Column, heard: Column) -> Column:
    """Edit distance over the reference's length, white space removed; an empty reference gives 0 or 1."""
    a, b = (F.regexp_replace(x, r"\s+", "") for x in (reference, heard))
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.nullif(F.length(a), F.lit(0)))


def precision_recall(tallies: DataFrame) -> DataFrame:
    """field, precision, recall, f1, accuracy of (field, correct, wrong, missed, spurious); 0/0 is 1, f1 of 0 and 0 is 0."""
    c = F.col("correct")
    share = lambda part, whole: F.when(whole == 0, 1.0).otherwise(part / F.nullif(whole, F.lit(0)))
    p = share(c, c + F.col("wrong") + F.col("spurious"))
    r = share(c, c + F.col("wrong") + F.col("missed"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    accuracy = share(c, c + F.col("wrong") + F.col("missed") + F.col("spurious"))
    return tallies.select("field", *(half_up(x, 4).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (accuracy, "accuracy"))))


def field_tallies(rows: DataFrame) -> DataFrame:
    """field, correct, wrong, missed, spurious of (field, truth, predicted); two nulls count nowhere."""
    t, p = F.col("truth"), F.col("predicted")
    tally = lambda where: F.coalesce(F.sum(F.when(where, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.groupBy("field").agg(tally(t == p).alias("correct"), tally(t != p).alias("wrong"), tally(t.isNotNull() & p.isNull()).alias("missed"), tally(t.isNull() & p.isNotNull()).alias("spurious"))


def calibration(samples: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, correct, mean_conf, observed of (conf, correct): equal bins [i/n, (i+1)/n), the last closed; empty bins too."""
    edges = [i / bins for i in range(bins + 1)]
    place = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        place = F.when(F.col("conf") < edges[i + 1], i).otherwise(place)
    counted = samples.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("correct"), F.avg("conf").alias("mean_conf"))
    spine = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda x, kind: F.coalesce(x, F.lit(0)).cast(kind)
    observed = F.try_divide(F.col("correct"), F.col("n"))
    return spine.join(counted, "bin", "left").select("bin", zero(F.col("n"), "long").alias("n"), zero(F.col("correct"), "long").alias("correct"), half_up(zero(F.col("mean_conf"), "double"), 4).alias("mean_conf"), half_up(zero(observed, "double"), 4).alias("observed"))


def gate(samples: DataFrame) -> DataFrame:
    """flagged_share, errors_caught (1 without errors), flag_precision (0 without flags) of (flagged, wrong)."""
    n = lambda where: F.sum(F.when(where, 1).otherwise(0))
    both = n(F.col("flagged") & F.col("wrong"))
    return samples.agg(
        half_up(F.coalesce(F.try_divide(n(F.col("flagged")), F.count("*")), F.lit(0.0)), 4).alias("flagged_share"),
        half_up(F.coalesce(F.try_divide(both, n(F.col("wrong"))), F.lit(1.0)), 4).alias("errors_caught"),
        half_up(F.coalesce(F.try_divide(both, n(F.col("flagged"))), F.lit(0.0)), 4).alias("flag_precision"),
    )


#: Distinct words that one pair of texts may have for an exact word error rate.
MOST_WORDS = 55_000


def wer(reference: Column, heard: Column) -> Column:
    """Word errors over the reference's words; an empty reference gives 0 or 1; may exceed 1.

    Each distinct word of the two texts becomes one letter, so that the edit distance of strings is that of words.
    """
    words = lambda x: F.transform(tokens(F.coalesce(x, F.lit(""))), lambda t: t["text"])
    # arrays of one bind what is worked out to names; the optimizer would put the expressions into each word
    bound = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))

    def rate(said: Column) -> Column:
        a, b = said["a"], said["b"]
        letter = lambda known, w: F.lpad(F.hex(F.array_position(known, w) + 0xFF), 4, "0")
        spelt = lambda known, ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: letter(known, w)), "")), "UTF-16BE")
        far = lambda known: F.when(F.size(known) > MOST_WORDS, F.raise_error(F.lit("too many distinct words for one word error rate"))).otherwise(F.levenshtein(spelt(known, a), spelt(known, b)))
        distance = bound(F.array_distinct(F.concat(a, b)), far)
        return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.nullif(F.size(a), F.lit(0)))

    return bound(F.struct(words(reference).alias("a"), words(heard).alias("b")), rate)


def with_wer(rows: DataFrame) -> DataFrame:
    """Rows of (reference, heard) with ``wer``; equal pairs are compared once."""
    pairs = rows.select(F.col("reference").alias("_r"), F.col("heard").alias("_h")).distinct().withColumn("wer", wer(F.col("_r"), F.col("_h")))
    return rows.join(pairs, F.col("reference").eqNullSafe(F.col("_r")) & F.col("heard").eqNullSafe(F.col("_h"))).drop("_r", "_h")


def error_rates(clips: DataFrame) -> DataFrame:
    """One row: scored clips, and the means of their word and character error rates, of (reference, heard); 0 for none.

    Equal pairs are compared once, for as many clips as they are.
    """
    pairs = clips.groupBy("reference", "heard").agg(F.count("*").alias("n"))
    rates = pairs.select("n", wer(F.col("reference"), F.col("heard")).alias("w"), cer(F.col("reference"), F.col("heard")).alias("c"))
    mean = lambda x: F.try_divide(F.sum(F.col(x) * F.col("n")), F.sum(F.when(F.col(x).isNotNull(), F.col("n"))))
    return rates.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("clips"), *(half_up(F.coalesce(mean(x), F.lit(0.0)), 4).alias(n) for x, n in (("w", "wer"), ("c", "cer"))))


# The fields of an observation that are scored, by column and by name.
SCORED = {"type": "type", "outlet_id": "outletId", "sku_id": "skuId", "competitor_brand": "competitorBrand", "quantity": "quantity", "price_delta": "priceDelta"}


def known_value(x: Column) -> Column:
    """A field's value as it is compared: text, null for ''."""
    return F.nullif(x.cast("string"), F.lit(""))


def agreement(a: Column, b: Column) -> Column:
    """How many scored fields of two observations are known and equal."""
    total = F.lit(0)
    for c in SCORED:
        total = total + F.when(known_value(a[c]) == known_value(b[c]), 1).otherwise(0)
    return total


def matched(clips: DataFrame) -> DataFrame:
    """clip_id, t, p: the observations of (clip_id, truth, predicted), arrays, that belong together; either may be null.

    In the order of ``truth`` each takes the prediction not yet taken that agrees best, the first of equals, even if
    nothing agrees; what is left over has no partner. The arrays are those of one clip.
    """
    truth, predicted = F.coalesce("truth", F.filter("predicted", lambda x: F.lit(False))), F.coalesce("predicted", F.filter("truth", lambda x: F.lit(False)))
    rows = clips.select("clip_id", truth.alias("truth"), predicted.alias("predicted"))

    def take(taken: Column, t: Column) -> Column:
        every = F.transform("predicted", lambda p, i: F.struct(agreement(p, t).alias("n"), (-i).alias("order")))
        best = F.array_max(F.filter(every, lambda x: ~F.array_contains(taken, -x["order"])))
        return F.array_append(taken, F.coalesce(-best["order"], F.lit(-1)))

    taken = F.aggregate("truth", F.array().cast("array<int>"), take)
    rows = rows.withColumn("taken", taken)
    nothing = F.lit(None).cast(clips.schema["predicted"].dataType.elementType)
    pairs = F.transform("truth", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.when(F.get("taken", i) >= 0, F.get("predicted", F.get("taken", i))), nothing).alias("p")))
    spare = F.transform(F.filter(F.transform("predicted", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.array_contains("taken", x["i"])), lambda x: F.struct(nothing.alias("t"), x["p"].alias("p")))
    return rows.select("clip_id", F.inline(F.concat(pairs, spare)))


def scored_fields(pairs: DataFrame) -> DataFrame:
    """clip_id, field, truth, predicted of each scored field of (clip_id, t, p)."""
    entries = F.array(*(F.struct(F.lit(name).alias("field"), known_value(F.col("t")[c]).alias("truth"), known_value(F.col("p")[c]).alias("predicted")) for c, name in SCORED.items()))
    return pairs.select("clip_id", F.inline(entries))


def merged_tallies(*tallies: DataFrame) -> DataFrame:
    """Tallies of several runs as one."""
    every = tallies[0]
    for t in tallies[1:]:
        every = every.unionByName(t)
    return every.groupBy("field").agg(*(F.sum(c).alias(c) for c in ("correct", "wrong", "missed", "spurious")))


def overall_accuracy(tallies: DataFrame) -> DataFrame:
    """One row: correct over all outcomes of all fields; 0 without any."""
    every = F.sum(F.col("correct") + F.col("wrong") + F.col("missed") + F.col("spurious"))
    return tallies.agg(half_up(F.coalesce(F.try_divide(F.sum("correct"), every), F.lit(0.0)), 4).alias("accuracy"))


def calibration_error(samples: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal bins, and Brier score, of (conf, correct); 0 for no samples."""
    hit = F.col("correct").cast("double")
    place = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        place = F.when(F.col("conf") < (i + 1) / bins, i).otherwise(place)
    by_bin = samples.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg(hit).alias("hit"), F.sum((F.col("conf") - hit) * (F.col("conf") - hit)).alias("squares"))
    share = lambda x: half_up(F.coalesce(F.try_divide(F.sum(x), F.sum("n")), F.lit(0.0)), 4)
    return by_bin.agg(share(F.col("n") * F.abs(F.col("conf") - F.col("hit"))).alias("ece"), share(F.col("squares")).alias("brier"))


def regressed(now: Column, before: Column, tolerance: float = 0.02) -> Column:
    """Whether accuracy fell by more than the tolerance; never without an earlier run."""
    return F.coalesce(now < before - tolerance, F.lit(False))


def with_deltas(snapshots: DataFrame, *measures: str) -> DataFrame:
    """Snapshots (run_at, measures) with each measure's change since the run before."""
    w = Window.orderBy("run_at")  # one row a run
    return snapshots.select("*", *((F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in measures))


def write_snapshot(report: DataFrame, folder: str, day: str) -> None:
    """One JSON file for a day's report, in place of an earlier one of that day."""
    report.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/day={day}")


def latest_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the last day's report; the folder is listed, and no other day is read. Without reports there are no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    days = [x for x in names if x.startswith("day=")]
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/{max(days)}") if days else spark.createDataFrame([], schema)


def load_labels(spark: SparkSession, folder: str, schema: str, limit: int | None = None) -> DataFrame:
    """Ground truth from a folder of JSON files, by file name: those that fit the schema and are not held out by dialect.

    ``schema`` must have clip_id, dialect and observations; a file without a clip_id or observations does not fit.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).select("*", F.col("_metadata.file_name").alias("_file"))
    fits = rows.filter(F.col("clip_id").isNotNull() & F.col("observations").isNotNull() & (F.col("dialect") == "dhaka")).orderBy("_file")
    return (fits.limit(limit) if limit is not None else fits).drop("_file")


def markdown(tallies: DataFrame) -> DataFrame:
    """One row, ``text``: the per-field table of a report. At most one line a field."""
    rows = tallies.join(precision_recall(tallies), "field")
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    cells = [F.concat(F.lit("`"), "field", F.lit("`")), *(F.col(c).cast("string") for c in ("correct", "wrong", "missed", "spurious")), *(percent(c) for c in ("precision", "recall", "f1"))]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = "| Field | Correct | Wrong | Missed | Spurious | Precision | Recall | F1 |\n|---|---:|---:|---:|---:|---:|---:|---:|\n"
    listed = F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda x: x["line"])
    return rows.agg(F.concat(F.lit(head), F.array_join(listed, "\n")).alias("text"))
