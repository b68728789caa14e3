"""Quantities in Bengali speech: number words are classified by joins, runs of them are valued by windows.

Distinct words are classified once: digits, compounds, listed spellings by equality, and the
rest by the nearest phonetic key of a number word, which a join on key segments finds. Windows then cut a document's tokens into runs
of number words, find what each prefix adds to, and where terms begin; a run's value is the sum of
its terms, each a number times its multipliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bangla_values as values
from ..functions.bangla import normal_word, phonetic_key, western_digits
from ..functions.compat import half_up
from ..sources.scratch import written
from .heard import each, few, pieces, span, with_rows
from .resolve import similar_keys

FUZZY_THRESHOLD, VARIANT_CONFIDENCE, FUZZY_CONFIDENCE = 0.85, 0.95, 0.9
ENTRY = "kind string, number double, unit string, word string"
#: Scales from which what follows is added and no longer multiplied.
LARGE_SCALE = 1000


def _lexicon(spark: SparkSession) -> DataFrame:
    """form, key, ord and entry of each spelling; of equal spellings the first counts. Some 170 rows."""
    rows = []
    for kind, number, unit, word, others in values.NUMBER_WORDS:
        rows += [(form, len(rows) + i, form == word, kind, float(number), unit, word) for i, form in enumerate([word, *others])]
    table = spark.createDataFrame(rows, f"form string, ord int, canonical boolean, {ENTRY}").withColumn("form", normal_word("form"))
    table = table.withColumn("canonical", F.col("form") == normal_word("word"))
    first = table.groupBy("form").agg(F.min_by(F.struct("ord", "canonical", "kind", "number", "unit", "word"), "ord").alias("x")).select("form", "x.*")
    return written(first.withColumn("key", phonetic_key("form")).coalesce(1))


def classify(words: DataFrame) -> DataFrame:
    """token -> kind, number, unit, word, confidence, basis, for each distinct token that counts in a quantity."""
    spark = words.sparkSession
    lexicon = _lexicon(spark)
    compounds = spark.createDataFrame([(form, float(number), basis) for form, number, basis in values.COMPOUNDS], "form string, number double, basis string")
    compounds = compounds.select(normal_word("form").alias("form"), "number", "basis")
    rows = words.select("token").distinct().withColumn("form", normal_word("token")).withColumn("digits", western_digits("form"))
    rows = written(rows.withColumn("own", phonetic_key("form")))
    columns = ["token", "kind", "number", "unit", "word", "confidence", "basis"]
    none = lambda kind="string": F.lit(None).cast(kind)
    is_number = F.col("digits").rlike(r"^[0-9]+(\.[0-9]+)?$")
    literal = rows.filter(is_number).select("token", F.lit("cardinal").alias("kind"), F.col("digits").cast("double").alias("number"), none().alias("unit"), F.col("digits").alias("word"), F.lit(1.0).alias("confidence"), F.lit("").alias("basis"))
    rest = rows.filter(~is_number & (F.col("form") != ""))
    joined = rest.join(F.broadcast(compounds), "form").select("token", F.lit("cardinal").alias("kind"), "number", none().alias("unit"), F.col("token").alias("word"), F.lit(1.0).alias("confidence"), "basis")
    rest = rest.join(F.broadcast(compounds), "form", "left_anti")
    exact = rest.join(F.broadcast(lexicon), "form").withColumns({"confidence": F.when(F.col("canonical"), 1.0).otherwise(VARIANT_CONFIDENCE), "basis": none()}).select(columns)
    rest = rest.join(F.broadcast(lexicon), "form", "left_anti").filter((F.length("form") >= 2) & (F.col("own") != ""))
    forms = lexicon.filter("kind <> 'unit' and key <> ''").select(F.col("key").alias("right"), F.struct((-F.col("ord")).alias("order"), "kind", "number", "unit", "word").alias("k"))
    near = similar_keys(rest.select(F.col("own").alias("key")), forms.select(F.col("right").alias("key")), FUZZY_THRESHOLD, bones=False).withColumnRenamed("likeness", "score")
    near = near.join(F.broadcast(forms), "right").groupBy(F.col("left").alias("own")).agg(F.max(F.struct("score", "k")).alias("best")).join(rest.select("token", "own"), "own")
    near = near.select("token", "best.k.kind", "best.k.number", "best.k.unit", "best.k.word", (F.col("best.score") * FUZZY_CONFIDENCE).alias("confidence"), none().alias("basis"))
    return literal.unionByName(joined).unionByName(exact).unionByName(near)


def shown(x: Column) -> Column:
    """A number without a needless decimal point or exponent."""
    return F.regexp_replace(x.cast("decimal(38,6)").cast("string"), "\\.?0+$", "")


def _runs(named: DataFrame, key: str) -> DataFrame:
    """The tokens of each run of number words, with ``run`` and, at the last, ``after``: the unit that follows. ``named`` are number words and units alone.

    A run is a stretch of number words from its first number or prefix on. A prefix that no number
    follows spoils what stands before it, so such a stretch counts only from behind it.
    """
    text = Window.partitionBy(key).orderBy("place")
    is_number = F.col("kind").isin("cardinal", "fraction", "prefix", "scale", "count")
    gaps = F.col("place") + 1 - F.sum(F.when(is_number, 1).otherwise(0)).over(text)  # tokens so far that are no number words
    following = F.lead(F.struct("place", "kind", "unit", "e", "confidence")).over(text)
    rows = named.select("*", is_number.alias("is_number"), gaps.alias("run"), following.alias("next"))
    rows = rows.withColumn("after", F.when(F.col("next.place") == F.col("place") + 1, F.col("next"))).drop("next").filter("is_number")
    stretch = Window.partitionBy(key, "run")
    where = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("place"))).over(stretch)
    spoilt = F.coalesce(where("prefix") > F.coalesce(where("cardinal"), F.lit(-1)), F.lit(False))
    rows = rows.withColumn("cut", F.when(spoilt, where("prefix")).otherwise(-1)).filter("place > cut")
    first = F.min(F.when(F.col("kind").isin("cardinal", "fraction", "prefix"), F.col("place"))).over(stretch)
    return rows.withColumn("first", first).filter("place >= first")


def quantities(docs: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """doc_id and [s, e), value, unit, basis, confidence of each quantity in (doc_id, text), whose texts may have been ``heard``.

    Null texts and texts without a number have none. Of rows that share a doc_id each counts by itself.
    """
    docs, heard = with_rows(docs, heard)  # equal texts have equal quantities
    found = heard.select("row", F.posexplode(each("tokens")).alias("place", "token")).filter("token <> ''")
    named = found.join(few(written(classify(found))), "token").withColumns({"s": F.col("place"), "e": F.col("place")})  # places for now
    runs = _runs(named, "row")

    # each prefix belongs to the next cardinal: the last one since the cardinal before
    in_run = Window.partitionBy("row", "run").orderBy("place")
    numbers = F.coalesce(F.sum(F.when(F.col("kind") == "cardinal", 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("span", numbers)
    prefix = F.max(F.when(F.col("kind") == "prefix", F.struct("place", "number", "word"))).over(Window.partitionBy("row", "run", "span"))
    runs = runs.withColumn("prefix", F.when(F.col("kind") == "cardinal", prefix))
    multiplies = F.col("kind").isin("scale", "count")
    known = F.last(F.when(F.col("kind") != "prefix", F.struct("kind", "number")), ignorenulls=True)
    before = known.over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(~multiplies | ((before["kind"] == "scale") & (before["number"] >= LARGE_SCALE)), F.lit(False))
    base = F.col("number") + F.coalesce(F.col("prefix.number"), F.lit(0.0))
    sign = F.when(F.col("prefix.number") >= 0, "+").otherwise("−")
    added = F.concat(shown(F.col("number")), F.lit(" "), sign, F.lit(" "), shown(F.abs("prefix.number")), F.lit(" ("), F.col("prefix.word"), F.lit(" "), F.col("word"), F.lit(")"))
    plain = F.when(F.col("basis").isNull(), F.concat(shown(F.col("number")), F.lit(" ("), F.col("word"), F.lit(")"))).when(F.col("basis") == "", shown(F.col("number"))).otherwise(F.col("basis"))
    told = F.when(multiplies, F.concat(F.lit("× "), shown(F.col("number")), F.lit(" ("), F.col("word"), F.lit(")"))).when(F.col("prefix").isNotNull(), added).otherwise(plain)
    runs = runs.withColumns({"opens": opens, "base": base, "told": told})
    part = F.when(F.col("kind") != "prefix", F.struct("place", "opens", F.col("base").alias("number"), "told"))
    gathered = runs.groupBy("row", "run").agg(
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.min("confidence").alias("confidence"),
        F.max_by("after", "place").alias("after"),
        F.max(F.col("kind") == "count").alias("counted"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("term"))
    value = F.aggregate("parts", zero, lambda a, x: F.struct((a["sum"] + F.when(x["opens"], a["term"]).otherwise(0.0)).alias("sum"), (F.when(x["opens"], x["number"]).otherwise(a["term"] * x["number"])).alias("term")), lambda a: a["sum"] + a["term"])

    has_unit = F.coalesce(F.col("after.kind") == "unit", F.lit(False))
    unit = F.when(has_unit, F.col("after.unit")).when(F.col("counted"), "piece")
    basis = F.concat_ws(" ", F.transform("parts", lambda x: x["told"]), F.when(has_unit, F.col("after.unit")))
    confidence = F.when(has_unit, F.least("confidence", "after.confidence")).otherwise(F.col("confidence"))
    end = F.when(has_unit, F.col("after.e")).otherwise(F.col("e"))
    stated = gathered.select("row", "s", end.alias("e"), half_up(value, 6).alias("value"), unit.alias("unit"), basis.alias("basis"), half_up(confidence, 4).alias("confidence"))
    stated = stated.groupBy("row").agg(F.collect_list(F.struct(*stated.columns[1:])).alias("x"))
    stated = stated.join(heard.select("row", "text"), "row").withColumn("pieces", pieces("text"))
    placed = F.transform("x", lambda x: F.struct(x.alias("x"), span(F.col("pieces"), x["s"], x["e"]).alias("span")))
    stated = stated.select("row", F.inline(F.transform(placed, lambda y: y["x"].withField("s", y["span"]["s"]).withField("e", y["span"]["e"]))))
    return docs.select("doc_id", "row").join(stated, "row").drop("row")
