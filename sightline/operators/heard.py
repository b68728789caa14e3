"""Texts as the resolvers hear them: each different text once, cut into tokens with their keys.

Keys are the dearest part of what follows, so they are worked out once a text, over all its tokens as one string, and kept in a table
that all resolvers read, as strings of a token a line, for arrays of strings take long to write. Where a token stands is worked out for the few that are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bangla import phonetic_lines
from ..functions.text import EDGE, folded_keys
from ..sources.scratch import spread, written

#: A token with the white space and punctuation before it; its group is the token.
PIECE = rf"[\s{EDGE}]*([^\s{EDGE}](?:\S*[^\s{EDGE}])?)"
#: Rows that a table may have to be sent whole to each executor.
FEW = 100_000


def listened(texts: DataFrame) -> DataFrame:
    """row, text, tokens, keys, folds: each different ``text`` that is not null, its tokens, their phonetic keys and those folded, one a line; "" without any."""
    every = written(texts.select("text").filter("text is not null").distinct().withColumn("row", F.monotonically_increasing_id()))
    rows = spread(every, "text", "row").select("row", "text", F.array_join(F.regexp_extract_all("text", F.lit(PIECE), F.lit(1)), "\n").alias("tokens"))
    return written(rows.withColumn("keys", phonetic_lines("tokens")).withColumn("folds", folded_keys("keys")))


def each(lines: str) -> Column:
    """The array of what a string has, one a line; an empty one has "" alone."""
    return F.split(lines, "\n")


def pieces(text: str) -> Column:
    """The tokens of a text, each with what stands before it."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def with_rows(clips: DataFrame, heard: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``clips`` with the ``row`` of their text in ``heard``, null for a null text, and ``heard``, made of their texts unless it is given, for clips that have rows."""
    if heard is not None:
        return clips, heard
    heard = listened(clips)
    return clips.join(heard.select("row", "text"), "text", "left"), heard


def few(table: DataFrame) -> DataFrame:
    """A table that is sent whole to each executor if it has few rows, so that what it meets needs no shuffle."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def token(piece: Column) -> Column:
    """The token of a piece."""
    return F.regexp_replace(piece, rf"^[\s{EDGE}]+", "")


def span(pieces: Column, first: Column, last: Column) -> Column:
    """(s, e, raw) of the tokens from place ``first`` to ``last``: where they stand in the text, and what it says there."""
    before = F.array_join(F.slice(pieces, 1, first), "")
    run = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    e = F.length(before) + F.length(run)
    return F.struct((e - F.length(token(run))).cast("int").alias("s"), e.cast("int").alias("e"), token(run).alias("raw"))
