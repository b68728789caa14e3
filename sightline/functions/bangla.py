"""Phonetic keys of Bengali words, and number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bangla_values as values
from .compat import ColumnLike, col
from .text import latin_key, latin_keys

VIRAMA, NUKTA = "্", "়"
#: Letters with a nukta, in two code points or one, and their sounds.
WITH_NUKTA = {"ড" + NUKTA: "r", "ঢ" + NUKTA: "r", "য" + NUKTA: "y", "ড়": "r", "ঢ়": "r", "য়": "y"}
#: Vowel signs in two code points, and the one that means the same.
COMPOSED = {"\u09c7\u09be": "\u09cb", "\u09c7\u09d7": "\u09cc"}
INVISIBLE = "[​-‍﻿]"


def bangla_key(word: ColumnLike) -> Column:
    """Phonetic key of a word with Bengali letters; other scripts in it stay as they are.

    Composed and decomposed letters with a nukta, and vowel signs, sound alike.
    """
    s = F.trim(F.regexp_replace(col(word), INVISIBLE, ""))
    for pair, one in COMPOSED.items():
        s = F.replace(s, F.lit(pair), F.lit(one))
    for letter, sound in WITH_NUKTA.items():
        s = F.replace(s, F.lit(letter), F.lit(sound))
    for group, sound in ((VIRAMA + "য", ""), (VIRAMA + "র", "r"), ("র" + VIRAMA, "r")):
        s = F.replace(s, F.lit(group), F.lit(sound))
    for letter, sound in values.SOUNDS.items():
        if len(sound) > 1:
            s = F.replace(s, F.lit(letter), F.lit(sound))
    single = {letter: sound for letter, sound in values.SOUNDS.items() if len(sound) == 1}
    s = F.translate(s, "".join(single), "".join(single.values()))
    s = F.regexp_replace(F.lower(F.regexp_replace(s, "[ঀ-৿]", "")), "[^a-z0-9]", "")
    return F.regexp_replace(s, "(.)\\1+", "$1")


def phonetic_key(word: ColumnLike) -> Column:
    """The key of a word in either script: one Bengali code point makes it Bengali."""
    return F.when(col(word).rlike("[ঀ-৿]"), bangla_key(word)).otherwise(latin_key(word))


def phonetic_lines(lines: ColumnLike) -> Column:
    """The ``phonetic_key`` of each of many words, one a line and without white space; where none is Bengali they are worked out together."""
    each = F.array_join(F.transform(F.split(col(lines), "\n"), phonetic_key), "\n")
    return F.when(col(lines).rlike("[ঀ-৿]"), each).otherwise(latin_keys(lines))


def normal_word(word: ColumnLike) -> Column:
    """The form that number words are looked up by: no invisible signs, trimmed, lower case, nukta apart."""
    s = F.lower(F.trim(F.regexp_replace(col(word), INVISIBLE, "")))
    for whole, apart in (("ড়", "ড" + NUKTA), ("ঢ়", "ঢ" + NUKTA), ("য়", "য" + NUKTA)):
        s = F.replace(s, F.lit(whole), F.lit(apart))
    return s


def western_digits(word: ColumnLike) -> Column:
    return F.translate(col(word), "০১২৩৪৫৬৭৮৯", "0123456789")
