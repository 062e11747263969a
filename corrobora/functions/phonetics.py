"""Spelling-independent keys, spelling variants and native-script romanisation."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.session import stored

# Digits of every Indic block, zero to nine, in block order.
INDIC_DIGITS = "".join(
    chr(base + 0x66 + d)
    for base in (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
    for d in range(10)
)


def normalise_digits(c: Column) -> Column:
    """Native digits rewritten as ASCII digits.

    Texts of single bytes hold none; others are tested for one range of letters around all of the digits, as a set of
    ninety would be gone through for each letter of a text.
    """
    ascii_digits = F.translate(c, INDIC_DIGITS, "0123456789" * 9)
    may = (F.octet_length(c) > F.length(c)) & c.rlike(f"[{INDIC_DIGITS[0]}-{INDIC_DIGITS[-1]}]")
    return F.when(may, ascii_digits).otherwise(c)


# Accented Latin letters with their plain letter, and letters that stand for two.
_ACCENTED = {
    chr(n): base for n in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))
    if "a" <= (base := unicodedata.normalize("NFKD", chr(n))[0]) <= "z" and len(unicodedata.normalize("NFKD", chr(n))) > 1
} | dict(zip("øłđðħŧı", "olddhti"))
_DOUBLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def fold_accents(c: Column) -> Column:
    """Lower-cased text with accented Latin letters made plain and combining marks dropped."""
    k = F.translate(F.lower(c), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    for letter, pair in _DOUBLED.items():
        k = F.replace(k, F.lit(letter), F.lit(pair))
    return F.regexp_replace(k, r"\p{M}", "")


def phonetic_key(c: Column) -> Column:
    """Key shared by the usual spellings of one Latin-script word."""
    k = F.lower(c)
    for pattern, replacement in K.PHONETIC_RULES:
        k = F.regexp_replace(k, pattern, replacement)
    return k


def spelling_variants(c: Column) -> Column:
    """Up to three spellings of a single word, the word itself first."""
    w = F.trim(c)
    head, tail = F.left(w, F.lit(1)), F.right(w, F.length(w) - 1)
    forms = F.array(w, *[F.concat(head, F.regexp_replace(tail, p, r)) for p, r in K.SPELLING_SWAPS])
    forms = F.filter(forms, lambda f: (f == w) | (F.length(f) >= 3))
    plain = (F.length(w) < 4) | w.rlike(r"[\s-]") | w.rlike("[ऀ-ൿ]")
    return F.when(w == "", F.array().cast("array<string>")).when(plain, F.array(w)).otherwise(
        F.slice(F.array_distinct(forms), 1, 3)
    )


# Latin sounds by offset inside an Indic block. Vowels 0x05-0x14, consonants
# 0x15-0x39 and vowel signs 0x3E-0x4C share one layout across the blocks.
_VOWELS = dict(zip(range(0x05, 0x15), "a aa i ii u uu ri li e e e ai o o o au".split()))
_SIGNS = dict(zip(range(0x3E, 0x4D), "aa i ii u uu ri ri e e e ai o o o au".split()))
_CONSONANTS = dict(
    zip(
        range(0x15, 0x3A),
        "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(),
    )
)
_NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
_FLAPS = {0x21: "r", 0x22: "rh", 0x1C: "z", 0x2B: "f"}


def _romanise(word: str) -> str:
    """Romanise one native-script word, dropping the unspoken inherent vowels."""
    units: list[list] = []  # [consonant, vowel, vowel is inherent]
    last = None
    for ch in word:
        code = ord(ch)
        if not 0x0900 <= code <= 0x0D7F:
            units.append([ch, "", False])
            continue
        off = code % 0x80
        if off in _CONSONANTS:
            units.append([_CONSONANTS[off], "a", True])
            last = off
        elif off in _SIGNS and units:
            units[-1][1:] = [_SIGNS[off], False]
        elif off == 0x4D and units:
            units[-1][1:] = ["", False]
        elif off == 0x3C and units:
            units[-1][0] = _FLAPS.get(last, units[-1][0])
        elif off in _VOWELS:
            units.append(["", _VOWELS[off], False])
        elif off in _NASALS:
            units.append([_NASALS[off], "", False])
        elif 0x66 <= off <= 0x6F:
            units.append([str(off - 0x66), "", False])
    for i in range(len(units) - 1, -1, -1):
        if not units[i][2]:
            continue
        final = i == len(units) - 1
        medial = i > 0 and units[i - 1][1] and not final and units[i + 1][0] and units[i + 1][1]
        if final or medial:
            units[i][1] = ""
    return "".join(c + v for c, v, _ in units)


def romanise_column() -> object:
    """Arrow UDF from native-script words to Latin spelling.

    It travels to the workers by value, so they need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    @F.pandas_udf("string")
    def romanise(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else _romanise(w))

    return romanise


def romanise_tokens(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Distinct native-script tokens with their Latin spelling and phonetic key.

    Runs Python once per distinct token rather than once per occurrence; join the
    result back on the token.
    """
    native = tokens.select(F.col(column).alias("token")).where(F.col("token").rlike("[ऀ-ൿ]")).distinct()
    romanise = romanise_column()
    return native.withColumn("latin", romanise("token")).withColumn("key", phonetic_key(F.col("latin")))


def latin_words(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Distinct words of any script as (token, latin, key): accents folded, native-script words romanised.

    The texts behind ``tokens`` are read once, and forms and keys are made once, however often they are joined.
    """
    tokens = stored(tokens.select(F.col(column).alias("token")).distinct())
    native = romanise_tokens(tokens).withColumn("latin", fold_accents(F.col("latin")))
    latin = tokens.where(~F.col("token").rlike("[ऀ-ൿ]"))
    both = latin.withColumn("latin", fold_accents(F.col("token"))).unionByName(native.select("token", "latin"))
    return stored(both.withColumn("key", phonetic_key(F.col("latin"))))
