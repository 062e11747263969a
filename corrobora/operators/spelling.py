"""One index of the ways a word can be written: matching across scripts and spellings.

A word is folded (accents off) or romanised (Indic scripts) to Latin letters and carries a phonetic key. Two words are
the same if they are written alike, else if their keys are equal, else if their keys are one edit apart. All three are
equality joins: on the Latin form, on the key, and on the forms of the key with one letter deleted.

Everything is done on distinct words, and only words that some claim asks for go back to the articles. What comes out
looks like an article's own terms, in the claims' spelling, so every match that works on terms works across scripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.phonetics import latin_words
from corrobora.operators.joins import match_one_edit
from corrobora.session import broadcast_checked, stored

# Ways of agreement, best first.
EXACT, SOUND, EDIT = 1, 2, 3
# Letters a word and its key need before sound counts, and a key before an edit is forgiven.
SOUND_LETTERS = 4
EDIT_LETTERS = 7


def word_forms(words: DataFrame) -> DataFrame:
    """(word, latin, key): distinct words of any script with their Latin form and phonetic key."""
    return latin_words(words, "word").withColumnRenamed("token", "word")


def same_words(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word, how): each word of ``vocabulary`` (word, latin, key) that is one of the ``wanted`` (word, latin, key).

    ``how`` is the best way of agreement. Words or keys too short for a way take no part in it.
    """
    term = wanted.select(F.col("word").alias("term"), "latin", "key")
    exact = term.join(vocabulary.select("word", "latin"), "latin").where(F.col("latin") != "").select("term", "word", F.lit(EXACT).alias("how"))
    heard = lambda df, c: df.where((F.length("latin") >= SOUND_LETTERS) & (F.length("key") >= SOUND_LETTERS)).select(c, "key")
    terms, words = heard(term, "term"), heard(vocabulary, "word")
    sound = terms.join(words, "key").select("term", "word", F.lit(SOUND).alias("how"))
    near = match_one_edit(terms.select("key"), words.select("key"), EDIT_LETTERS).where("edits = 1").select("a", "b")
    edit = (
        near.join(terms.withColumnRenamed("key", "a"), "a").join(words.withColumnRenamed("key", "b"), "b")
        .select("term", "word", F.lit(EDIT).alias("how"))
    )
    return exact.unionByName(sound).unionByName(edit).groupBy("term", "word").agg(F.min("how").alias("how"))


def spelled_terms(wanted: DataFrame, article_terms: DataFrame) -> DataFrame:
    """(article_id, term, how): which of the ``wanted`` terms (a column ``term``) an article has in any spelling or script.

    ``article_terms`` is (article_id, term). The best way of agreement in the article counts. The articles are read
    twice: for their distinct words, and for those that are wanted.
    """
    asked = word_forms(wanted.select(F.col("term").alias("word")).distinct())
    vocabulary = word_forms(article_terms.select(F.col("term").alias("word")).distinct())
    same = broadcast_checked(stored(same_words(asked, vocabulary)))
    return (
        article_terms.withColumnRenamed("term", "word").join(same, "word")
        .groupBy("article_id", "term").agg(F.min("how").alias("how"))
    )
