"""Vocabulary of several words and scripts found in texts: an index of phrases by their first word.

Each word of a text is joined to the phrases that begin with it, with the words behind it at hand, so a phrase is
verified where it starts and nothing else is looked up. A phrase that stands inside a longer one does not count.
Words of Indic scripts take endings, so the last word of a native phrase also matches longer words that begin with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.text import let
from corrobora.session import broadcast_checked

NATIVE = "[ऀ-ൿ]"
# Code points from which on a native word may carry an ending.
STEM_LETTERS = 3


def phrase_words(c: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")


def _phrases(vocabulary: DataFrame) -> DataFrame:
    ws = vocabulary.select(F.lower("term").alias("term"), "lang", "canon", phrase_words(F.col("term")).alias("ws")).where(F.size("ws") > 0)
    last = F.element_at("ws", -1)
    return ws.distinct().select(
        "term", "lang", "canon", F.get("ws", 0).alias("word"), F.slice("ws", 2, 1000).alias("rest"), F.size("ws").alias("n_words"),
        (last.rlike(NATIVE) & (F.length(last) >= STEM_LETTERS)).alias("stem"),
    )


def tag_phrases(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, pos, n_words, term, lang, canon): where phrases of ``vocabulary`` (term, lang, canon) stand in each text.

    ``pos`` counts words from 0. Of several phrases at one place the longest counts, and none inside a longer one;
    equal phrases of several languages all count. A null text has none.
    """
    phrases = _phrases(vocabulary)
    longest = phrases.agg(F.coalesce(F.max("n_words"), F.lit(1))).first()[0]
    spots = let(
        phrase_words(F.col(text)),
        lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), w.alias("word"), F.slice(ws, i + 2, F.lit(max(longest - 1, 1))).alias("next"))),
    )
    each = df.select(key, F.inline(spots))
    more = F.col("n_words") - 1
    alike = F.slice("next", F.lit(1), more) == F.col("rest")
    ended = (
        F.col("stem") & (F.size("next") >= more) & (F.slice("next", F.lit(1), more - 1) == F.slice("rest", F.lit(1), more - 1))
        & F.startswith(F.get("next", more - 1), F.get("rest", more - 1))
    )
    out = [key, "pos", "n_words", "term", "lang", "canon"]
    found = each.join(broadcast_checked(phrases), "word").where(F.when(more == 0, True).otherwise(alike | ended)).select(out)
    # Single native words by their beginnings: made once for each distinct word, and only where there are such phrases.
    stems = phrases.where("stem AND n_words = 1").withColumnRenamed("word", "head")
    native = each.where(F.col("word").rlike(NATIVE) & (F.length("word") > STEM_LETTERS)).select(key, "pos", "word")
    heads = native.select("word").distinct().select(
        "word", F.explode(F.transform(F.sequence(F.lit(STEM_LETTERS), F.length("word") - 1), lambda n: F.left(F.col("word"), n))).alias("head"))
    inflected = heads.join(broadcast_checked(stems), "head").select("word", "n_words", "term", "lang", "canon")
    rows = found.unionByName(native.join(inflected, "word").select(out)).repartition(key)
    here = Window.partitionBy(key, "pos")
    before = Window.partitionBy(key).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n_words")
    return (
        rows.withColumn("_most", F.max("n_words").over(here)).where("n_words = _most")
        .withColumn("_end", F.coalesce(F.max(end).over(before), F.lit(0))).where(end > F.col("_end")).select(out)
    )
