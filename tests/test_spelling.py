"""Words across scripts and spellings, and pairs that fan out no further than their rarer term."""

from pyspark.sql import functions as F

from corrobora.operators import joins, matching, spelling
from corrobora.session import values_frame

TERMS = "article_id INT, term STRING"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ways_of_agreement(spark):
    """Alike before sound before one edit; short words and short keys only agree when written alike."""
    articles = values_frame(
        spark, [(1, "रमेश"), (2, "ramesh"), (3, "raamesh"), (4, "édith"), (5, "abc"), (6, "kirloskarvadi"), (7, "kirloskarbadi"), (8, "other")], TERMS)
    wanted = values_frame(spark, [("ramesh",), ("edith",), ("abd",), ("kirloskarvadi",)], "term STRING")
    assert rows(spelling.spelled_terms(wanted, articles)) == [
        (1, "ramesh", 1), (2, "ramesh", 1), (3, "ramesh", 2), (4, "edith", 1), (6, "kirloskarvadi", 1), (7, "kirloskarvadi", 3)]
    assert spelling.spelled_terms(wanted.where("false"), articles).count() == 0


def test_latin_anchor_meets_native_article(spark):
    anchors = values_frame(spark, [("c", "name", "Ramesh Patil"), ("c", "place", "Nagpur"), ("c", "incident", "ramesh")], "claim_id STRING, kind STRING, value STRING")
    terms = values_frame(spark, [(1, "रमेश"), (1, "पाटिल"), (2, "नागपुर"), (3, "ramesh"), (3, "nagpur")], TERMS)
    articles = terms.select("article_id").distinct().select(
        "article_id", F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("corridors"))
    plain = rows(matching.match_anchors(anchors, articles, terms))
    spelled = rows(matching.match_anchors(anchors, articles, terms, spelled=True))
    assert plain == [("c", 3, "incident", "ramesh"), ("c", 3, "place", "Nagpur")]
    assert spelled == sorted([*plain, ("c", 1, "name", "Ramesh Patil"), ("c", 2, "place", "Nagpur")])


def test_a_common_word_makes_no_candidates(spark):
    """A name in most articles and a place in few: candidates come from the place, and the other way round."""
    terms = spark.range(1000).select(
        F.col("id").alias("article_id"),
        F.explode(F.when(F.col("id") % 10 > 0, F.array(F.lit("singh"))).otherwise(F.array().cast("array<string>"))).alias("term"),
    ).unionByName(spark.range(3).select((F.col("id") + 5).alias("article_id"), F.lit("rarepur").alias("term")))
    pairs = values_frame(spark, [("c", "singh", "rarepur"), ("d", "rarepur", "singh"), ("e", "singh", "nowhere")], "claim_id STRING, a STRING, b STRING")
    probes = joins.rarer_first(pairs, "a", "b", terms)
    assert rows(probes.select("claim_id", "_first", "_second")) == [("c", "rarepur", "singh"), ("d", "rarepur", "singh")]
    names = values_frame(spark, [("c", "Singh", "singh")], "claim_id STRING, name STRING, term STRING")
    places = values_frame(spark, [("c", "rarepur")], "claim_id STRING, term STRING")
    assert rows(joins.match_names(names, terms, places)) == [("c", "Singh", i, 1) for i in (5, 6, 7)]
