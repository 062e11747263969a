"""Anchors of any kind matched to articles: what the full relevance score is computed from.

Identity and place anchors make the candidate pairs: plates and corridors by key, names by two
tokens or one and a place, companies, places, stations and hospitals by all their words. Two free
tokens make a candidate as well. Incident words, vehicles and single tokens are too common to make
pairs, so they are looked up in the candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.identifiers import identifier_key
from corrobora.operators.joins import match_names, match_terms
from corrobora.operators.spelling import spelled_terms
from corrobora.session import broadcast_checked, cut_lineage, stored

PHRASES = ["org", "place", "police_station", "hospital"]
# Kinds whose words may be written in another script or spelling.
SPELLED = ["name", *PHRASES]
COMMON = ["vehicle", "incident", "token"]


def corridor_key(c: Column) -> Column:
    """A road or landmark without blanks and dashes: NH-48, NH 48 and nh48 are one."""
    return identifier_key(c)


def _words(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(value), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def match_phrases(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs in which the article has every word of the phrase, as (claim_id, kind, value, article_id).

    The phrase's rarest word makes the candidates; the others are looked up in them.
    """
    phrase = ["claim_id", "kind", "value"]
    listed = phrases.select(*phrase, F.explode(_words(F.col("value"))).alias("term"))
    use = terms.join(listed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_df"))
    counted = listed.join(use, "term", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    rarest = counted.groupBy(*phrase).agg(F.min_by("term", F.struct("_df", "term")).alias("term"), F.count("*").alias("_n"))
    found = rarest.join(terms, "term").select(*phrase, "_n", "article_id", F.col("term").alias("_rarest"))
    single = found.where("_n = 1").select(*phrase, "article_id")
    more = (
        found.where("_n > 1").join(listed, phrase).where(F.col("term") != F.col("_rarest")).join(terms, ["article_id", "term"])
        .groupBy(*phrase, "_n", "article_id").agg(F.count("*").alias("_hits")).where(F.col("_hits") == F.col("_n") - 1)
    )
    return single.unionByName(more.select(*phrase, "article_id"))


def match_anchors(anchors: DataFrame, articles: DataFrame, terms: DataFrame, spelled: bool = False) -> DataFrame:
    """Matched anchors (claim_id, article_id, kind, value), distinct.

    ``anchors`` is (claim_id, kind, value); ``articles`` has article_id and the arrays ``keys`` (identifier
    keys) and ``corridors`` (corridor keys); ``terms`` is (article_id, term), distinct, lower case. With ``spelled`` the
    words of people, companies and places match in any script and spelling; plates, roads and common words never do.
    """
    # Each is read by every kind of match, and costs much more to make than to store.
    anchors, terms = cut_lineage(anchors.select("claim_id", "kind", "value")), terms.select("article_id", "term")
    if spelled:
        terms = cut_lineage(terms)
    else:
        # Only words that some anchor has are stored.
        held = F.array_append(_words(F.col("value")), F.lower("value"))
        wanted = stored(anchors.where("value IS NOT NULL").select(F.explode(held).alias("term")).distinct())
        terms = stored(terms.join(broadcast_checked(wanted), "term", "left_semi").select("article_id", "term"))
    articles = cut_lineage(articles.select("article_id", "keys", "corridors"))
    of = lambda *kinds: anchors.where(F.col("kind").isin(*kinds)).select("claim_id", "kind", "value").distinct()
    out = ["claim_id", "article_id", "kind", "value"]

    def by_key(kind: str, key: Column, listed: str) -> DataFrame:
        carried = articles.select("article_id", F.explode(F.array_distinct(listed)).alias("_key"))
        return of(kind).withColumn("_key", key).join(carried, "_key").select(out)

    names_of = terms
    if spelled:
        wanted = of(*SPELLED).select(F.explode(_words(F.col("value"))).alias("term"))
        names_of = cut_lineage(spelled_terms(wanted, terms).select("article_id", "term"))
    plates = by_key("plate", identifier_key(F.col("value")), "keys")
    corridors = by_key("corridor", corridor_key(F.col("value")), "corridors")
    phrases = match_phrases(of(*PHRASES), names_of).select(out)
    places = of("place").select("claim_id", F.explode(_words(F.col("value"))).alias("term")).distinct()
    names = of("name").select("claim_id", F.col("value").alias("name"), F.explode(_words(F.col("value"))).alias("term"))
    named = match_names(names, names_of, places).select("claim_id", "article_id", F.lit("name").alias("kind"), F.col("name").alias("value"))
    strong = plates.unionByName(corridors).unionByName(phrases).unionByName(named)

    word = lambda kinds: of(*kinds).withColumn("term", F.lower("value"))
    two_tokens = match_terms(word(["token"]).select("claim_id", "term").distinct(), terms, 2).select("claim_id", "article_id")
    pairs = strong.select("claim_id", "article_id").union(two_tokens).distinct()
    common = pairs.join(word(COMMON), "claim_id").join(terms, ["article_id", "term"]).select(out)
    return strong.unionByName(common).distinct()


def match_tokens(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Matched free tokens (claim_id, article_id, kind, value) of pairs that share two of a claim's ``tokens``."""
    words = tokens.select("claim_id", "value", F.lower("value").alias("term")).distinct()
    pairs = match_terms(words.select("claim_id", "term").distinct(), terms, 2).select("claim_id", "article_id")
    return pairs.join(words, "claim_id").join(terms, ["article_id", "term"]).select(
        "claim_id", "article_id", F.lit("token").alias("kind"), "value")
