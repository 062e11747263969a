"""End-to-end plans: top evidence, the full score, and the adaptive re-match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.text import SEARCH_TOKEN
from corrobora.operators import aggregates as A
from corrobora.operators.joins import enrich
from corrobora.operators.matching import match_anchors, match_tokens
from corrobora.operators.ranking import band_rank, rank_evidence
from corrobora.operators.scoring import match_facts, score_evidence
from corrobora.session import cut_lineage

# What the score reads of an article.
FACTS = ["publish_day", "dates", "figures", "domain_score", "generic_incident", "social"]


def article_tokens(articles: DataFrame, key: str, text: str) -> DataFrame:
    """(article_id, term): each article's distinct tokens, made without a shuffle.

    Stopwords need no filter here: no claim term is one, so they never join.
    """
    toks = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(SEARCH_TOKEN), 0))
    return articles.select(F.col(key).alias("article_id"), F.explode(toks).alias("term"))


def score_matches(matches: DataFrame, claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Full relevance score of matched anchors.

    ``matches`` is (claim_id, article_id, kind, value); ``claims`` is (claim_id,
    loss_date, target_count); ``articles`` carries one small row per article:
    article_id, publish_day, dates (ISO days named in its text), figures,
    domain_score, generic_incident, social. Texts never enter the join.
    """
    window = F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda i: F.date_add("loss_date", i).cast("string"))
    joined = match_facts(matches).join(claims, "claim_id").join(articles, "article_id")
    return score_evidence(
        joined.withColumns(
            {
                "incident_hit": F.col("case_incident") | F.col("generic_incident"),
                "gap_days": F.datediff("publish_day", "loss_date"),
                "claim_dated": F.col("loss_date").isNotNull(),
                "undated": F.col("publish_day").isNull(),
                "date_verbatim": F.coalesce(F.arrays_overlap(window, "dates"), F.lit(False)),
            }
        )
    )


def top_evidence(anchors: DataFrame, claims: DataFrame, articles: DataFrame, terms: DataFrame, k: int = K.RANK_LIMIT) -> DataFrame:
    """The first ``k`` articles per claim by band and score: anchors matched, scored in full, ranked.

    ``articles`` has what :func:`match_anchors` and :func:`score_matches` read of each; ``terms`` is (article_id, term).
    """
    return rank_evidence(score_matches(match_anchors(anchors, articles, terms), claims, facts_only(articles)), k)


def facts_only(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", *FACTS)


def rescore_enriched(
    anchors: DataFrame, claims: DataFrame, matches: DataFrame, scored: DataFrame, pages: DataFrame,
    read: Callable[[DataFrame], DataFrame], top: int = 12,
) -> DataFrame:
    """The first ``top`` open rows of each claim scored again with the full text of their pages.

    Open are rows that are neither CONFIRMED nor social. Only their pages are tokenised, by ``read``, which makes an
    article row from (article_id, text); only their claims' anchors are matched to them. What the index had matched
    (``matches``) and what the page adds are merged by anchor before the score, so nothing found before is lost.
    ``pages`` is (url_key, full_text), ``scored`` has a url_key. A row without a page keeps its score.
    Returns the columns of ``scored`` with ``first_score`` and ``first_band``, for rows that have a page.
    """
    wanted = cut_lineage(enrich(scored, pages, top).where("full_text IS NOT NULL").select(
        "claim_id", "article_id", "url_key", "full_text", F.col("score").alias("first_score"), F.col("band").alias("first_band")))
    pairs = wanted.select("claim_id", "article_id")
    texts = cut_lineage(wanted.groupBy("article_id").agg(F.max("full_text").alias("text")))
    fresh = read(texts)
    asked = anchors.join(pairs.select("claim_id").distinct(), "claim_id", "left_semi")
    found = match_anchors(asked, fresh, article_tokens(texts, "article_id", "text"))
    both = matches.select("claim_id", "article_id", "kind", "value").unionByName(found)
    merged = both.join(pairs, ["claim_id", "article_id"], "left_semi").distinct()
    again = score_matches(merged, claims, facts_only(fresh))
    return again.join(wanted.drop("full_text"), ["claim_id", "article_id"])


def _best_bands(scored: DataFrame) -> DataFrame:
    return scored.groupBy("claim_id").agg(F.min(band_rank(F.col("band"))).alias("best"))


def adaptive_match(
    anchors: DataFrame, claims: DataFrame, index: DataFrame, pages: DataFrame, read: Callable[[DataFrame], DataFrame],
    k: int = K.RANK_LIMIT, rounds: int = 2,
) -> DataFrame:
    """Match, and search on for claims that nothing confirms: harvest new terms, widen, read full pages.

    ``index`` is (article_id, url_key, text): what a search shows of each article; ``pages`` is (url_key, full_text).
    A pass works on open claims only, that is without a CONFIRMED row, and adds to the matches found so far; a page is
    read once for a claim. Passes repeat until no claim's best band changes, ``rounds`` times at most. ``round`` tells the pass that found a pair:
    precise, harvest, widen (one word is enough, for claims without any row, at a lower floor) or enrich.
    """
    out = ["claim_id", "article_id", "kind", "value"]
    articles = cut_lineage(read(index.select("article_id", "text")).join(index.select("article_id", "url_key"), "article_id"))
    terms = cut_lineage(article_tokens(index, "article_id", "text"))
    score = lambda m: cut_lineage(
        score_matches(m.select(out), claims, facts_only(articles)).join(articles.select("article_id", "url_key"), "article_id"))
    matches = cut_lineage(match_anchors(anchors, articles, terms).withColumn("round", F.lit("1precise")))
    scored, read_rows = score(matches), None
    pair = ["claim_id", "article_id"]
    over = lambda rows, better: rows.join(better.select(pair), pair, "left_anti").unionByName(better)
    for _ in range(rounds):
        before = cut_lineage(_best_bands(scored))
        confirmed = before.where("best = 1").select("claim_id")
        open_anchors = anchors.join(confirmed, "claim_id", "left_anti")

        leading = rank_evidence(scored.join(confirmed, "claim_id", "left_anti"), k).where("rank <= 20")
        known = anchors.select("claim_id", "value").unionByName(matches.select("claim_id", "value").distinct())
        new = A.harvest_terms(leading.join(index.select("article_id", "text"), "article_id"), known, "text").select(
            "claim_id", F.lit("token").alias("kind"), F.explode(F.split(F.lower("term"), r"\s+")).alias("value")).distinct()
        grown = open_anchors.where("kind = 'token'").select("claim_id", "kind", "value").unionByName(new).distinct()
        grown = cut_lineage(grown.join(new.select("claim_id").distinct(), "claim_id", "left_semi"))
        harvested = match_tokens(grown, terms).withColumn("round", F.lit("2harvest"))

        empty = open_anchors.join(before.select("claim_id"), "claim_id", "left_anti").where("kind = 'token'")
        single = empty.select("claim_id", "kind", "value", F.lower("value").alias("term")).join(terms, "term").select(out)
        widened = single.withColumn("round", F.lit("3widen"))

        more = matches.unionByName(harvested).unionByName(widened).groupBy(out).agg(F.min("round").alias("round"))
        matches = cut_lineage(more)
        scored = score(matches)

        if read_rows is not None:
            scored = cut_lineage(over(scored, read_rows))
        open_rows = scored.join(_best_bands(scored).where("best = 1").select("claim_id"), "claim_id", "left_anti")
        if read_rows is not None:
            open_rows = open_rows.join(read_rows.select(pair), pair, "left_anti")
        again = cut_lineage(rescore_enriched(anchors, claims, matches, open_rows, pages, read).drop("first_score", "first_band"))
        scored = cut_lineage(over(scored, again))
        read_rows = again if read_rows is None else read_rows.unionByName(again)
        changed = _best_bands(scored).join(before.withColumnRenamed("best", "was"), "claim_id", "left").where("was IS NULL OR best != was")
        if changed.isEmpty():
            break
    first = matches.groupBy("claim_id", "article_id").agg(F.min("round").alias("round"))
    full = read_rows.select(*pair, F.lit("enrich").alias("_read"))
    told = scored.join(first, pair, "left").join(full, pair, "left")
    told = told.withColumn("round", F.coalesce("_read", F.substring("round", 2, 100))).drop("_read")
    return rank_evidence(told.where((F.col("round") != "widen") | (F.col("score") >= K.SCORE_FLOOR_WIDENED)), k)
