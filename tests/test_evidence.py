"""Scores on full pages and the adaptive search, on a fixture where each pass finds what the one before could not."""

import datetime

import pytest
from harness import SMALL
from pyspark.sql import functions as F

from corrobora.plans import catalog
from corrobora.plans import evidence as E
from corrobora.session import values_frame

DAY = datetime.date(2024, 5, 1)


def read(texts):
    """Article rows of the fixture: plates are words of letters and digits, and nothing else is known."""
    keys = F.transform(F.regexp_extract_all("text", F.lit(r"[A-Z]{2}\d{2}[A-Z]{2}\d{4}"), 0), lambda k: k)
    none = F.array().cast("array<string>")
    return texts.select(
        "article_id", keys.alias("keys"), none.alias("corridors"), F.lit(DAY).alias("publish_day"), none.alias("dates"),
        F.array().cast("array<int>").alias("figures"), F.lit(12).alias("domain_score"), F.lower("text").contains("accident").alias("generic_incident"),
        F.lit(False).alias("social"),
    )


@pytest.fixture(scope="module")
def sides(spark):
    anchors = values_frame(spark, [
        ("plate", "plate", "MH12AB1234"), ("plate", "place", "Poladpur"), ("plate", "incident", "accident"),
        ("named", "name", "Ramesh Patil"), ("grown", "token", "lorry"), ("grown", "token", "ghat"), ("lone", "token", "elephant"), ("lone", "token", "absent"),
    ], "claim_id STRING, kind STRING, value STRING")
    claims = anchors.select("claim_id").distinct().select("claim_id", F.lit(DAY).alias("loss_date"), F.lit(None).cast("int").alias("target_count"))
    shown = [
        (1, "Accident near Poladpur"), (2, "Ramesh Patil hurt"), (3, "A lorry in the ghat near Khambatki Tunnel with Khambatki Tunnel shut"),
        (4, "News of Khambatki Tunnel"), (5, "An elephant"), (6, "Poladpur weather accident"),
    ]
    pages = [(1, "Accident near Poladpur. The car MH12AB1234 fell."), (6, "Poladpur weather and an accident film"), (3, "A lorry in the ghat")]
    index = values_frame(spark, [(i, i, t) for i, t in shown], "article_id INT, url_key INT, text STRING")
    return anchors, claims, index, values_frame(spark, pages, "url_key INT, full_text STRING")


def test_full_pages_raise_the_band(sides):
    anchors, claims, index, pages = sides
    articles = read(index.select("article_id", "text"))
    matches = E.match_anchors(anchors, articles, E.article_tokens(index, "article_id", "text"))
    scored = E.score_matches(matches, claims, E.facts_only(articles)).join(index.select("article_id", "url_key"), "article_id")
    first = {(r.claim_id, r.article_id): r.band for r in scored.collect()}
    assert first[("plate", 1)] == "STRONG" and first[("named", 2)] == "CONFIRMED"
    got = {(r.claim_id, r.article_id): r for r in E.rescore_enriched(anchors, claims, matches, scored, pages, read).collect()}
    assert set(got) == {("plate", 1), ("plate", 6), ("grown", 3)}  # confirmed rows are not read, nor rows without a page
    up = got[("plate", 1)]
    assert (up.first_band, up.band) == ("STRONG", "CONFIRMED") and up.score == up.first_score + 45
    assert got[("plate", 6)].band == got[("plate", 6)].first_band == "STRONG"


def test_adaptive_search(sides):
    anchors, claims, index, pages = sides
    rows = {(r.claim_id, r.article_id): r for r in E.adaptive_match(anchors, claims, index, pages, read).collect()}
    assert (rows[("plate", 1)].round, rows[("plate", 1)].band, rows[("plate", 1)].rank) == ("enrich", "CONFIRMED", 1)
    assert rows[("named", 2)].round == "precise"
    assert rows[("grown", 4)].round == "harvest"  # two new words, taken from article 3
    assert ("lone", 5) not in rows or rows[("lone", 5)].score >= 10
    assert {k[1] for k in rows if k[0] == "named"} == {2}  # a confirmed claim is not searched on


def test_widening_needs_one_word_and_a_lower_floor(spark, sides):
    anchors, claims, _, pages = sides
    index = values_frame(spark, [(5, 5, "An elephant accident"), (7, 7, "nothing")], "article_id INT, url_key INT, text STRING")
    rows = E.adaptive_match(anchors.where("claim_id = 'lone'"), claims, index, pages, read).collect()
    assert [(r.claim_id, r.article_id, r.round) for r in rows] == [("lone", 5, "widen")] and rows[0].score >= 10


def test_adaptive_search_of_the_tables_confirms_no_less(spark):
    """Bands of the adaptive search are at least those of the first pass, and every row has its round."""
    got = catalog.QUERIES["rp3_adaptive_match"](spark, SMALL).collect()
    assert {r.round for r in got} <= {"precise", "harvest", "widen", "enrich"} and any(r.round == "enrich" for r in got)
    assert all(r.rank <= 60 for r in got)
