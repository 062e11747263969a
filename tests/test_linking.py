"""Linking anchors to articles, nothing lost on the way, and the writers."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corrobora.functions.dates import parse_flexible_date
from corrobora.functions.html import strip_tags
from corrobora.functions.text import value_fit
from corrobora.operators import joins as J
from corrobora.operators import scoring as S
from corrobora.operators.anchors import plan_terms
from corrobora.operators.matching import corridor_key, match_anchors
from corrobora.session import fresh_path, values_frame
from corrobora.sources import sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_anchors_by_kind(spark):
    """Each kind by its own rule; common words score pairs but make none."""
    texts = {
        1: "the truck of anil kumar rolled over near green valley",
        2: "kumar was seen near green valley after a crash of a truck",
        3: "kumar said nothing about the truck and the crash",
        4: "shree transport of valley road green lights",
        5: "truck crash truck crash",
        6: "bridgehead watchers gather quietly",
    }
    terms = spark.createDataFrame([(i, w) for i, t in texts.items() for w in sorted(set(t.split()))], "article_id long, term string")
    articles = spark.createDataFrame(
        [(i, ["MH12AB1234"] if i == 3 else [], ["NH48"] if i in (2, 5) else []) for i in texts],
        "article_id long, keys array<string>, corridors array<string>",
    )
    anchors = values_frame(spark, [
        (9, "name", "Anil Kumar"), (9, "name", "Kumar"), (9, "place", "Green Valley"), (9, "org", "Shree Transport"),
        (9, "plate", "mh-12 ab 1234"), (9, "corridor", "NH 48"), (9, "vehicle", "truck"), (9, "incident", "crash"),
        (9, "token", "watchers"), (9, "token", "quietly"), (8, "token", "gather"),
    ], "claim_id long, kind string, value string")
    got = {}
    for r in match_anchors(anchors, articles, terms).collect():
        assert r.claim_id == 9
        got.setdefault(r.article_id, set()).add((r.kind, r.value))
    assert got == {
        1: {("name", "Anil Kumar"), ("name", "Kumar"), ("place", "Green Valley"), ("vehicle", "truck")},
        2: {("name", "Kumar"), ("place", "Green Valley"), ("corridor", "NH 48"), ("vehicle", "truck"), ("incident", "crash")},
        3: {("plate", "mh-12 ab 1234"), ("vehicle", "truck"), ("incident", "crash")},
        4: {("org", "Shree Transport"), ("place", "Green Valley")},
        5: {("corridor", "NH 48"), ("vehicle", "truck"), ("incident", "crash")},
        6: {("token", "watchers"), ("token", "quietly")},
    }
    keys = spark.range(1).select(*[corridor_key(F.lit(x)).alias(x) for x in ("NH-48", "nh 48", "NH48")]).first()
    assert set(keys) == {"NH48"}


def test_a_word_in_most_articles_makes_no_pairs(spark):
    """Terms that nine articles in ten carry are looked up, not fanned out."""
    articles = spark.range(1000).select(
        F.col("id").alias("article_id"),
        F.explode(F.array_compact(F.array(F.when(F.col("id") % 10 > 0, F.lit("common")), F.concat(F.lit("rare"), F.col("id") % 100)))).alias("term"),
    )
    terms = spark.createDataFrame([(c, t) for c in range(20) for t in ("common", f"rare{c}")], "claim_id long, term string")
    got = J.match_terms(terms, articles, 2)
    want = sum(i % 100 < 20 and i % 10 > 0 for i in range(1000))
    assert got.count() == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_signals_need_four_letters_and_an_event(spark):
    rows = [(1, 1, "token", "abc"), (1, 1, "token", "abcd"), (1, 1, "incident", "police"), (1, 2, "incident", "fir"), (1, 3, "incident", "crash")]
    m = spark.createDataFrame(rows, "claim_id long, article_id long, kind string, value string")
    got = {r.article_id: (r.token_hits, r.case_incident) for r in S.match_facts(m).collect()}
    assert got == {1: (1, False), 2: (0, False), 3: (0, True)}


def test_no_claim_is_lost_without_party_or_date(spark):
    rows = [(1, "a", "2024-01-01"), (2, "a", "2024-01-05"), (3, None, "2024-01-01"), (4, "a", None)]
    claims = spark.createDataFrame(rows, "claim_id long, party string, day string")
    got = {r.claim_id: r.prior_claims for r in J.prior_claims(claims, "party", "day").collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None}


def test_a_large_case_is_cut_into_even_chunks(spark):
    cases = spark.createDataFrame([(1,)], "case_id long")
    children = spark.range(20_000).select(F.lit(1).cast("long").alias("case_id"), (F.col("id") % 7).alias("line"), "id")
    got = J.case_detail(cases, {"lines": children}, "case_id", "line", 1000).collect()
    assert sum(r.n_items for r in got) == 20_000 and max(r.n_items for r in got) < 1300


def test_a_null_host_scores_nothing(spark):
    hosts = spark.createDataFrame([("a.example.org",), ("",), (None,)], "host string")
    tiers = values_frame(spark, [("example.org", 24)], "host string, score int")
    assert {r.host: r.domain_score for r in J.domain_score(hosts, "host", tiers).collect()} == {"a.example.org": 24, "": 0, None: 0}


@pytest.mark.parametrize("written, read", [
    ("a &#233;t&#xE9; &#128512; b", "a été 😀 b"), ("&amp;#65; &#0; &#55296; &#1114112; x", "&#65; &#0; &#55296; &#1114112; x"), ("none", "none"),
])
def test_character_references(spark, written, read):
    assert spark.range(1).select(strip_tags(F.lit(written))).first()[0] == read


def test_plates_fit_their_field(spark):
    fit = lambda v: spark.range(1).select(value_fit(F.lit("vehicle_numbers"), F.lit(v))).first()[0]
    assert [fit(v) for v in ("MH 12 AB 1234", "KA-01-1234, MH12AB1234", "not a plate")] == [1.0, 1.0, 0.0]


@pytest.mark.parametrize("text, day", [
    ("on 12/03/2024, at night", "2024-03-12"), ("2024-03-12", "2024-03-12"), ("03.25.24", "2024-03-25"), ("12 March, 2024", "2024-03-12"),
    ("Mar. 12 2024", "2024-03-12"), ("31/02/2024", "2024-03-02"), ("45000", "2023-03-15"), ("12 30 2024", None), ("2024-13-01", None),
    ("call 98765-43210", None), ("13 Smarch 2024", None), (None, None),
])
def test_dates(spark, text, day):
    got = spark.range(1).select(parse_flexible_date(F.lit(text).cast("string"))).first()[0]
    assert (str(got) if got else None) == day


def test_substrings_with_and_without_inner_words(spark):
    articles = spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, "xalpha beta gammay"), (3, "beta"), (4, "alphabeta")], "article_id long, text string")
    needles = spark.createDataFrame([(1, "alpha beta gamma"), (1, "lpha bet"), (1, "bet"), (1, "be"), (1, "zeta")], "claim_id long, value string")
    got = {(r.value, r.article_id) for r in J.match_substring(needles, articles).collect()}
    assert got == {("alpha beta gamma", 1), ("alpha beta gamma", 2), ("lpha bet", 1), ("lpha bet", 2)} | {("bet", i) for i in (1, 2, 3, 4)}


def test_the_last_resort_comes_last(spark):
    anchors = values_frame(spark, [(1, "plate", "MH12AB1234", 0), (1, "token", "bridge", 0), (2, "token", "bridge", 0), (3, "incident", "police", 0)],
                           "claim_id long, kind string, value string, ordinal int")
    got = {}
    for r in plan_terms(anchors).collect():
        got.setdefault(r.claim_id, set()).add(r.query)
    assert "bridge accident" not in got[1] and got[2] == {"bridge accident"} and 3 not in got


def test_writers(spark):
    df = spark.createDataFrame([(1, 'a "b"'), (2, None)], "id long, text string")
    paths = [fresh_path(spark, "sink") for _ in range(3)]
    sinks.write_csv(df, paths[0])
    sinks.write_json(df, paths[1])
    sinks.write_parquet(df, paths[2], ["id"])
    assert spark.read.option("header", True).option("escape", "\\").csv(paths[0]).count() == 2
    assert {(r.id, r.text) for r in spark.read.schema("id long, text string").json(paths[1]).collect()} == {(1, 'a "b"'), (2, None)}
    assert sorted(os.path.basename(p) for p in os.listdir(paths[2]) if "=" in p) == ["id=1", "id=2"]


def test_romanising_needs_no_package_on_the_workers(tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from corrobora.session import build_session\n"
        "from corrobora.functions.phonetics import romanise_tokens\n"
        "s = build_session('away', 'local[1]', **{'spark.ui.enabled': 'false'})\n"
        "rows = romanise_tokens(s.createDataFrame([('जयपुर',)], 'token string')).collect()\n"
        "assert rows[0].latin and rows[0].key, rows\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-1500:]


def test_few_needles_are_tested_in_place(spark, monkeypatch):
    articles = spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, "xalpha beta gammay"), (3, "beta"), (4, None)], "article_id long, text string")
    needles = spark.createDataFrame([(1, "alpha beta gamma"), (1, "lpha bet"), (2, "bet"), (2, "zeta"), (3, "bet")], "claim_id long, value string")
    rows = lambda df: sorted((r.claim_id, r.value, r.article_id) for r in df.collect())
    few = J.match_substring(needles, articles)
    assert "regexp_extract_all" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(J, "FEW_NEEDLES", 0)
    many = J.match_substring(needles, articles)
    assert "regexp_extract_all" in many._jdf.queryExecution().optimizedPlan().toString()
    assert rows(few) == rows(many) and (3, "bet", 2) in rows(few)
