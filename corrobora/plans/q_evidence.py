"""Registered queries: the way from anchors to ranked evidence, its re-scoring on full pages, and the adaptive search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.plans import evidence as E
from corrobora.plans import report as RP
from corrobora.plans.q_scoring import ITEM_TOP_SQL, _CODES_SQL, _OK, _TOK, read_articles, rendered_anchors, score_sides
from corrobora.plans.registry import query
from corrobora.plans.roles import inlist
from corrobora.sources.tables import load

# What a search shows of an article is its first line; its page holds the whole text.
_SHOWN_SQL = "split_part(text, chr(10), 1)"

_CLAIM_SQL = f"""{ITEM_TOP_SQL}, tp AS (SELECT claim_id, list(term ORDER BY ordinal) AS t FROM item_top GROUP BY 1),
ph AS (SELECT claim_id, 'name' AS kind, t[1] || ' ' || t[2] AS value, t[1] AS x, t[2] AS y FROM tp UNION ALL SELECT claim_id, 'org', t[4] || ' ' || t[5], t[4], t[5] FROM tp UNION ALL SELECT claim_id, 'place', t[3], t[3], t[3] FROM tp),
plates AS (SELECT doc_id AS claim_id, unnest({_CODES_SQL}) AS code FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark))"""


def _matches_sql(name: str, text: str) -> str:
    """CTEs of the anchors matched in ``text`` of each document: strong ones make pairs, common ones join them."""
    return f"""{name}_tok AS MATERIALIZED (SELECT DISTINCT doc_id AS article_id, lower(t[i]) AS term FROM (SELECT doc_id, {_TOK.replace('text', text)} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i) WHERE {_OK}),
{name}_codes AS (SELECT doc_id AS article_id, unnest({_CODES_SQL.replace('text', text)}) AS code FROM documents),
{name}_strong AS MATERIALIZED (SELECT p.claim_id, a.article_id, kind, value FROM ph p JOIN {name}_tok a ON a.term = p.x JOIN {name}_tok b ON b.term = p.y AND b.article_id = a.article_id
  UNION SELECT claim_id, article_id, 'plate', code FROM plates JOIN {name}_codes USING (code)
  UNION SELECT item_id, doc_id, 'corridor', concat('NH ', item_id % 50) FROM benchmark JOIN documents ON doc_id % 70 = item_id % 50),
{name}_pairs AS (SELECT claim_id, article_id FROM {name}_strong UNION SELECT claim_id, article_id FROM item_top JOIN {name}_tok USING (term) WHERE ordinal IN (7, 8) GROUP BY ALL HAVING count(*) = 2),
{name} AS MATERIALIZED (SELECT * FROM {name}_strong UNION SELECT claim_id, article_id, CASE ordinal WHEN 5 THEN 'vehicle' WHEN 6 THEN 'incident' ELSE 'token' END, term FROM {name}_pairs JOIN item_top USING (claim_id) JOIN {name}_tok USING (article_id, term) WHERE ordinal >= 5)"""


def _scores_sql(name: str, matches: str, text: str) -> str:
    """CTEs that score and band the pairs of ``matches`` by the rules of the relevance score."""
    return f"""{name}_f AS (SELECT m.claim_id, m.article_id, bool_or(kind = 'plate') AS plate, bool_or(kind = 'name') AS nam, bool_or(kind = 'org') AS org, list(DISTINCT value) FILTER (WHERE kind = 'place' AND length(value) >= 4) AS pl,
  count(*) FILTER (WHERE kind = 'corridor') AS corr, bool_or(kind = 'incident' AND length(value) >= 4 AND value NOT IN {inlist(K.NON_EVENT_TERMS)}) AS inc, count(*) FILTER (WHERE kind = 'vehicle') AS veh,
  count(*) FILTER (WHERE kind = 'token' AND length(value) >= 4) AS tok FROM {matches} m GROUP BY ALL),
{name}_g AS (SELECT f.*, coalesce(len(list_filter(pl, lambda p: len(list_filter(pl, lambda o: length(o) > length(p) AND contains(o, p))) = 0)), 0) AS places,
  CASE WHEN claim_id % 5 > 0 THEN DATE '2024-01-01' + CAST(claim_id % 30 AS INT) END AS loss, CASE WHEN doc_id % 3 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 90 AS INT) END AS pub, claim_id % 4 AS target,
  CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 + 1 END AS fig, CASE doc_id % 7 WHEN 1 THEN 30 WHEN 2 THEN 24 WHEN 3 THEN 18 ELSE 12 END AS dom, inc OR regexp_matches({text}, '(?i)({'|'.join(K.GENERIC_INCIDENT)})') AS ihit,
  doc_id % 10 = 0 AS social, {text} AS txt FROM {name}_f f JOIN documents ON doc_id = article_id),
{name}_h AS (SELECT *, abs(date_diff('day', loss, pub)) AS gap, loss IS NOT NULL AND len(list_filter(range(-1, 3), lambda i: contains(txt, CAST(loss + CAST(i AS INT) AS VARCHAR)))) > 0 AS verb FROM {name}_g),
{name}_s AS (SELECT *, greatest(0, least(100, CAST(floor(CASE WHEN plate THEN {K.W_PLATE} ELSE 0 END + CASE WHEN nam THEN {K.W_NAME} ELSE 0 END + CASE WHEN org THEN {K.W_ORG} ELSE 0 END + least(places * {K.W_PLACE}, {K.W_PLACE_MAX}) + corr * {K.W_CORRIDOR}
  + CASE WHEN ihit THEN {K.W_INCIDENT} ELSE {K.W_NO_INCIDENT} END + veh * {K.W_VEHICLE} + coalesce(CASE WHEN gap <= 2 THEN {K.W_GAP_2_DAYS} WHEN gap <= 7 THEN {K.W_GAP_7_DAYS} WHEN gap <= 45 THEN {K.W_GAP_45_DAYS} WHEN gap > 45 THEN {K.W_GAP_FAR} END, 0)
  + CASE WHEN verb THEN {K.W_DATE_VERBATIM} ELSE 0 END + least(tok * {K.W_TOKEN}, {K.W_TOKEN_MAX}) + CASE WHEN target > 0 AND fig IS NOT NULL THEN CASE WHEN fig = target THEN {K.W_COUNT_AGREES} ELSE {K.W_COUNT_CONFLICT} END ELSE 0 END
  + dom * {K.W_DOMAIN} + 0.5) AS INT))) AS score, verb OR coalesce(gap <= 7, false) AS dhit, plate OR nam OR org AS specific, social AND NOT plate AND (nam OR org) AS soft
  FROM {name}_h WHERE NOT social OR plate OR nam OR org OR (places > 0 AND (ihit OR veh > 0))),
{name} AS MATERIALIZED (SELECT claim_id, article_id, score, social, CASE WHEN specific AND NOT soft THEN 'CONFIRMED' WHEN soft THEN 'STRONG'
  WHEN places > 0 AND ihit AND (dhit OR corr > 0 OR (NOT (loss IS NOT NULL AND NOT (social AND pub IS NULL)) AND (places >= 2 OR veh > 0))) THEN 'STRONG' ELSE 'BACKGROUND' END AS band FROM {name}_s)"""


def _ranked_sql(scores: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE band WHEN 'CONFIRMED' THEN 1 WHEN 'STRONG' THEN 2 ELSE 3 END, score DESC, article_id) AS rank FROM {scores} QUALIFY rank <= {k}"


def _articles(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text")


@query(
    "flagship_top_evidence",
    f"WITH {_CLAIM_SQL}, {_matches_sql('m', 'text')}, {_scores_sql('s', 'm', 'text')} SELECT claim_id, article_id, score, band, rank FROM ({_ranked_sql('s', K.RANK_LIMIT)})",
)
def _(spark, d):
    """Every claim's ranked evidence: anchors matched in whole texts, scored and banded by what matched."""
    articles = read_articles(_articles(spark, d))
    terms = E.article_tokens(_articles(spark, d), "article_id", "text")
    top = E.top_evidence(rendered_anchors(spark, d), score_sides(spark, d)[0], articles, terms)
    return top.select("claim_id", "article_id", "score", "band", "rank")


def search_index(spark, d):
    """(article_id, url_key, text): the first line of each document, as a search would show it."""
    docs = _articles(spark, d)
    return docs.select("article_id", F.col("article_id").alias("url_key"), F.substring_index("text", "\n", 1).alias("text"))


def full_pages(spark, d):
    return _articles(spark, d).select(F.col("article_id").alias("url_key"), F.col("text").alias("full_text"))


@query(
    "jn12_rescore",
    f"""WITH {_CLAIM_SQL}, {_matches_sql('m', _SHOWN_SQL)}, {_scores_sql('s', 'm', _SHOWN_SQL)}, {_matches_sql('p', 'text')},
    w AS MATERIALIZED (SELECT claim_id, article_id, score AS first_score, band AS first_band FROM s WHERE band <> 'CONFIRMED' AND NOT social QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) <= 12),
    merged AS (SELECT DISTINCT claim_id, article_id, kind, value FROM (SELECT * FROM m UNION ALL SELECT * FROM p) SEMI JOIN w USING (claim_id, article_id)), {_scores_sql('r', 'merged', 'text')}
    SELECT claim_id, article_id, first_score, first_band, score, band FROM r JOIN w USING (claim_id, article_id)""",
)
def _(spark, d):
    """Open rows of each claim scored on what a search shows, and again on their whole pages."""
    anchors, claims = rendered_anchors(spark, d), score_sides(spark, d)[0]
    index = search_index(spark, d)
    articles = read_articles(index.select("article_id", "text"))
    matches = E.match_anchors(anchors, articles, E.article_tokens(index, "article_id", "text"))
    scored = E.score_matches(matches, claims, E.facts_only(articles)).join(index.select("article_id", "url_key"), "article_id")
    again = E.rescore_enriched(anchors, claims, matches, scored, full_pages(spark, d), read_articles)
    return again.select("claim_id", "article_id", "first_score", "first_band", "score", "band")


@query("rp3_adaptive_match")
def _(spark, d):
    """The adaptive search over first lines, with whole pages read for open claims."""
    got = E.adaptive_match(
        rendered_anchors(spark, d), score_sides(spark, d)[0], search_index(spark, d), full_pages(spark, d), read_articles)
    return got.select("claim_id", "article_id", "score", "band", "round", "rank")


@query(
    "rp1_anchor_coverage",
    f"""WITH {_CLAIM_SQL}, {_matches_sql('m', 'text')},
    an AS (SELECT claim_id, kind, value FROM ph UNION ALL SELECT claim_id, CASE ordinal WHEN 5 THEN 'vehicle' WHEN 6 THEN 'incident' ELSE 'token' END, term FROM item_top WHERE ordinal >= 5
      UNION ALL SELECT claim_id, 'plate', code FROM plates UNION ALL SELECT item_id, 'corridor', concat('NH ', item_id % 50) FROM benchmark),
    sz AS (SELECT claim_id, kind, count(DISTINCT value) AS n_anchors FROM an GROUP BY ALL), h AS (SELECT claim_id, kind, count(DISTINCT value) AS n_found, count(DISTINCT article_id) AS n_records FROM m GROUP BY ALL),
    t AS (SELECT claim_id, count(DISTINCT article_id) AS of_records FROM m GROUP BY ALL),
    c AS (SELECT claim_id, kind, n_anchors, coalesce(n_found, 0) AS n_found, coalesce(n_records, 0) AS n_records, coalesce(of_records, 0) AS of_records FROM sz LEFT JOIN h USING (claim_id, kind) LEFT JOIN t USING (claim_id))
    SELECT *, CASE WHEN kind = 'name' THEN CASE WHEN n_found > 0 THEN 'named in a public report' ELSE 'no public mention located' END
      WHEN kind = 'plate' THEN CASE WHEN n_found > 0 THEN 'in at least one public source' ELSE 'in no indexed public source' END
      ELSE concat('referenced by ', n_records, ' of ', of_records, ' records') END AS finding FROM c""",
)
def _(spark, d):
    """The coverage section of each claim's report, from its real matches."""
    articles = read_articles(_articles(spark, d))
    anchors = rendered_anchors(spark, d)
    matches = E.match_anchors(anchors, articles, E.article_tokens(_articles(spark, d), "article_id", "text"))
    return RP.coverage_report(anchors, matches)
