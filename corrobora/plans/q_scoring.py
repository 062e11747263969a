"""Registered queries: similarity, clustering, scoring, risk, enrichment and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions import urls as U
from corrobora.functions.html import html_title
from corrobora.functions.identifiers import extract_codes
from corrobora.functions.text import lines, tokenize
from corrobora.operators import aggregates as A
from corrobora.operators import anchors as N
from corrobora.operators import clustering as CL
from corrobora.operators import fields as FD
from corrobora.operators import filters as FL
from corrobora.operators import matching as MA
from corrobora.operators import ranking as R
from corrobora.operators import risk as RK
from corrobora.operators import scoring as S
from corrobora.operators import similarity as SM
from corrobora.operators.joins import match_terms
from corrobora.plans import evidence as E
from corrobora.plans import report as RP
from corrobora.plans.q_filters import _SOCIAL, _SOCIAL_SQL
from corrobora.plans.registry import query
from corrobora.plans.roles import (
    CLAIMS_SQL, EVIDENCE_SQL, claims, evidence, inlist, lst, sql_jaccard, sql_shingles, sql_title_chars, sql_title_words,
    sql_tokens, sql_trigrams,
)
from corrobora.session import spread
from corrobora.sources.tables import load

# --- shared pieces ---------------------------------------------------------

_TOK = "regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''-]+')"
_OK = f"length(t[i]) >= 3 AND lower(t[i]) NOT IN {inlist(K.SEARCH_STOPWORDS)} AND NOT regexp_matches(t[i], '^\\d+$')"
ITEM_TOP_SQL = f"""itok AS (SELECT item_id, i AS pos, t[i] AS raw, lower(t[i]) AS token FROM (SELECT item_id, {_TOK} AS t FROM benchmark), unnest(range(1, len(t) + 1)) AS u(i) WHERE {_OK}),
ig AS (SELECT item_id, token, count(*) AS n, min(pos) AS pos, arg_min(raw, pos) AS raw FROM itok GROUP BY ALL),
isc AS (SELECT item_id, token, pos, least(length(token), 12) + CASE WHEN regexp_matches(raw, '^\\p{{Lu}}') THEN 4 ELSE 0 END - CASE WHEN list_contains({lst(defaults.INCIDENT_TERMS + defaults.VEHICLE_TYPES)}, token) THEN 3 ELSE 0 END - CASE WHEN n > 2 THEN 2 ELSE 0 END AS s FROM ig),
item_top AS (SELECT item_id AS claim_id, token AS term, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, pos) AS ordinal FROM isc) WHERE ordinal <= 8)"""
DOC_TOK_SQL = f"""doc_tok AS (SELECT DISTINCT doc_id AS article_id, lower(t[i]) AS term FROM (SELECT doc_id, {_TOK} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i) WHERE {_OK})"""
HITS_SQL = f"{ITEM_TOP_SQL}, {DOC_TOK_SQL}, hit AS (SELECT claim_id, article_id, count(*) AS hits FROM item_top JOIN doc_tok USING (term) GROUP BY ALL), tot AS (SELECT claim_id, count(*) AS total FROM item_top GROUP BY 1)"


def item_top(spark, d):
    """(claim_id, term, ordinal): distinctive tokens of each benchmark passage."""
    top = R.top_tokens(load(spark, d, "benchmark"), "item_id", "text")
    return top.select(F.col("item_id").alias("claim_id"), F.col("token").alias("term"), "ordinal")


def doc_tokens(spark, d):
    return E.article_tokens(load(spark, d, "documents"), "doc_id", "text")


# --- similarity ------------------------------------------------------------


@query(
    "sim1_cosine",
    f"""WITH {HITS_SQL}, dc AS (SELECT article_id, t, count(*) AS n FROM (SELECT doc_id AS article_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL),
    bc AS (SELECT claim_id, t, count(*) AS n FROM (SELECT item_id AS claim_id, unnest({sql_tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
    dn AS (SELECT article_id, sqrt(sum(n * n)) AS l FROM dc GROUP BY 1), bn AS (SELECT claim_id, sqrt(sum(n * n)) AS l FROM bc GROUP BY 1),
    p AS (SELECT claim_id, article_id FROM hit WHERE hits >= 2), dot AS (SELECT claim_id, article_id, sum(bc.n * dc.n) AS v FROM p JOIN bc USING (claim_id) JOIN dc USING (article_id, t) GROUP BY ALL)
    SELECT claim_id, article_id, round(coalesce(v / (bn.l * dn.l), 0), 6) AS cosine FROM p LEFT JOIN dot USING (claim_id, article_id) LEFT JOIN bn USING (claim_id) LEFT JOIN dn USING (article_id)""",
)
def _(spark, d):
    return _cosine(spark, d).withColumn("cosine", F.round("cosine", 6))


def _cosine(spark, d):
    pairs = match_terms(item_top(spark, d).select("claim_id", "term"), doc_tokens(spark, d), 2).select("claim_id", "article_id")
    left = A.term_counts(load(spark, d, "benchmark").withColumnRenamed("item_id", "claim_id"), "claim_id", "text")
    right = A.term_counts(load(spark, d, "documents").withColumnRenamed("doc_id", "article_id"), "article_id", "text")
    return SM.cosine_pairs(pairs, left, right, "claim_id", "article_id")


def _feature_sql(name, table):
    return f"""{name}0 AS (SELECT title, count(*) AS n FROM (SELECT unnest(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x))) AS title FROM {table}) WHERE title <> '' GROUP BY 1),
    {name}1 AS (SELECT title, n, len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) < 6 AS short, {sql_title_words('title')} AS ws, {sql_title_chars('title')} AS cs FROM {name}0),
    {name} AS (SELECT title, n, short, {sql_shingles('ws')} AS w3, {sql_trigrams('cs')} AS g3 FROM {name}1)"""


@query(
    "sim2_similar_titles",
    f"""WITH {_feature_sql('a', 'benchmark')}, {_feature_sql('b', 'documents')},
    pairs AS (SELECT DISTINCT x.title AS a_title, y.title AS b_title FROM (SELECT title, unnest(g3) AS g FROM a) x JOIN (SELECT title, unnest(g3) AS g FROM b) y ON x.g = y.g AND abs(length(x.title) - length(y.title)) <= 0.6 * greatest(length(x.title), length(y.title))),
    s AS (SELECT a_title, b_title, a.n AS a_n, b.n AS b_n, a.short OR b.short AS gram, CASE WHEN a.short OR b.short THEN {sql_jaccard('a.g3', 'b.g3')} ELSE {sql_jaccard('a.w3', 'b.w3')} END AS similarity
      FROM pairs JOIN a ON a.title = a_title JOIN b ON b.title = b_title)
    SELECT a_title, b_title, a_n, b_n, round(similarity, 6) AS similarity FROM s WHERE similarity >= CASE WHEN gram THEN 0.80 ELSE 0.72 END""",
)
def _(spark, d):
    def titles(name):
        each = load(spark, d, name).select(F.explode(lines(F.col("text"))).alias("title"))
        return each.where("title <> ''")

    got = SM.similar_titles(titles("benchmark"), titles("documents"), "title")
    return got.withColumn("similarity", F.round("similarity", 6))


_SIM3_FIG = "CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [doc_id % 4] ELSE [doc_id % 4, doc_id % 5] END"


@query(
    "sim3_same_incident",
    f"""WITH e AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 20 AS INT) END AS day, {_SIM3_FIG} AS figs FROM documents),
    f AS (SELECT title, arg_min(doc_id, doc_id) AS lead, arg_min((day, figs), doc_id) AS lf FROM e GROUP BY 1)
    SELECT doc_id, lead, coalesce(abs(date_diff('day', day, lf[1])) <= 3, true) AND (len(figs) = 0 OR len(lf[2]) = 0 OR list_has_any(figs, lf[2])) AS same FROM e JOIN f USING (title)""",
)
def _(spark, d):
    n = F.col("doc_id")
    e = load(spark, d, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"),
        F.when(n % 6 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int"))).alias("day"),
        F.when(n % 3 == 0, F.array().cast("array<bigint>")).when(n % 3 == 1, F.array(n % 4)).otherwise(F.array(n % 4, n % 5)).alias("figs"),
    )
    # Each row is tested against the first row with its headline, not against every other.
    first = e.groupBy("title").agg(F.min_by(F.struct("doc_id", "day", "figs"), "doc_id").alias("f"))
    return e.join(first, "title").select(
        "doc_id", F.col("f.doc_id").alias("lead"),
        SM.same_incident(F.col("day"), F.col("f.day"), F.col("figs"), F.col("f.figs")).alias("same"),
    )


# --- clustering ------------------------------------------------------------


def story_rows(spark, d):
    """Documents as rows of one claim per source, with derived scores, days and figures."""
    n = F.col("doc_id")
    return load(spark, d, "documents").select(
        n.alias("article_id"), F.col("source").alias("claim_id"), F.substring_index("text", "\n", 1).alias("title"),
        ((n * 37) % 101).cast("int").alias("score"),
        F.when(n % 6 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int"))).alias("day"),
        F.when(n % 3 == 0, F.array().cast("array<bigint>")).when(n % 3 == 1, F.array(n % 4)).otherwise(F.array(n % 4, n % 5)).alias("figures"),
        F.col("text").alias("snippet"),
    )


_CL_ROWS_SQL = f"""cr0 AS (SELECT doc_id AS article_id, source AS claim_id, split_part(text, chr(10), 1) AS title, CAST((doc_id * 37) % 101 AS INT) AS score,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 20 AS INT) END AS day, {_SIM3_FIG} AS figs FROM documents),
cr1 AS (SELECT *, len(list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> '')) < 6 AS short, {sql_title_words('title')} AS ws, {sql_title_chars('title')} AS cs FROM cr0),
cr AS MATERIALIZED (SELECT claim_id, article_id, score, day, figs, short, {sql_shingles('ws')} AS w3, {sql_trigrams('cs')} AS g3, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS rk FROM cr1),
adj AS MATERIALIZED (SELECT a.claim_id, a.rk AS hi, b.rk AS lo,
  coalesce(abs(date_diff('day', a.day, b.day)) <= 3, true) AND (len(a.figs) = 0 OR len(b.figs) = 0 OR list_has_any(a.figs, b.figs)) AS same
  FROM cr a JOIN cr b ON a.claim_id = b.claim_id AND a.rk < b.rk
  WHERE CASE WHEN a.short OR b.short THEN {sql_jaccard('a.g3', 'b.g3')} >= 0.80 ELSE {sql_jaccard('a.w3', 'b.w3')} >= 0.72 END),
greedy AS (SELECT claim_id, 0::BIGINT AS rk, CAST([] AS BIGINT[]) AS leaders, 0::BIGINT AS lead FROM (SELECT DISTINCT claim_id FROM cr) UNION ALL
  SELECT g.claim_id, g.rk + 1, CASE WHEN x.lead IS NULL THEN list_append(g.leaders, g.rk + 1) ELSE g.leaders END, coalesce(x.lead, g.rk + 1)
  FROM greedy g JOIN cr c ON c.claim_id = g.claim_id AND c.rk = g.rk + 1
  LEFT JOIN LATERAL (SELECT min(hi) AS lead FROM adj WHERE adj.claim_id = g.claim_id AND adj.lo = g.rk + 1 AND adj.same AND list_contains(g.leaders, adj.hi)) x ON true)"""


@query(
    "cl1_stories",
    f"""WITH RECURSIVE {_CL_ROWS_SQL}, lead AS (SELECT claim_id, rk, lead FROM greedy WHERE rk > 0)
    SELECT c.claim_id, c.article_id, l.article_id AS story_id FROM cr c JOIN lead ON lead.claim_id = c.claim_id AND lead.rk = c.rk JOIN cr l ON l.claim_id = c.claim_id AND l.rk = lead.lead""",
)
def _(spark, d):
    return CL.collapse_stories(story_rows(spark, d).drop("snippet")).select("claim_id", "article_id", "story_id")


@query(
    "cl2_distinct_incident",
    f"""WITH RECURSIVE {_CL_ROWS_SQL}, lead AS (SELECT claim_id, rk, lead FROM greedy WHERE rk > 0),
    clash AS (SELECT adj.claim_id, hi, lo FROM adj JOIN lead lh ON lh.claim_id = adj.claim_id AND lh.rk = hi AND lh.lead = hi JOIN lead ll ON ll.claim_id = adj.claim_id AND ll.rk = lo
      WHERE NOT same AND (ll.lead = lo OR hi < ll.lead)),
    f AS (SELECT claim_id, hi AS rk FROM clash UNION SELECT claim_id, lo FROM clash)
    SELECT c.claim_id, c.article_id, f.rk IS NOT NULL AS distinct_incident FROM cr c LEFT JOIN f ON f.claim_id = c.claim_id AND f.rk = c.rk""",
)
def _(spark, d):
    return CL.collapse_stories(story_rows(spark, d).drop("snippet")).select("claim_id", "article_id", "distinct_incident")


@query(
    "cl3_representative",
    """WITH s AS (SELECT doc_id % 50 AS story_id, source AS claim_id, doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN concat('https://news.google.com/', doc_id) ELSE concat('https://a.example.org/', doc_id) END AS url,
      text AS snippet, CAST((doc_id * 37) % 101 AS INT) AS score, DATE '2024-01-01' + CAST(doc_id % 20 AS INT) AS day, doc_id % 3 = 0 AS agg FROM documents)
    SELECT claim_id, story_id, arg_min(article_id, (agg, -score, article_id)) AS article_id, arg_min(url, (agg, -score, article_id)) AS url, min(CASE WHEN agg THEN url END) AS aggregator_url,
      max(length(snippet)) AS n_chars, min(day) AS day, max(score) AS score, count(*) AS n_copies FROM s GROUP BY ALL""",
)
def _(spark, d):
    n = F.col("doc_id")
    s = load(spark, d, "documents").select(
        (n % 50).alias("story_id"), F.col("source").alias("claim_id"), n.alias("article_id"),
        F.when(n % 3 == 0, F.concat(F.lit("https://news.google.com/"), n)).otherwise(F.concat(F.lit("https://a.example.org/"), n)).alias("url"),
        F.col("text").alias("snippet"), ((n * 37) % 101).cast("int").alias("score"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int")).alias("day"),
    )
    got = CL.choose_representative(s)
    return got.withColumn("n_chars", F.length("snippet").cast("bigint")).drop("snippet")


# --- scores ----------------------------------------------------------------

_KINDS = ["plate", "name", "org", "place", "place", "vehicle", "incident", "token"]
_TIERS = [(30, ["s1.example.net"]), (24, ["s2.example.net"]), (18, ["s3.example.net"])]


def scored_pairs(spark, d):
    """Benchmark anchors matched to documents, scored in full."""
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), F.col("ordinal") - 1)
    anchors = item_top(spark, d).withColumn("kind", kind)
    matches = anchors.join(doc_tokens(spark, d), "term").select("claim_id", "article_id", "kind", F.col("term").alias("value"))
    return E.score_matches(matches, *score_sides(spark, d))


def score_sides(spark, d):
    """Claims with their loss dates and counts, and articles with what is known of each."""
    i = F.col("item_id")
    c = load(spark, d, "benchmark").select(
        i.alias("claim_id"), F.when(i % 5 != 0, _day(i % 30)).alias("loss_date"), (i % 4).cast("int").alias("target_count")
    )
    return c, E.facts_only(read_articles(load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text")))


def _day(c):
    return F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))


def read_articles(texts):
    """Article rows from (article_id, text): identifiers, and what the score reads."""
    n = F.col("article_id")
    return texts.select(
        n, extract_codes(F.col("text"), 6).alias("keys"), F.array(MA.corridor_key(F.concat(F.lit("NH-"), n % 70))).alias("corridors"),
        F.when(n % 3 != 0, _day(n % 90)).alias("publish_day"), F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{2}"), 0).alias("dates"),
        F.when(n % 2 == 0, F.array((n % 5 + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("figures"),
        U.tier_score(F.concat(F.lit("www.s"), n % 7, F.lit(".example.net")), _TIERS).alias("domain_score"),
        S.generic_incident(F.col("text")).alias("generic_incident"), (n % 10 == 0).alias("social"),
    )


SCORED_SQL = f"""{ITEM_TOP_SQL}, {DOC_TOK_SQL}, m AS (SELECT claim_id, article_id, term, list_extract({lst(_KINDS)}, CAST(ordinal AS INT)) AS kind FROM item_top JOIN doc_tok USING (term)),
f0 AS (SELECT claim_id, article_id, bool_or(kind = 'plate') AS plate, bool_or(kind = 'name') AS nam, bool_or(kind = 'org') AS org, list(DISTINCT term) FILTER (WHERE kind = 'place' AND length(term) >= 4) AS pl,
  bool_or(kind = 'incident' AND length(term) >= 4 AND term NOT IN {inlist(K.NON_EVENT_TERMS)}) AS inc, count(*) FILTER (WHERE kind = 'vehicle') AS veh, count(*) FILTER (WHERE kind = 'token' AND length(term) >= 4) AS tok FROM m GROUP BY ALL),
f AS (SELECT f0.*, coalesce(len(list_filter(pl, lambda p: len(list_filter(pl, lambda o: length(o) > length(p) AND contains(o, p))) = 0)), 0) AS places,
  CASE WHEN claim_id % 5 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(claim_id % 30 AS INT) END AS loss, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 90 AS INT) END AS pub,
  claim_id % 4 AS target, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 + 1 END AS fig, CASE doc_id % 7 WHEN 1 THEN 30 WHEN 2 THEN 24 WHEN 3 THEN 18 ELSE 12 END AS dom,
  inc OR regexp_matches(text, '(?i)({'|'.join(K.GENERIC_INCIDENT)})') AS ihit, doc_id % 10 = 0 AS social, text FROM f0 JOIN documents ON doc_id = article_id),
g AS (SELECT *, abs(date_diff('day', loss, pub)) AS gap, loss IS NOT NULL AND (contains(text, CAST(loss - 1 AS VARCHAR)) OR contains(text, CAST(loss AS VARCHAR)) OR contains(text, CAST(loss + 1 AS VARCHAR)) OR contains(text, CAST(loss + 2 AS VARCHAR))) AS verb FROM f),
sc AS (SELECT *, greatest(0, least(100, CAST(floor(CASE WHEN plate THEN 45 ELSE 0 END + CASE WHEN nam THEN 25 ELSE 0 END + CASE WHEN org THEN 22 ELSE 0 END + least(places * 12, 24) + CASE WHEN ihit THEN 10 ELSE -20 END + veh * 4
  + coalesce(CASE WHEN gap <= 2 THEN 18 WHEN gap <= 7 THEN 10 WHEN gap <= 45 THEN 3 WHEN gap > 45 THEN -12 END, 0) + CASE WHEN verb THEN 8 ELSE 0 END + least(tok * 5, 18)
  + CASE WHEN target > 0 AND fig IS NOT NULL THEN CASE WHEN fig = target THEN 12 ELSE -30 END ELSE 0 END + dom * 0.5 + 0.5) AS INT))) AS score, verb OR coalesce(gap <= 7, false) AS dhit,
  plate OR nam OR org AS specific, social AND NOT plate AND (nam OR org) AS soft FROM g WHERE NOT social OR plate OR nam OR org OR (places > 0 AND (ihit OR veh > 0))),
bd AS (SELECT *, CASE WHEN specific AND NOT soft THEN 'CONFIRMED' WHEN soft THEN 'STRONG' WHEN places > 0 AND ihit AND (dhit OR (NOT (loss IS NOT NULL AND NOT (social AND pub IS NULL)) AND (places >= 2 OR veh > 0))) THEN 'STRONG' ELSE 'BACKGROUND' END AS band FROM sc)"""


# Tokens of a passage by rank as anchors of every kind; a code of the document with its number is its plate.
_ANCHOR_KINDS = {1: "name", 2: "name", 3: "place", 4: "org", 5: "vehicle", 6: "incident", 7: "token", 8: "token"}


def rendered_anchors(spark, d):
    top = item_top(spark, d)
    of = lambda *ranks: top.where(F.col("ordinal").isin(*ranks))
    pair = of(1, 2).groupBy("claim_id").agg(F.max_by("term", -F.col("ordinal")).alias("a"), F.max_by("term", "ordinal").alias("b"))
    names = pair.select("claim_id", F.lit("name").alias("kind"), F.concat_ws(" ", "a", "b").alias("value"))
    org = of(4, 5).groupBy("claim_id").agg(F.max_by("term", -F.col("ordinal")).alias("a"), F.max_by("term", "ordinal").alias("b"))
    orgs = org.select("claim_id", F.lit("org").alias("kind"), F.concat_ws(" ", "a", "b").alias("value"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _ANCHOR_KINDS.items() for x in kv]), F.col("ordinal").cast("int"))
    rest = of(3, 5, 6, 7, 8).select("claim_id", kind.alias("kind"), F.col("term").alias("value"))
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"))
    codes = article_keys(spark, d).join(items, F.col("article_id") == F.col("claim_id"))
    plates = codes.select("claim_id", F.lit("plate").alias("kind"), F.explode("keys").alias("value"))
    roads = items.select("claim_id", F.lit("corridor").alias("kind"), F.concat(F.lit("NH "), F.col("claim_id") % 50).alias("value"))
    return names.unionByName(orgs).unionByName(rest).unionByName(plates).unionByName(roads)


def article_keys(spark, d):
    """Documents with their codes, and a road that each is about."""
    return read_articles(load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text")).select("article_id", "keys", "corridors")


_CODES_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9][A-Z0-9-]*[A-Z0-9]'), lambda t: replace(t, '-', '')), lambda k: length(k) >= 6 AND regexp_matches(k, '[0-9]')))"
_MATCH_SQL = f"""{ITEM_TOP_SQL}, {DOC_TOK_SQL}, cd AS (SELECT doc_id AS article_id, unnest({_CODES_SQL}) AS code FROM documents),
tp AS (SELECT claim_id, list(term ORDER BY ordinal) AS t FROM item_top GROUP BY 1),
ph AS (SELECT claim_id, 'name' AS kind, t[1] || ' ' || t[2] AS value, t[1] AS x, t[2] AS y FROM tp UNION ALL SELECT claim_id, 'org', t[4] || ' ' || t[5], t[4], t[5] FROM tp UNION ALL SELECT claim_id, 'place', t[3], t[3], t[3] FROM tp),
strong AS (SELECT p.claim_id, a.article_id, kind, value FROM ph p JOIN doc_tok a ON a.term = p.x JOIN doc_tok b ON b.term = p.y AND b.article_id = a.article_id
  UNION SELECT item_id, b.article_id, 'plate', a.code FROM benchmark JOIN cd a ON a.article_id = item_id JOIN cd b ON b.code = a.code
  UNION SELECT item_id, doc_id, 'corridor', concat('NH ', item_id % 50) FROM benchmark JOIN documents ON doc_id % 70 = item_id % 50),
two AS (SELECT a.claim_id, article_id FROM item_top a JOIN doc_tok USING (term) WHERE ordinal IN (7, 8) GROUP BY ALL HAVING count(*) = 2),
pr AS (SELECT claim_id, article_id FROM strong UNION SELECT * FROM two)
SELECT * FROM strong UNION SELECT claim_id, article_id, CASE ordinal WHEN 5 THEN 'vehicle' WHEN 6 THEN 'incident' ELSE 'token' END, term FROM pr JOIN item_top USING (claim_id) JOIN doc_tok USING (article_id, term) WHERE ordinal >= 5"""


@query("sc1_match_anchors", f"WITH {_MATCH_SQL}")
def _(spark, d):
    return MA.match_anchors(rendered_anchors(spark, d), article_keys(spark, d), doc_tokens(spark, d))


@query("sc2_claim_evidence")
def _(spark, d):
    """The whole way from a passage to its ranked evidence: anchors, matches, score, band, rank."""
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("narrative"))
    anchors = N.build_anchors(items).select("claim_id", "kind", "value")
    matches = MA.match_anchors(anchors, article_keys(spark, d), doc_tokens(spark, d))
    scored = E.score_matches(matches, *score_sides(spark, d))
    return R.rank_evidence(scored).select("claim_id", "article_id", "rank", "band", "score", "place_hits", "token_hits")


@query("sc1_relevance", f"WITH {SCORED_SQL} SELECT claim_id, article_id, score, places AS place_hits, dhit AS date_hit FROM bd")
def _(spark, d):
    return scored_pairs(spark, d).select("claim_id", "article_id", "score", F.col("place_hits").cast("bigint").alias("place_hits"), "date_hit")


@query("sc2_bands", f"WITH {SCORED_SQL} SELECT claim_id, band, count(*) AS n, sum(score)::BIGINT AS score_sum FROM bd GROUP BY ALL")
def _(spark, d):
    return scored_pairs(spark, d).groupBy("claim_id", "band").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))


@query("sc2_match_reasons")
def _(spark, d):
    return scored_pairs(spark, d).select("claim_id", "article_id", "band", "reasons", "matched", "matched_fields", "case_specific", "authoritative")


def _chrome_sql(x):
    for p in K.SOCIAL_CHROME:
        p = p.replace("'", "''")
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(
    "sc3_social_scope",
    f"""SELECT page_id, md5(concat_ws(' ', CASE WHEN social THEN concat_ws(' ', title, url) ELSE concat_ws(' ', title, html, url) END)) AS identity_digest,
      md5(concat_ws(' ', title, CASE WHEN social THEN {_chrome_sql('html')} ELSE html END, url)) AS haystack_digest FROM (SELECT page_id, url, html, ({_SOCIAL_SQL}) AS social, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS title FROM pages)""",
)
def _(spark, d):
    p = load(spark, d, "pages").select(
        "page_id", F.col("url").alias("url_text"), F.col("html").alias("snippet"), F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1).alias("title"),
        F.lit(None).cast("string").alias("full_text"), U.host_in(U.host_of(F.col("url")), _SOCIAL).alias("social"),
    )
    got = S.scope_social(p)
    # The title and URL of a social row, the whole text of any other.
    return got.select("page_id", F.md5("identity_text").alias("identity_digest"), F.md5("haystack").alias("haystack_digest"))


_PAIR_SQL = f"""{HITS_SQL}, pr AS (SELECT claim_id, article_id, lower(text) AS txt, list_filter(list_transform([1, 2, 3, 4], lambda o: o), lambda o: true) AS z FROM hit JOIN documents ON doc_id = article_id WHERE hits >= 2),
w AS (SELECT claim_id, list(term ORDER BY ordinal) AS ts FROM item_top GROUP BY 1),
q AS (SELECT claim_id, article_id, txt, ts[1] AS district, list_slice(ts, 2, len(ts)) AS words, contains(txt, ts[2]) AS plate, contains(txt, ts[3]) AS party FROM pr JOIN w USING (claim_id)),
qq AS (SELECT *, contains(txt, district) AS dmatch, len(list_filter(words, lambda v: contains(txt, v))) AS found, len(words) AS nw FROM q)"""


def _text_pairs(spark, d):
    """Candidate pairs with the lower-cased article text and the claim's words in order."""
    top = item_top(spark, d)
    pairs = match_terms(top.select("claim_id", "term"), doc_tokens(spark, d), 2).select("claim_id", "article_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "term"))), lambda x: x["term"])
    w = top.groupBy("claim_id").agg(ordered.alias("ts"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.lower("text").alias("txt"))
    q = pairs.join(w, "claim_id").join(docs, "article_id")
    return q.select(
        "claim_id", "article_id", "txt", F.get("ts", 0).alias("district"), F.slice(F.col("ts"), F.lit(2), F.size("ts")).alias("words"),
        F.contains("txt", F.get("ts", 1)).alias("plate"), F.contains("txt", F.get("ts", 2)).alias("party"),
    )


_ENTITY_SQL = "least((CASE WHEN plate THEN 1 ELSE 0 END + CASE WHEN party THEN 1 ELSE 0 END + CASE WHEN dmatch THEN 1 ELSE 0 END + found * 1.0 / nw) / 4, 1.0)"
_LOC_SQL = "CASE WHEN dmatch AND found >= greatest(1, nw // 2) THEN 1.0 WHEN dmatch OR found >= greatest(1, nw // 2) THEN 0.7 ELSE 0.1 END"


@query("sc6_entity_ratio", f"WITH {_PAIR_SQL} SELECT claim_id, article_id, round({_ENTITY_SQL}, 6) AS ratio FROM qq")
def _(spark, d):
    q = _text_pairs(spark, d)
    share = S.words_found(F.col("words"), F.col("txt")) / F.size("words")
    return q.select(
        "claim_id", "article_id",
        F.round(S.entity_ratio(F.col("plate"), F.col("party"), F.contains("txt", F.col("district")), share), 6).alias("ratio"),
    )


@query("sc7_location_score", f"WITH {_PAIR_SQL} SELECT claim_id, article_id, {_LOC_SQL} AS location_score FROM qq")
def _(spark, d):
    q = _text_pairs(spark, d)
    return q.select("claim_id", "article_id", S.location_score(F.col("district"), F.col("words"), F.col("txt")).alias("location_score"))


@query(
    "sc4_five_factor",
    f"""WITH {_PAIR_SQL}, dc AS (SELECT article_id, t, count(*) AS n FROM (SELECT doc_id AS article_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL),
    bc AS (SELECT claim_id, t, count(*) AS n FROM (SELECT item_id AS claim_id, unnest({sql_tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
    dn AS (SELECT article_id, sqrt(sum(n * n)) AS l FROM dc GROUP BY 1), bn AS (SELECT claim_id, sqrt(sum(n * n)) AS l FROM bc GROUP BY 1),
    dot AS (SELECT claim_id, article_id, sum(bc.n * dc.n) AS v FROM qq JOIN bc USING (claim_id) JOIN dc USING (article_id, t) GROUP BY ALL),
    x AS (SELECT qq.*, coalesce(v / (bn.l * dn.l), 0) AS cos, {_ENTITY_SQL} AS ent, {_LOC_SQL} AS loc, CASE WHEN abs(article_id % 90 - claim_id % 30) = 0 THEN 1.0 WHEN abs(article_id % 90 - claim_id % 30) <= 2 THEN 0.9 WHEN abs(article_id % 90 - claim_id % 30) <= 7 THEN 0.7 WHEN abs(article_id % 90 - claim_id % 30) <= 30 THEN 0.4 ELSE 0.1 END AS dt,
       CASE article_id % 7 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END AS src FROM qq LEFT JOIN dot USING (claim_id, article_id) LEFT JOIN bn USING (claim_id) LEFT JOIN dn USING (article_id))
    SELECT claim_id, article_id, round(greatest(0, least(1, CASE WHEN plate AND party THEN 1.0 WHEN plate THEN 0.95 WHEN party THEN 0.75 ELSE ent END * 0.35 + cos * 0.20 + dt * 0.20 + CASE WHEN plate OR party THEN greatest(0.85, loc) ELSE loc END * 0.15 + src * 0.10
      - CASE WHEN article_id % 11 = 0 AND claim_id % 2 = 0 THEN 0.15 ELSE 0 END)) + 1e-9, 2) AS score5 FROM x""",
)
def _(spark, d):
    q = _text_pairs(spark, d)
    c, a = F.col("claim_id"), F.col("article_id")
    gap = F.abs(a % 90 - c % 30)
    share = S.words_found(F.col("words"), F.col("txt")) / F.size("words")
    # Everything read from the text is computed before the next join, so texts are not shuffled again.
    parts = q.select(
        c, a, F.col("plate").alias("plate_match"), F.col("party").alias("party_match"),
        S.entity_ratio(F.col("plate"), F.col("party"), F.contains("txt", F.col("district")), share).alias("entity_raw"),
        F.when(gap == 0, 1.0).when(gap <= 2, 0.9).when(gap <= 7, 0.7).when(gap <= 30, 0.4).otherwise(0.1).alias("date_raw"),
        S.location_score(F.col("district"), F.col("words"), F.col("txt")).alias("location_raw"),
        F.when(a % 7 == 1, 1.0).when(a % 7 == 2, 0.8).otherwise(0.6).alias("source_raw"),
        (a % 11 == 0).alias("text_still"), (c % 2 == 0).alias("story_moving"),
    ).join(_cosine(spark, d), ["claim_id", "article_id"])
    return S.score_five_factor(parts).select("claim_id", "article_id", "score5")


@query(
    "sc5_keyword_score",
    f"""WITH {HITS_SQL} SELECT claim_id, article_id, CASE WHEN article_id % 13 = 0 THEN 96.0 ELSE least(greatest(round(CASE WHEN pl AND r >= 0.5 THEN greatest(b, 92.0) WHEN pl THEN greatest(b, 82.0) WHEN r >= 0.6 THEN greatest(b, 85.0) ELSE b END, 1), 50.0), 99.0) END AS score
      FROM (SELECT claim_id, article_id, hits * 1.0 / total AS r, 50 + hits * 1.0 / total * 40 AS b, (article_id % 3 = 0 AND claim_id % 2 = 0) AS pl FROM hit JOIN tot USING (claim_id) WHERE hits >= 2)""",
)
def _(spark, d):
    top = item_top(spark, d).select("claim_id", "term")
    total = top.groupBy("claim_id").agg(F.count("*").alias("total"))
    a, c = F.col("article_id"), F.col("claim_id")
    hits = match_terms(top, doc_tokens(spark, d), 2).join(total, "claim_id")
    return hits.select(
        "claim_id", "article_id",
        S.score_keywords(F.col("hits"), F.col("total"), a % 13 == 0, a % 3 == 0, c % 2 == 0).alias("score"),
    )


# --- risk ------------------------------------------------------------------

_RULES = [
    ("substitution", ["worthless", "heded"], ["driver_implant", "entity"], "another driver is named"),
    ("usage", ["ingdon", "haerin"], ["hire_and_reward", "cause"], "private vehicle in paid use"),
    ("timeline", ["esheon"], ["pre_inception", "time"], "damage predates the policy"),
    ("still", ["thand", "inand"], ["cause"], "the other vehicle stood still"),
]


def _rules_sql():
    parts = []
    for i, (rule, terms, flags, why) in enumerate(_RULES):
        for f in flags:
            parts.append(f"SELECT claim_id, {i} AS i, '{rule}' AS rule, '{f}' AS flag, '{why}' AS explanation FROM t WHERE regexp_matches(txt, '(?i)({'|'.join(terms)})')")
    return " UNION ALL ".join(parts)


@query(
    "rk1_mismatch_flags",
    f"""WITH {EVIDENCE_SQL}, t AS (SELECT claim_id, string_agg(snippet, ' ' ORDER BY n) AS txt FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS n FROM evidence) WHERE n <= 4 GROUP BY 1)
    SELECT claim_id, flag, arg_min(rule, i) AS rule, arg_min(explanation, i) AS explanation FROM ({_rules_sql()}) GROUP BY ALL""",
)
def _(spark, d):
    texts = R.top_text(evidence(spark, d), "claim_id", [F.col("score").desc(), F.col("article_id").asc()], "snippet")
    return RK.mismatch_flags(texts, _RULES, "text", "claim_id")


@query(
    "rk2_risk_score",
    """WITH f AS (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'R' THEN 25 WHEN 'A' THEN 20 ELSE 45 END AS w, l_returnflag FROM lineitem),
    p AS (SELECT l_orderkey, sum(w) AS w, count(*) AS n_flags FROM f GROUP BY 1), i AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 7 OR l_quantity > 49) * 35 AS w FROM lineitem GROUP BY 1),
    s AS (SELECT l_orderkey, n_flags, CAST(least(100, 15 + p.w + i.w) AS INT) AS risk_score FROM p JOIN i USING (l_orderkey))
    SELECT *, CASE WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s""",
)
def _(spark, d):
    li = load(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", "cause").when(F.col("l_returnflag") == "A", "location").otherwise("driver_implant")
    images = li.select("l_orderkey", ((F.col("l_linenumber") == 7) | (F.col("l_quantity") > 49)).alias("flagged"))
    return RK.risk_score(li.select("l_orderkey", flag.alias("flag")), "l_orderkey", images)


@query(
    "rk3_review_level",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 17 = 0 OR o_totalprice < 100000 THEN 'HIGH' WHEN o_totalprice < 300000 THEN 'MEDIUM' ELSE 'LOW' END AS review_level FROM orders""",
)
def _(spark, d):
    avg = F.when(F.col("o_totalprice") < 100000, 0.4).when(F.col("o_totalprice") < 300000, 0.6).otherwise(0.9)
    return load(spark, d, "orders").select(
        "o_orderkey", RK.review_level(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 17 == 0, avg).alias("review_level")
    )


@query(
    "rk4_batch_level",
    """SELECT o_orderkey, CASE WHEN count(l_orderkey) FILTER (WHERE l_quantity > 45) > 0 THEN 'HIGH' WHEN count(l_orderkey) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, d):
    per = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 45).alias("s")
    )
    o = load(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left").fillna(0)
    return o.select("o_orderkey", RK.batch_level(F.col("s"), F.col("n")).alias("level"))


def report_inputs(spark, d):
    """Sources as claims and documents as their evidence, with a stated figure per record."""
    e = evidence(spark, d)
    n = F.col("article_id")
    ev = e.withColumns(
        {"figure": F.when(n % 4 == 0, (n % 3 + 1).cast("int")), "authoritative": (n % 50 == 7)}
    )
    num = F.expr("substring(claim_id, 4)").cast("int")
    c = e.select("claim_id").distinct().select(
        "claim_id", F.date_add(F.lit("2024-01-01").cast("date"), num % 5).alias("loss_date"), (num % 5).alias("target_count"),
        (num % 2 == 0).alias("has_plate"),
    )
    return c, ev


_REPORT_SQL = f"""{EVIDENCE_SQL}, cl AS (SELECT claim_id, num, DATE '2024-01-01' + num % 5 AS loss_date, num % 5 AS target_count, num % 2 = 0 AS has_plate FROM (SELECT DISTINCT claim_id, CAST(substr(claim_id, 4) AS INT) AS num FROM evidence)),
agg AS (SELECT claim_id, count(*) AS records, count(*) FILTER (WHERE band = 'CONFIRMED') AS n_confirmed, count(*) FILTER (WHERE band = 'STRONG') AS n_strong, count(*) FILTER (WHERE band = 'BACKGROUND') AS n_background,
  count(*) FILTER (WHERE article_id % 50 = 7) AS n_auth, min(publish_day) AS earliest, count(*) FILTER (WHERE article_id % 4 = 0) AS n_figures, bool_or(article_id % 4 = 0 AND article_id % 3 + 1 = target_count) AS agrees FROM evidence JOIN cl USING (claim_id) GROUP BY 1)"""
_FLAGS_SQL = "concat_ws(',', CASE WHEN target_count > 0 AND n_figures > 0 AND NOT agrees THEN 'count_disagreement' END, CASE WHEN date_diff('day', earliest, loss_date) > 2 THEN 'pre_inception' END, CASE WHEN has_plate AND records > 0 AND n_confirmed = 0 THEN 'no_identifier' END, CASE WHEN records > 0 AND n_auth = 0 THEN 'no_authoritative_source' END)"


@query("rk5_discrepancy_flags", f"WITH {_REPORT_SQL} SELECT claim_id, {_FLAGS_SQL} AS flags FROM cl JOIN agg USING (claim_id)")
def _(spark, d):
    return RP.claim_report(*report_inputs(spark, d)).select("claim_id", "flags")


@query(
    "rp1_claim_report",
    f"""WITH {_REPORT_SQL}, top AS (SELECT claim_id, string_agg(article_id || ' ' || domain, '; ' ORDER BY r) AS top_sources FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE band WHEN 'CONFIRMED' THEN 1 WHEN 'STRONG' THEN 2 ELSE 3 END, score DESC, article_id) AS r FROM evidence) WHERE r <= 6 GROUP BY 1)
    SELECT claim_id, records, n_confirmed, n_strong, n_background, earliest, CASE WHEN n_confirmed > 0 THEN 'confirmed' WHEN n_strong > 0 THEN 'circumstantial' WHEN records > 0 THEN 'background' ELSE 'nil' END AS verdict, top_sources,
      concat_ws('; ', CASE WHEN n_confirmed = 0 THEN 'run research links' END, CASE WHEN n_confirmed = 0 THEN 'check edition of ' || CAST(loss_date + 1 AS VARCHAR) END, CASE WHEN has_plate THEN 'verify registration' END, 'record the search') AS next_steps
    FROM cl JOIN agg USING (claim_id) JOIN top USING (claim_id)""",
)
def _(spark, d):
    r = RP.claim_report(*report_inputs(spark, d))
    return r.select("claim_id", "records", "n_confirmed", "n_strong", "n_background", "earliest", "verdict", "top_sources", "next_steps")


_ENC = "replace(replace(replace(replace(replace({x}, ',', '%2C'), ':', '%3A'), '/', '%2F'), '#', '%23'), ' ', '+')"
_USD = "concat_ws('/', month({x}), day({x}), year({x}))"


@query(
    "rp2_research_links",
    f"""WITH {CLAIMS_SQL}, q AS (SELECT claim_id, loss_date, insured_name || ' ' || state AS x FROM claims), w AS (SELECT *, 'https://www.google.com/search?q=' || {_ENC.format(x='x')} AS b,
      'cdr:1,cd_min:' || {_USD.format(x='(loss_date - 1)')} || ',cd_max:' || {_USD.format(x='(loss_date + 3)')} AS win FROM q)
    SELECT claim_id, 'Core' AS "group", 'Plain search' AS label, b AS link FROM w UNION ALL SELECT claim_id, 'News', 'News search', b || '&tbm=nws' FROM w
    UNION ALL SELECT claim_id, 'Date-locked', 'T-1 to T+3 window', b || '&tbs=' || {_ENC.format(x='win')} FROM w
    UNION ALL SELECT claim_id, 'Sources', 'a.example', 'https://www.google.com/search?q=' || {_ENC.format(x="('site:a.example ' || x)")} FROM w""",
)
def _(spark, d):
    c = claims(spark, d).select("claim_id", "loss_date", F.concat_ws(" ", "insured_name", "state").alias("q"))
    return RP.research_links(c, "q", "loss_date", ["a.example"])


@query(
    "rk6_image_status",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)(widget|stock)') THEN 'Reused' WHEN regexp_matches(p_name, '(?i)(small)') THEN 'Pre-Inception' ELSE 'Original' END AS status FROM part""",
)
def _(spark, d):
    rules = [("widget|stock", "Reused"), ("small", "Pre-Inception")]
    return RK.image_status(load(spark, d, "part"), rules, "p_name").select("p_partkey", "status")


# --- enrichment ------------------------------------------------------------


@query(
    "enr1_derive_fields",
    """WITH c AS (SELECT c_custkey, n_name, r_name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS spot, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ', East' END AS loss, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_mktsegment END AS city,
      CASE WHEN c_custkey % 2 = 0 THEN n_name END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT *, nullif(concat_ws(', ', CASE WHEN city <> 'N/A' THEN city END, state), '') AS place FROM c)
    SELECT c_custkey, coalesce(loss, spot, place) AS loss_location, coalesce(spot, loss, place) AS spot_of_accident, place AS district_state, coalesce(CASE WHEN city <> 'N/A' THEN city END, split_part(loss, ',', 1)) AS accident_location_city,
      CASE WHEN state IS NOT NULL THEN r_name END AS accident_location_region, CASE WHEN loss IS NOT NULL THEN 1.0 WHEN spot IS NOT NULL THEN 0.9 WHEN place IS NOT NULL THEN 0.7 END AS loss_confidence FROM p""",
)
def _(spark, d):
    k = F.col("c_custkey")
    dims = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = load(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    c = base.select(
        "c_custkey", "r_name", F.when(k % 4 == 0, F.col("c_mktsegment")).alias("spot_of_accident"),
        F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(", East"))).alias("loss_location"), F.lit(None).cast("string").alias("district_state"),
        F.lit("").alias("police_station_district"), F.when(k % 5 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("accident_location_city"),
        F.when(k % 2 == 0, F.col("n_name")).alias("accident_location_state"),
        F.when(k % 2 == 0, F.col("r_name")).alias("accident_location_region"),
    )
    got = FD.derive_fields(c)
    return got.select(
        "c_custkey", "loss_location", "spot_of_accident", "district_state", "accident_location_city", "accident_location_region",
        F.try_element_at("derived", F.lit("loss_location")).alias("loss_confidence"),
    )


@query(
    "enr2_parse_fields",
    """SELECT o_orderkey, concat('CL', o_orderkey + 100000) AS claim_id, 0.95 AS claim_id_confidence, c_name AS insured_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS accident_date_time,
       CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END AS accident_location_city FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    j = spread(load(spark, d, "orders"), "o_orderkey").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(
        F.lit("Intimation sheet\nClaim No : CL"), F.col("o_orderkey") + 100000, F.lit("\nInsured Name | "), "c_name", F.lit(" | Loss City | "),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("n/a"), F.lit("\n\nDate of Accident:\n"), F.col("o_orderdate").cast("date").cast("string"),
        F.lit("\nplease provide the claim number and a copy of the policy schedule to the office today\n"),
    )
    got = FD.parse_fields(j.select("o_orderkey", text.alias("t")), "o_orderkey", "t", ["claim_id", "insured_name", "accident_date_time", "accident_location_city"])
    return got.select(
        "o_orderkey", F.col("claim_id_value").alias("claim_id"), F.col("claim_id_confidence"), F.col("insured_name_value").alias("insured_name"),
        F.col("accident_date_time_value").alias("accident_date_time"), F.col("accident_location_city_value").alias("accident_location_city"),
    )


@query("enr2_document_fields")
def _(spark, d):
    synonyms = [("insured_name", "the"), ("state", "and"), ("hospital_name", "le"), ("remarks", "der")]
    return FD.parse_fields(load(spark, d, "documents"), "doc_id", "text", ["insured_name", "state", "hospital_name", "remarks"], synonyms)


_MARK_SQL = lambda terms: " + ".join(f"CASE WHEN contains(t, '{m}') THEN 1 ELSE 0 END" for m in terms)
_DOC_TYPE_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'CLAIM NO CL-1234567 date of accident ' WHEN 1 THEN 'Policy Schedule tax invoice ' WHEN 2 THEN 'loss city, intimation, accident date ' ELSE '' END || text"


@query(
    "enr3_classify",
    f"""SELECT doc_id, CASE WHEN r AND c >= 2 THEN 'claim' WHEN p >= 2 AND c <= 1 THEN 'policy' WHEN c >= 3 THEN 'claim' ELSE 'unknown' END AS kind FROM (SELECT doc_id, {_MARK_SQL(K.POLICY_MARKERS)} AS p, {_MARK_SQL(K.CLAIM_MARKERS)} AS c,
        regexp_matches(x, '(?i)(^|[^A-Za-z0-9_])(CL|CLM)[-/ ]?[0-9]{{6,12}}($|[^A-Za-z0-9_])') AS r FROM (SELECT doc_id, x, lower(x) AS t FROM (SELECT doc_id, {_DOC_TYPE_TEXT} AS x FROM documents)))""",
)
def _(spark, d):
    n = F.col("doc_id") % 4
    head = F.when(n == 0, "CLAIM NO CL-1234567 date of accident ").when(n == 1, "Policy Schedule tax invoice ").when(
        n == 2, "loss city, intimation, accident date ").otherwise("")
    return load(spark, d, "documents").select("doc_id", FD.classify_documents(F.concat(head, "text")).alias("kind"))


def register_claims(spark, d):
    """Orders as a claim register with a written narrative."""
    k = F.col("claim_id")
    c = spread(claims(spark, d), "claim_id")
    story = F.concat(
        F.lit("On the highway near "), F.initcap(F.lower("state")), F.lit(" a truck overturned, "), k % 9 + 1,
        F.lit(" people killed. Registration MH-"), k % 50 + 1, F.lit("-AB-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" on NH-"), k % 90,
    )
    return c.select(
        k, F.concat(F.lit("Anil "), F.initcap(F.lower("segment"))).alias("insured_name"), F.lower("state").alias("state"),
        F.date_format("loss_date", "dd/MM/yyyy").alias("loss_date_raw"), story.alias("narrative"),
    )


@query(
    "enr4_anchors",
    f"""WITH {CLAIMS_SQL} SELECT claim_id, 'plate' AS kind, concat('MH', claim_id % 50 + 1, 'AB', lpad(CAST(claim_id % 10000 AS VARCHAR), 4, '0')) AS value FROM claims
      UNION ALL SELECT claim_id, 'name', 'Anil ' || upper(left(segment, 1)) || lower(substr(segment, 2)) FROM claims UNION ALL SELECT claim_id, 'corridor', concat('NH-', claim_id % 90) FROM claims
      UNION ALL SELECT claim_id, 'vehicle', 'truck' FROM claims UNION ALL SELECT claim_id, 'incident', x FROM claims, (VALUES ('overturn'), ('overturned'), ('killed')) AS t(x)
      UNION ALL SELECT claim_id, 'date', CAST(loss_date AS VARCHAR) FROM claims UNION ALL SELECT claim_id, 'window', CAST(CAST(loss_date + i AS DATE) AS VARCHAR) FROM claims, (VALUES (-1), (0), (1), (2)) AS w(i)
      UNION ALL SELECT claim_id, 'count', CAST(claim_id % 9 + 1 AS VARCHAR) FROM claims""",
)
def _(spark, d):
    kinds = ["plate", "name", "corridor", "vehicle", "incident", "date", "window", "count"]
    return N.build_anchors(register_claims(spark, d), kinds=kinds).drop("ordinal")


def told_claims(spark, d):
    """The register with narratives that also name a firm, a station, a hospital and the injured."""
    k = F.col("claim_id")
    more = F.concat(
        F.lit(" Owner: Gupta Roadways Pvt. Reported at Kharadi Police Station. Taken to Ruby Hospital Pune. "), k % 7 + 2,
        F.lit(" injured persons."),
    )
    return register_claims(spark, d).withColumn("narrative", F.concat("narrative", more))


@query("enr4_anchors_all_kinds")
def _(spark, d):
    return N.build_anchors(told_claims(spark, d))


@query("enr4_anchor_counts")
def _(spark, d):
    return N.anchor_counts(N.claim_anchors(register_claims(spark, d)))


@query("flt14_sufficient", "SELECT doc_id AS claim_id FROM (SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{9,}')))) AS n FROM documents) WHERE n >= 2")
def _(spark, d):
    long = F.array_distinct(F.filter(tokenize(F.col("text")), lambda w: F.length(w) >= 9))
    anchors = load(spark, d, "documents").select(
        F.col("doc_id").alias("claim_id"), F.lit("token").alias("kind"), F.explode(long).alias("value")
    )
    return FL.has_sufficient_anchors(anchors)


@query(
    "enr5_languages",
    """WITH o AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, list(lang ORDER BY n DESC, lang) AS ls FROM o GROUP BY 1)
    SELECT source, array_to_string(list_concat(['en'], list_filter(ls, lambda l: l <> 'en'), ['mr', 'hi']), ',') AS languages FROM s""",
)
def _(spark, d):
    seen = load(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    per = seen.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "lang"))).alias("l"))
    observed = F.transform("l", lambda x: x["lang"])
    by_state = F.array(*[F.lit(x) for x in K.STATE_LANGUAGES["MH"]])
    return per.select("source", F.array_join(N.claim_languages(observed, F.array().cast("array<string>"), by_state), ",").alias("languages"))


@query(
    "enr6_plan_terms",
    f"""WITH {CLAIMS_SQL}, c AS (SELECT claim_id, concat('MH', claim_id % 50 + 1, 'AB', lpad(CAST(claim_id % 10000 AS VARCHAR), 4, '0')) AS plate, '"Anil ' || upper(left(segment, 1)) || lower(substr(segment, 2)) || '"' AS nm, replace(lower(state), '_', ' ') AS st,
      CAST(loss_date AS VARCHAR) AS d, concat('NH-', claim_id % 90) AS nh, claim_id % 9 + 1 AS k FROM claims)
    SELECT claim_id, tier, query FROM c, (VALUES (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 4), (9, 4)) AS t(i, tier), LATERAL (SELECT CASE i WHEN 1 THEN plate || ' accident' WHEN 2 THEN plate || ' ' || st WHEN 3 THEN nm || ' ' || st || ' accident' WHEN 4 THEN nm || ' accident FIR'
      WHEN 5 THEN st || ' truck ' || 'overturn' WHEN 6 THEN st || ' overturn ' || d WHEN 7 THEN concat(st, ' ', k, ' killed overturn') WHEN 8 THEN 'site:youtube.com ' || plate WHEN 9 THEN 'site:youtube.com ' || st || ' overturn' END AS query)""",
)
def _(spark, d):
    keep = ["plate", "name", "vehicle", "incident", "date", "count"]
    packed = N.claim_anchors(register_claims(spark, d), kinds=keep, keep=["state"])
    place = F.struct(F.lit("place").alias("kind"), F.col("state").alias("value"), F.lit(0).alias("ordinal"))
    return N.plan_claims(packed.select("claim_id", F.concat("anchors", F.array(place)).alias("anchors")), 9).select("claim_id", "tier", "query")


@query("enr6_plan_terms_all_kinds")
def _(spark, d):
    return N.plan_claims(N.claim_anchors(told_claims(spark, d)), 20).select("claim_id", "tier", "query")
