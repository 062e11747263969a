"""Registered queries: ranks, top-k, ordering, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions.urls import canonical_url
from corrobora.operators import maintenance as M
from corrobora.operators import ranking as R
from corrobora.plans.q_columns import _CANON, _PAGES_KEPT
from corrobora.plans.registry import query
from corrobora.plans.roles import EVIDENCE_SQL, evidence, inlist, lst
from corrobora.sources.tables import load

_BAND_CASE = "CASE band WHEN 'CONFIRMED' THEN 1 WHEN 'STRONG' THEN 2 ELSE 3 END"


@query(
    "wn1_rank_evidence",
    f"WITH {EVIDENCE_SQL} SELECT claim_id, article_id, band, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY {_BAND_CASE}, score DESC, article_id) AS rank FROM evidence) WHERE rank <= {K.RANK_LIMIT}",
)
def _(spark, d):
    e = evidence(spark, d).select("claim_id", "article_id", "band", "score")
    return R.rank_evidence(e)


@query(
    "wn2_dedupe_by_url",
    f"""WITH p AS (SELECT page_id AS article_id, {_CANON} AS url_key, CAST(page_id * 31 % 101 AS INT) AS score, html FROM {_PAGES_KEPT}),
    q AS (SELECT article_id, regexp_replace(url_key, '[0-9]+', '', 'g') AS url_key, score, html FROM p)
    SELECT url_key, arg_max(article_id, (score, article_id)) AS article_id, max(score) AS score, max(length(html)) AS n_chars, count(*) AS n_copies FROM q GROUP BY 1""",
)
def _(spark, d):
    n = F.col("page_id")
    p = load(spark, d, "pages").select(
        n.alias("article_id"), F.regexp_replace(canonical_url(F.col("url")), "[0-9]+", "").alias("url_key"),
        (n * 31 % 101).cast("int").alias("score"), F.col("html").alias("snippet"),
    )
    got = R.dedupe_by_url(p)
    return got.select("url_key", "article_id", "score", F.length("snippet").cast("bigint").alias("n_chars"), "n_copies")


@query(
    "wn3_first_seen",
    f"SELECT url_key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT page_id, url, split_part({_CANON}, '/', 1) AS url_key FROM {_PAGES_KEPT}) GROUP BY 1",
)
def _(spark, d):
    p = load(spark, d, "pages").select("page_id", "url", F.substring_index(canonical_url(F.col("url")), "/", 1).alias("url_key"))
    return R.first_seen(p, "url_key", "page_id")


_WN4_OFF = "CASE tier WHEN 1 THEN (n // 3) * 9 + list_extract([0, 1, 5], n % 3 + 1) ELSE (n // 2) * 9 + (n % 2) * 4 + tier END"


@query(
    "wn4_interleaved_topk",
    f"""WITH p AS (SELECT o_custkey, o_orderkey AS seq, CAST(least(CAST(left(o_orderpriority, 1) AS INT), 4) AS INT) AS tier, concat(least(CAST(left(o_orderpriority, 1) AS INT), 4), '-', o_orderstatus) AS cls FROM orders),
    c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, tier, cls ORDER BY seq) AS c FROM p),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey, tier ORDER BY CASE WHEN c > 1 THEN 1 ELSE 0 END, seq) - 1 AS INT) AS n FROM c),
    s AS (SELECT *, CAST({_WN4_OFF} AS INT) AS slot FROM t)
    SELECT o_custkey, seq, tier, cls, slot, pick FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY slot) AS pick FROM s) WHERE pick <= 10""",
)
def _(spark, d):
    tier = F.least(F.left("o_orderpriority", F.lit(1)).cast("int"), F.lit(4))
    p = load(spark, d, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("seq"), tier.alias("tier"), F.concat(tier, F.lit("-"), "o_orderstatus").alias("cls")
    )
    return R.interleaved_topk(p, "o_custkey", 10)


@query(
    "wn5_round_robin",
    """WITH p AS (SELECT p_brand, p_partkey AS seq, p_size % 4 + 1 AS tier, concat(p_type, '-', p_size) AS cls, p_size = 7 AS leader, p_type AS family FROM part),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, family ORDER BY seq) AS r FROM p) WHERE r = 1),
    dealt AS (SELECT *, row_number() OVER (PARTITION BY p_brand, tier ORDER BY seq) AS n FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY leader DESC, n, tier, seq) AS pick FROM dealt)
    SELECT p_brand, family, tier, cls, seq, leader, pick, platform FROM k, (VALUES ('a.example'), ('b.example')) AS t(platform) WHERE pick <= 5""",
)
def _(spark, d):
    p = load(spark, d, "part").select(
        "p_brand", F.col("p_partkey").alias("seq"), (F.col("p_size") % 4 + 1).alias("tier"),
        F.concat("p_type", F.lit("-"), "p_size").alias("cls"), (F.col("p_size") == 7).alias("leader"),
    )
    return R.round_robin_topk(p, "p_brand", ["a.example", "b.example"], 5)


TOKENS_SQL = f"""tok AS (SELECT doc_id, i AS pos, t[i] AS raw, lower(t[i]) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]+') AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)
  WHERE length(t[i]) >= 3 AND lower(t[i]) NOT IN {inlist(K.SEARCH_STOPWORDS)} AND NOT regexp_matches(t[i], '^\\d+$'))"""


@query(
    "wn6_top_tokens",
    f"""WITH {TOKENS_SQL}, g AS (SELECT doc_id, token, count(*) AS n, min(pos) AS pos, arg_min(raw, pos) AS raw FROM tok GROUP BY ALL),
    s AS (SELECT doc_id, token, pos, least(length(token), 12) + CASE WHEN regexp_matches(raw, '^\\p{{Lu}}') THEN 4 ELSE 0 END - CASE WHEN list_contains({lst(defaults.INCIDENT_TERMS + defaults.VEHICLE_TYPES)}, token) THEN 3 ELSE 0 END - CASE WHEN n > 2 THEN 2 ELSE 0 END AS token_score FROM g)
    SELECT doc_id, token, token_score, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token_score DESC, pos) AS ordinal FROM s) WHERE ordinal <= 8""",
)
def _(spark, d):
    return R.top_tokens(load(spark, d, "documents"), "doc_id", "text").drop("pos")


@query(
    "wn7_order_sources",
    "SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 1 WHEN 'es' THEN 2 WHEN 'en' THEN 50 ELSE 99 END AS preference FROM documents",
)
def _(spark, d):
    got = R.order_sources(load(spark, d, "documents").select("doc_id", "lang"), ["fr", "es"])
    return got.orderBy("preference", "doc_id")


@query("wn8_newest_first", "SELECT event_id, user_id, ts, event_type FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", "user_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))


@query(
    "wn9_top_text",
    f"WITH {EVIDENCE_SQL} SELECT claim_id, md5(string_agg(snippet, ' ' ORDER BY n)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS n FROM evidence) WHERE n <= 4 GROUP BY 1",
)
def _(spark, d):
    got = R.top_text(evidence(spark, d), "claim_id", [F.col("score").desc(), F.col("article_id").asc()], "snippet")
    return got.select("claim_id", F.md5("text").alias("digest"))


_BOILER = "^(Terms|Copyright|Subscribe)|eaninges"


@query(
    "wn10_narrative",
    f"""SELECT doc_id, arg_max(line, (length(line), -pos)) AS narrative FROM (SELECT doc_id, i AS pos, trim(ls[i]) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))
        WHERE length(line) > 60 AND length(line) - length(replace(line, ' ', '')) > 8 AND NOT contains(line, '|') AND NOT regexp_matches(line, '{_BOILER}') GROUP BY 1""",
)
def _(spark, d):
    return R.pick_narrative(load(spark, d, "documents"), "doc_id", "text", _BOILER)


@query(
    "set1_union_sources",
    """SELECT 'customer' AS provenance, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""",
)
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return M.union_sources({"customer": c, "supplier": s})


def _sides(spark, d):
    """Two whole tables with overlapping ids: suppliers and customers."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("queued").alias("status"))
    return c, s


_C_SQL = "c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS status FROM customer)"
_S_SQL = "s AS (SELECT s_suppkey AS id, s_name AS name, 'queued' AS status FROM supplier)"


@query("set2_replace_by_key", f"WITH {_C_SQL}, {_S_SQL} SELECT * FROM s UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM s)")
def _(spark, d):
    old, new = _sides(spark, d)
    return M.replace_by_key(old, new, "id")


@query(
    "set3_upsert",
    """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status FROM orders), n AS (SELECT c_custkey * 11 AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount, 'queued' AS status FROM customer)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.amount, o.amount) AS amount, CASE WHEN o.id IS NULL THEN n.status ELSE o.status END AS status FROM o FULL JOIN n ON o.id = n.id""",
)
def _(spark, d):
    old = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    new = load(spark, d, "customer").select(
        (F.col("c_custkey") * 11).alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("amount"), F.lit("queued").alias("status")
    )
    return M.upsert_cases(old, new, "id", ["amount"])


@query("set4_insert_new", f"WITH {_C_SQL}, {_S_SQL} SELECT * FROM s UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM s)")
def _(spark, d):
    new, old = _sides(spark, d)
    return M.insert_new(old, new, "id")


_CHILD = "l_orderkey AS id, l_linenumber AS line, l_quantity AS qty"


@query(
    "set5_replace_children",
    f"""WITH n AS (SELECT o_orderkey AS id, 1 AS line, CAST(o_custkey AS DOUBLE) AS qty FROM orders WHERE o_orderstatus = 'P') SELECT id, count(*) AS n_rows, sum(qty) AS qty FROM
        (SELECT {_CHILD} FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, line, qty FROM n) GROUP BY 1""",
)
def _(spark, d):
    old = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    new = load(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("id"), F.lit(1).alias("line"), F.col("o_custkey").cast("double").alias("qty")
    )
    return M.replace_children(old, new, "id").groupBy("id").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty"))


@query(
    "set6_delete_cases",
    """SELECT 'orders' AS table_name, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS key_sum FROM orders WHERE o_orderstatus <> 'P' UNION ALL
       SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    tables = {"orders": o.select("id"), "lineitem": load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))}
    left = M.delete_cases(tables, o.where("o_orderstatus = 'P'").select("id"), "id")
    counted = [t.agg(F.count("*").alias("n_rows"), F.sum("id").alias("key_sum")).select(F.lit(n).alias("table_name"), "*") for n, t in left.items()]
    return counted[0].unionByName(counted[1])


@query(
    "set7_expand_terms",
    """SELECT p_name, site, term, q AS query FROM (SELECT DISTINCT ON (q) p_name, site, term, q FROM (SELECT DISTINCT p_name, site, term, site || ' ' || p_name || ' ' || term AS q FROM part, (VALUES ('news'), ('web')) AS s(site), (VALUES ('crash'), ('fire')) AS t(term)))""",
)
def _(spark, d):
    q = F.concat_ws(" ", "site", "p_name", "term")
    return M.expand_terms(load(spark, d, "part").select("p_name"), {"site": ["news", "web"], "term": ["crash", "fire"]}, q)
