"""Registered queries: streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.operators import maintenance as M
from corrobora.plans.q_joins import DOC_TERMS_SQL, ITEM_TERMS_SQL, item_terms
from corrobora.plans.registry import query
from corrobora.plans.roles import sql_tokens
from corrobora.session import fresh_path
from corrobora.sources.tables import load
from corrobora.streaming import jobs as J
from corrobora.streaming import keyed as KD
from corrobora.streaming import rolling as RL

_STATUS_SQL = "CASE event_type WHEN 'click' THEN 'parsing' WHEN 'view' THEN 'queued' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'done' ELSE 'searching' END"


@query(
    "st1_ingest",
    f"SELECT doc_id, lang, source, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT *, {sql_tokens('text')} AS t FROM documents)",
)
def _(spark, d):
    got = J.stream_ingest(J.read_stream(spark, d, "documents"))
    return got.select("doc_id", "lang", "source", "n_tokens", F.size("terms").alias("n_terms"))


@query(
    "st2_match",
    f"WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL} SELECT claim_id, article_id, count(*) AS hits FROM it JOIN dt USING (term) GROUP BY ALL HAVING count(*) >= 4",
)
def _(spark, d):
    return J.stream_match(J.read_stream(spark, d, "documents"), item_terms(spark, d), 4).drop("batch")


@query("st3_summary", "SELECT event_type AS status, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1")
def _(spark, d):
    s = J.read_stream(spark, d, "events").withColumn("status", F.col("event_type"))
    return J.stream_summary(s, "status").select("status", "n", "last_ts")


@query(
    "st4_repeat_suppression",
    "SELECT time_bucket(INTERVAL '30 minutes', ts) AS slot, user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY 1, 2, 3",
)
def _(spark, d):
    return J.stream_dedupe(J.read_stream(spark, d, "events"), ["user_id", "event_type"])


@query(
    "st5_outcomes",
    """SELECT date_trunc('day', ts) AS window_start, event_type AS source, bool_or(ok) AS used, count(*) AS n_calls, max(value) AS elapsed_ms,
       CASE WHEN NOT bool_or(ok) THEN arg_min(props, (ts, event_id)) END AS reason FROM (SELECT *, event_type <> 'error' AND value > 30 AS ok FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    s = J.read_stream(spark, d, "events").select(
        "ts", F.col("event_type").alias("source"), ((F.col("event_type") != "error") & (F.col("value") > 30)).alias("ok"),
        F.col("props").alias("error"), F.col("event_id").alias("seq"), F.col("value").alias("elapsed_ms"),
    )
    return J.stream_outcomes(s).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "st6_status",
    f"""WITH e AS (SELECT user_id, status, min((ts, event_id)) AS ft, count(*) AS n FROM (SELECT *, {_STATUS_SQL} AS status FROM events) GROUP BY ALL),
    c AS (SELECT user_id, ft AS c FROM e WHERE status = 'cancel'), n AS (SELECT user_id, sum(n)::BIGINT AS n_events FROM e GROUP BY 1),
    b AS (SELECT user_id, arg_max(status, ft) AS prev FROM e JOIN c USING (user_id) WHERE status <> 'cancel' AND ft < c GROUP BY 1),
    s AS (SELECT user_id, arg_min(status, ft) FILTER (WHERE status IN ('done', 'failed', 'skipped')) AS settled, arg_max(status, ft) FILTER (WHERE status <> 'cancel') AS last FROM e GROUP BY 1)
    SELECT user_id, n_events, CASE WHEN c IS NOT NULL AND coalesce(prev, 'queued') IN ('queued', 'parsed') THEN 'skipped' ELSE coalesce(settled, last, 'queued') END AS status
    FROM n LEFT JOIN c USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN s USING (user_id)""",
)
def _(spark, d):
    t = F.col("event_type")
    status = (
        F.when(t == "click", "parsing").when(t == "view", "queued").when(t == "error", "cancel").when(t == "purchase", "done").otherwise("searching")
    )
    s = J.read_stream(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), status.alias("status"))
    return J.stream_status(s, "user_id")


_CHANGED = "(o_orderkey % 3 = 0)"


@query(
    "st1_upsert",
    f"""SELECT o_orderkey AS id, CASE WHEN {_CHANGED} THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_orderstatus AS status FROM orders
        UNION ALL SELECT -c_custkey - 1, c_acctbal, 'queued' FROM customer""",
)
def _(spark, d):
    """A register of orders under a stream of changed orders and one of new customers, kept by key."""
    table = KD.KeyedTable(spark, fresh_path(spark, "register"), "id long, amount double, status string", "id", 16)
    orders = lambda df: df.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    merge = lambda old, new: M.upsert_cases(old, new, "id", ["amount"])
    table.apply(0, orders(load(spark, d, "orders")), merge)
    changed = orders(J.read_stream(spark, d, "orders").where(_CHANGED)).select(
        "id", (F.col("amount") + 1).alias("amount"), F.lit("queued").alias("status"))
    KD.stream_upsert(changed, table, merge, fresh_path(spark, "stream-state"), first=1)
    new = J.read_stream(spark, d, "customer").select((-F.col("c_custkey") - 1).alias("id"), F.col("c_acctbal").alias("amount"), F.lit("queued").alias("status"))
    KD.stream_upsert(new, table, merge, fresh_path(spark, "stream-state"), first=1_000_000)
    return table.read()


@query(
    "st4_rolling",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, ts FROM events),
    p AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL
      UNION ALL SELECT q.user_id, q.event_type, q.ts FROM (SELECT p.user_id, p.event_type, min(e.ts) AS ts FROM p JOIN e ON e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts >= p.ts + INTERVAL 30 MINUTE GROUP BY p.user_id, p.event_type) q)
    SELECT p.user_id, p.event_type, min(e.event_id) AS event_id, p.ts FROM p JOIN e USING (user_id, event_type, ts) GROUP BY ALL""",
)
def _(spark, d):
    """Events that pass when a key is silent for thirty minutes after each pass."""
    got = RL.stream_rolling(J.read_stream(spark, d, "events"), ["user_id", "event_type"], "event_id")
    return got.select("user_id", "event_type", F.col("id").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("st6_settling")
def _(spark, d):
    """Cases with state that ends."""
    t = F.col("event_type")
    status = (
        F.when(t == "click", "parsing").when(t == "view", "queued").when(t == "error", "cancel").when(t == "purchase", "done").otherwise("searching")
    )
    s = J.read_stream(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), status.alias("status"))
    return RL.stream_settling(s, "user_id")


@query(
    "st2_top",
    f"""WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL}, h AS (SELECT claim_id, article_id, count(*) AS hits FROM it JOIN dt USING (term) GROUP BY ALL HAVING count(*) >= 4)
    SELECT claim_id, article_id, hits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY hits DESC, article_id) AS rank FROM h) WHERE rank <= 20""",
)
def _(spark, d):
    """Arriving articles matched to claims: the twenty best of each claim so far."""
    return J.stream_top(J.read_stream(spark, d, "documents"), item_terms(spark, d), 4, 20)
