"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.text import search_tokens
from corrobora.operators import aggregates as A
from corrobora.plans.q_joins import DOC_TERMS_SQL, ITEM_TERMS_SQL, doc_terms, item_terms
from corrobora.plans.registry import query
from corrobora.plans.roles import EVIDENCE_SQL, evidence, inlist, sql_host, sql_tokens
from corrobora.session import spread
from corrobora.sources.tables import load

_STATUS = ["O", "F", "P", "X"]


@query(
    "ag1_batch_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('F', 'X')) AS settled, CAST(floor(count(*) FILTER (WHERE o_orderstatus IN ('F', 'X')) * 100 / count(*) + 0.5) AS BIGINT) AS progress,
       sum(n)::BIGINT AS evidence, count(*) FILTER (WHERE n > 0) AS with_evidence, count(*) FILTER (WHERE s > 0) AS with_case_specific,
       """ + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s.lower()}" for s in _STATUS) +
    """ FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
)
def _(spark, d):
    per = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("evidence"), F.count_if(F.col("l_returnflag") == "R").alias("case_specific")
    )
    cases = load(spark, d, "orders").join(per, "o_orderkey", "left").fillna(0, ["evidence", "case_specific"])
    return A.batch_summary(cases.withColumn("status", F.col("o_orderstatus")), _STATUS, ["F", "X"])


@query(
    "ag2_band_counts",
    f"WITH {EVIDENCE_SQL} SELECT claim_id, count(*) AS n_all, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS n_{b.lower()}" for b in K.BANDS) + " FROM evidence GROUP BY 1",
)
def _(spark, d):
    return A.value_counts(evidence(spark, d), "claim_id", "band", K.BANDS)


@query(
    "ag3_overall_score",
    """SELECT o_custkey AS claim_id, round(avg(o_totalprice) + 1e-7, 2) AS overall_score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY 1""",
)
def _(spark, d):
    o = load(spark, d, "orders").select(
        F.col("o_custkey").alias("claim_id"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("article_id")
    )
    return A.overall_score(o)


@query(
    "ag4_casualty_tally",
    """SELECT l_suppkey, CAST(l_quantity AS INT) AS figure, count(*) AS n_sources FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2""",
)
def _(spark, d):
    q = F.col("l_quantity").cast("int")
    text = F.when(F.col("l_linenumber") % 2 == 1, F.concat(q, F.lit(" people killed on the road"))).otherwise(
        F.concat(F.lit("convoy of "), q, F.lit(" lorries"))
    )
    return A.casualty_tally(spread(load(spark, d, "lineitem"), "l_suppkey").withColumn("t", text), ["l_suppkey"], "t")


@query(
    "ag5_source_outcomes",
    """SELECT CAST(ts AS DATE) AS run, event_type AS source, bool_or(v > 30) AS used, CASE WHEN NOT bool_or(v > 30) THEN arg_min(props, event_id) END AS reason,
       max(value) AS elapsed_ms, count(*) AS n_calls FROM (SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS v FROM events) WHERE TRUE GROUP BY 1, 2""",
)
def _(spark, d):
    log = load(spark, d, "events").select(
        F.col("ts").cast("date").alias("run"), F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "error", False).otherwise(F.col("value") > 30).alias("ok"),
        F.col("props").alias("error"), F.col("event_id").alias("seq"), F.col("value").alias("elapsed_ms"),
    )
    return A.source_outcomes(log, ["run"])


_RUN = "[A-Z][a-z]{3,}(?:\\s+[A-Z][a-z]{3,})?"


@query(
    "ag6_harvest",
    f"""WITH {EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS rank FROM evidence),
    t AS (SELECT claim_id, rank, i AS pos, runs[i] AS term FROM (SELECT claim_id, rank, regexp_extract_all(snippet, '\\b{_RUN}\\b') AS runs FROM r WHERE rank <= 20), unnest(range(1, len(runs) + 1)) AS u(i)),
    c AS (SELECT claim_id, term, count(*) AS n, min((rank, pos)) AS first FROM t GROUP BY ALL HAVING count(*) >= 2),
    k AS (SELECT DISTINCT claim_id, lower(split_part(title, ' ', 1)) AS key FROM evidence)
    SELECT claim_id, term, n, pick FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, first, term) AS pick FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.claim_id = c.claim_id AND k.key = lower(term))) WHERE pick <= 6""",
)
def _(spark, d):
    from corrobora.operators.ranking import top_k

    ranked = top_k(evidence(spark, d), ["claim_id"], [F.col("score").desc(), F.col("article_id").asc()], 20)
    known = evidence(spark, d).select("claim_id", F.split_part("title", F.lit(" "), F.lit(1)).alias("value"))
    return A.harvest_terms(ranked, known, "snippet")


_TOK_SQL = f"""list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]+'), lambda t: length(t) >= 3 AND lower(t) NOT IN {inlist(K.SEARCH_STOPWORDS)} AND NOT regexp_matches(t, '^\\d+$'))"""


@query(
    "ag7_ordered_distinct",
    f"""SELECT source, min(o) AS ordinal, arg_max(v, o) AS value FROM (SELECT source, doc_id * 100000 + i AS o, t[i] AS v FROM (SELECT source, doc_id, {_TOK_SQL} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)) GROUP BY source, lower(v)""",
)
def _(spark, d):
    toks = load(spark, d, "documents").select("source", "doc_id", F.posexplode(search_tokens(F.col("text"))).alias("i", "value"))
    keyed = toks.select("source", (F.col("doc_id") * 100000 + F.col("i") + 1).alias("ordinal"), "value")
    return A.ordered_distinct(keyed, ["source"], "value", "ordinal")


@query(
    "ag8_anchor_coverage",
    f"""WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL}, a AS (SELECT claim_id, term, CASE WHEN length(term) >= 8 THEN 'long' ELSE 'short' END AS kind FROM it),
    m AS (SELECT claim_id, kind, term, article_id FROM a JOIN dt USING (term)),
    h AS (SELECT claim_id, kind, count(DISTINCT term) AS n_found, count(DISTINCT article_id) AS n_records FROM m GROUP BY ALL)
    SELECT claim_id, kind, count(*) AS n_anchors, coalesce(any_value(n_found), 0) AS n_found, coalesce(any_value(n_records), 0) AS n_records FROM a LEFT JOIN h USING (claim_id, kind) GROUP BY ALL""",
)
def _(spark, d):
    kind = F.when(F.length("term") >= 8, "long").otherwise("short")
    anchors = item_terms(spark, d).select("claim_id", kind.alias("kind"), F.col("term").alias("value"))
    matches = anchors.join(doc_terms(spark, d).withColumnRenamed("term", "value"), "value")
    return A.anchor_coverage(anchors, matches)


@query(
    "ag9_publication_span",
    """SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS earliest, count(*) FILTER (WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 30) AS n_in_window
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, d):
    ev = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("publish_day"), F.col("o_orderdate").cast("date").alias("loss_date")
    )
    return A.publication_span(ev, "l_orderkey", "loss_date", 30)


@query(
    "ag10_corroborate",
    f"""SELECT story_id, count(DISTINCT host) - 1 AS corroboration, least(max(score) + least((count(DISTINCT host) - 1) * 4, 12), 100) AS final_score
        FROM (SELECT page_id % 40 AS story_id, {sql_host('url')} AS host, page_id * 31 % 101 AS score FROM pages) GROUP BY 1""",
)
def _(spark, d):
    from corrobora.functions.urls import host_of

    n = F.col("page_id")
    s = load(spark, d, "pages").select((n % 40).alias("story_id"), host_of(F.col("url")).alias("host"), (n * 31 % 101).alias("score"))
    return A.corroborate(s, ["story_id"], "host", "score")


@query(
    "ag11_keywords",
    f"""SELECT claim_id, string_agg(value, ', ' ORDER BY ordinal, value) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ordinal, value) AS n FROM
        (SELECT claim_id, min(ordinal) AS ordinal, arg_max(v, ordinal) AS value FROM (SELECT doc_id AS claim_id, i AS ordinal, t[i] AS v FROM (SELECT doc_id, {_TOK_SQL} AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)) GROUP BY claim_id, lower(v))) WHERE n <= 24 GROUP BY 1""",
)
def _(spark, d):
    toks = load(spark, d, "documents").select(
        F.col("doc_id").alias("claim_id"), F.posexplode(search_tokens(F.col("text"))).alias("ordinal", "value")
    )
    return A.keywords(A.ordered_distinct(toks, ["claim_id"], "value", "ordinal"))


@query(
    "ag12_term_vectors",
    f"""SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS n_tokens, round(sqrt(sum(n * n)), 6) AS norm FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL) GROUP BY 1""",
)
def _(spark, d):
    counts = A.term_counts(load(spark, d, "documents"), "doc_id", "text")
    return A.vector_norms(counts, "doc_id").withColumn("norm", F.round("norm", 6))


@query(
    "ag13_audit_rollup",
    "SELECT user_id, count(*) AS n_actions, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_action, arg_min(event_type, (ts, event_id)) AS first_action FROM events GROUP BY 1",
)
def _(spark, d):
    log = load(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("action"), F.col("event_id").alias("seq"))
    return A.audit_rollup(log, "user_id")


@query(
    "ag14_unmapped_labels",
    "SELECT concat('k', json_extract_string(props, '$.k')) AS label, count(*) AS n FROM events GROUP BY 1",
)
def _(spark, d):
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return A.unmapped_labels(
        load(spark, d, "events").select(F.array(F.struct(k.alias("label"), F.lit("x").alias("value"))).alias("details")), "details"
    )


