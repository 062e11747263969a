"""Registered queries: pairs without given candidates, by time, by term weights and by draws across tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.operators import aggregates as A
from corrobora.operators import joins as J
from corrobora.operators import ranking as R
from corrobora.operators import similarity as SM
from corrobora.plans.q_joins import DOC_TERMS_SQL, ITEM_TERMS_SQL, doc_terms, item_terms
from corrobora.plans.registry import query
from corrobora.plans.roles import CLAIMS_SQL, claims, lst, sql_tokens
from corrobora.session import fresh_path, stored
from corrobora.sources import tables as T
from corrobora.sources.tables import load


def _editions(spark, d):
    """Shipments as pieces of evidence with a day and a number."""
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("piece")
    return load(spark, d, "lineitem").select(number, F.col("l_shipdate").cast("date").alias("publish_day"), F.col("l_extendedprice").alias("price"))


_EDITIONS_SQL = "ev AS (SELECT l_orderkey * 10 + l_linenumber AS piece, CAST(l_shipdate AS DATE) AS publish_day, l_extendedprice AS price FROM lineitem)"


@query(
    "jn8_nearest",
    f"""WITH {CLAIMS_SQL}, {_EDITIONS_SQL} SELECT claim_id, piece, gap_days, CAST(rank AS INT) AS rank FROM (SELECT claim_id, piece, date_diff('day', loss_date, publish_day) AS gap_days,
      row_number() OVER (PARTITION BY claim_id ORDER BY abs(date_diff('day', loss_date, publish_day)), date_diff('day', loss_date, publish_day), piece) AS rank
      FROM claims JOIN ev ON publish_day BETWEEN loss_date - 1 AND loss_date + 2) WHERE rank <= 5""",
)
def _(spark, d):
    """The five pieces of evidence nearest to each claim's day, of all evidence."""
    got = J.nearest_in_window(claims(spark, d).select("claim_id", "loss_date"), _editions(spark, d), 1, 2, 5, "piece")
    return got.select("claim_id", "piece", F.col("gap_days").cast("bigint").alias("gap_days"), "rank")


@query(
    "jn8_range",
    f"""WITH {CLAIMS_SQL}, {_EDITIONS_SQL} SELECT claim_id, piece, date_diff('day', loss_date, publish_day) AS gap_days
      FROM claims JOIN ev ON publish_day BETWEEN loss_date - 1 AND loss_date + 2 AND abs(amount - price) < 50""",
)
def _(spark, d):
    """Pairs within the window whose amounts agree: no key in common."""
    got = J.match_range(claims(spark, d).select("claim_id", "loss_date", "amount"), _editions(spark, d), 1, 2, near=("amount", "price", 50.0))
    return got.select("claim_id", "piece", F.col("gap_days").cast("bigint").alias("gap_days"))


@query(
    "sim1_cosine_join",
    f"""WITH dc AS (SELECT article_id, t, count(*) AS n FROM (SELECT doc_id AS article_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL),
    bc AS (SELECT claim_id, t, count(*) AS n FROM (SELECT item_id AS claim_id, unnest({sql_tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
    dn AS (SELECT article_id, sqrt(sum(n * n)) AS l, list((t, n) ORDER BY t) AS v FROM dc GROUP BY 1), bn AS (SELECT claim_id, sqrt(sum(n * n)) AS l FROM bc GROUP BY 1),
    cls AS (SELECT min(article_id) AS article_id, any_value(l) AS l, count(*) AS n_copies FROM dn GROUP BY v),
    dot AS (SELECT claim_id, article_id, sum(bc.n * dc.n) AS s FROM bc JOIN dc USING (t) GROUP BY ALL)
    SELECT claim_id, article_id, n_copies, round(s / (bn.l * cls.l), 6) AS cosine FROM dot JOIN cls USING (article_id) JOIN bn USING (claim_id) WHERE s / (bn.l * cls.l) >= 0.5 - 1e-9""",
)
def _(spark, d):
    """All passages and documents with a cosine of a half or more; equal documents stand once, with their number."""
    left = A.term_counts(load(spark, d, "benchmark").withColumnRenamed("item_id", "claim_id"), "claim_id", "text").select("claim_id", "term", "n")
    right = A.term_counts(load(spark, d, "documents").withColumnRenamed("doc_id", "article_id"), "article_id", "text").select("article_id", "term", "n")
    # Classes, sizes and products all read the counts.
    one, members = SM.vector_classes(stored(right), "article_id")
    sizes = members.groupBy(F.col("class_key").alias("article_id")).agg(F.count("*").alias("n_copies"))
    pairs = SM.cosine_join(left, one, "claim_id", "article_id", 0.5)
    return pairs.join(sizes, "article_id").select("claim_id", "article_id", "n_copies", F.round("cosine", 6).alias("cosine"))


_ORDER = lst([str(t) for t in K.TIER_DRAW_ORDER])


@query(
    "wn4_spanning_classes",
    f"""WITH RECURSIVE p AS (SELECT o_custkey, o_orderkey AS seq, CAST(least(CAST(left(o_orderpriority, 1) AS INT), 4) AS INT) AS tier, o_orderstatus || o_orderkey % 3 AS cls FROM orders),
    g AS (SELECT DISTINCT o_custkey, 0 AS i, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[]) AS used FROM p
      UNION ALL SELECT g.o_custkey, i + 1, CASE WHEN x.seq IS NULL THEN picked ELSE list_append(picked, x.seq) END, CASE WHEN x.seq IS NULL THEN used ELSE list_append(used, x.cls) END
      FROM g LEFT JOIN LATERAL (SELECT arg_min(p.seq, (list_contains(g.used, p.cls), p.seq)) AS seq, arg_min(p.cls, (list_contains(g.used, p.cls), p.seq)) AS cls FROM p
        WHERE p.o_custkey = g.o_custkey AND p.tier = CAST({_ORDER}[g.i % 9 + 1] AS INT) AND NOT list_contains(g.picked, p.seq)) x ON true
      WHERE i < 90 AND len(picked) < 10),
    last AS (SELECT o_custkey, arg_max(picked, i) AS picked FROM g GROUP BY 1)
    SELECT l.o_custkey, p.seq, p.tier, p.cls, CAST(i AS INT) AS pick FROM last l, unnest(range(1, len(picked) + 1)) AS u(i) JOIN p ON p.seq = l.picked[i] AND p.o_custkey = l.o_custkey""",
)
def _(spark, d):
    """Ten orders a customer, drawn across priorities, where a status and kind may stand in several of them."""
    tier = F.least(F.left("o_orderpriority", F.lit(1)).cast("int"), F.lit(4))
    p = load(spark, d, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("seq"), tier.alias("tier"), F.concat("o_orderstatus", F.col("o_orderkey") % 3).alias("cls"))
    return R.spanning_topk(p, "o_custkey", 10)


@query("src2_packed_texts", "SELECT md5(concat('[', text, chr(30), chr(27), 's', chr(13), ']')) AS digest, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    """Documents that hold the record separator and escape signs, packed and read back."""
    folder = fresh_path(spark, "packed")
    odd = F.concat(F.lit("["), "text", F.lit("\u001e\u001bs\r]"))
    T.write_documents(load(spark, d, "documents").select(odd.alias("text")), folder)
    back = T.read_documents(spark, folder, T.SEPARATOR)
    return back.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "jn7_top_names",
    f"""WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL}, h AS (SELECT claim_id, article_id, count(*) AS hits FROM it JOIN dt USING (term) GROUP BY ALL HAVING count(*) >= 3)
    SELECT claim_id, article_id, hits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY hits DESC, article_id) AS rank FROM h) WHERE rank <= 20""",
)
def _(spark, d):
    """The twenty articles that share most words with each claim: output grows with the claims only."""
    got = J.match_terms(item_terms(spark, d), doc_terms(spark, d), 3)
    return R.top_k(got, ["claim_id"], [F.col("hits").desc(), F.col("article_id").asc()], 20)
