"""Registered queries: sources, sinks and schema mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.plans.registry import query
from corrobora.plans.roles import CLAIMS_SQL, EVIDENCE_SQL, claims, evidence, sql_meaningful
from corrobora.session import fresh_path
from corrobora.sources import registers as R
from corrobora.sources import sinks as S
from corrobora.sources.tables import load, read_documents, write_documents

_COUNTED = ["orders", "lineitem", "events", "documents", "pages", "conversations"]


@query(
    "src1_load_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED),
)
def _(spark, d):
    out = None
    for t in _COUNTED:
        one = load(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "src2_read_documents",
    "SELECT sha256(text) AS digest, length(text) AS n_chars, count(*) AS n_copies FROM documents GROUP BY 1, 2",
)
def _(spark, d):
    path = fresh_path(spark, "texts")
    write_documents(load(spark, d, "documents"), path)
    texts = read_documents(spark, path, "\u001e")
    return (
        texts.groupBy(F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))
        .agg(F.count("*").alias("n_copies"))
    )


def _sheet(spark, d):
    """Customers of each nation as a loose sheet: title, blank line, header, data rows."""
    c = load(spark, d, "customer")
    head = load(spark, d, "nation").select(
        F.col("n_nationkey").alias("src"),
        F.inline(F.array(*[
            F.struct(F.lit(r).cast("bigint").alias("row_no"), F.lit(i).alias("col_no"), F.lit(v).alias("cell"))
            for r, i, v in [
                (0, 0, "Register of claims"), (1, 0, ""), (2, 0, "Claim Number"), (2, 1, "Insured Name"),
                (2, 2, "Loss City"), (2, 3, "Account"),
            ]
        ])),
    )
    body = c.select(
        F.col("c_nationkey").alias("src"),
        F.inline(F.array(*[
            F.struct((F.col("c_custkey") + 3).alias("row_no"), F.lit(i).alias("col_no"), v.cast("string").alias("cell"))
            for i, v in enumerate([
                F.concat(F.lit("C"), F.col("c_custkey")), F.col("c_name"),
                F.when(F.col("c_custkey") % 4 == 0, F.lit(" n/a ")).otherwise(F.col("c_mktsegment")), F.col("c_acctbal"),
            ])
        ])),
    )
    return head.unionByName(body)


@query(
    "src3_register_rows",
    """SELECT c_nationkey AS src, c_custkey + 3 AS row_no, concat('C', c_custkey) AS claim_id, c_name AS insured_name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS accident_location_city FROM customer""",
)
def _(spark, d):
    return R.read_register(_sheet(spark, d), ["claim_id", "insured_name", "accident_location_city"])


_LABELS = [
    ("insured", "part of"), ("name", "name"), ("type", "type of item"), ("brand", "brand"), ("size", "size"),
    ("price", "retail price"), ("price", "price"), ("colour", "blue"), ("colour", "red"), ("kind", "widget"),
    ("kind", "small"), ("fastener", "bolt"),
]
_SYN_SQL = ", ".join(f"({i}, '{f}', '{s}')" for i, (f, s) in enumerate(_LABELS))


@query(
    "src4_map_headers",
    f"""WITH syn(o, field, s) AS (VALUES {_SYN_SQL}),
    lab AS (SELECT DISTINCT p_name AS label, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM part),
    scored AS (SELECT label, field, o, CASE WHEN n = s THEN 1000 + length(s) WHEN starts_with(n, s || ' ') THEN 600 + length(s)
      WHEN ends_with(n, ' ' || s) THEN 500 + length(s) WHEN contains(n, ' ' || s || ' ') THEN 400 + length(s)
      WHEN length(s) >= 5 AND contains(n, s) THEN 100 + length(s) END AS score FROM lab, syn),
    best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, o) AS r FROM scored WHERE score IS NOT NULL)
    SELECT lab.label, best.field, best.score FROM lab LEFT JOIN best ON lab.label = best.label AND r = 1""",
)
def _(spark, d):
    labels = load(spark, d, "part").select(F.col("p_name").alias("label")).distinct()
    return R.map_headers(labels, "label", _LABELS)


_EVENT_FIELDS = [("claim_id", "click"), ("insured_name", "view"), ("state", "error"), ("hospital_name", "purchase")]
_EVENT_NAMES = [f for f, _ in _EVENT_FIELDS]


@query(
    "src5_pivot_key_values",
    "WITH m AS (SELECT user_id, "
    + ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{s}') AS {f}" for f, s in _EVENT_FIELDS)
    + " FROM events GROUP BY user_id) SELECT * FROM m WHERE "
    + " + ".join(f"(CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END)" for f in _EVENT_NAMES)
    + " >= 2",
)
def _(spark, d):
    return R.pivot_key_values(load(spark, d, "events"), "user_id", "event_type", "value", "event_id", _EVENT_NAMES, _EVENT_FIELDS)


@query(
    "src6_collect_unmapped",
    f"""SELECT o_orderkey, len(x) AS n_details, array_to_string(x, ';') AS details FROM (
      SELECT o_orderkey, list_filter([CASE WHEN {sql_meaningful('o_orderstatus')} THEN 'o_orderstatus=' || o_orderstatus END,
        CASE WHEN {sql_meaningful('o_orderpriority')} THEN 'o_orderpriority=' || o_orderpriority END], lambda v: v IS NOT NULL) AS x
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders))""",
)
def _(spark, d):
    o = load(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderpriority",
    )
    got = R.collect_unmapped(o, ["o_orderkey"])
    return got.select(
        "o_orderkey", F.size("additional_details").cast("bigint").alias("n_details"),
        F.array_join(F.transform("additional_details", lambda p: F.concat(p["label"], F.lit("="), p["value"])), ";").alias("details"),
    )


@query(
    "src7_clean_cells",
    f"""SELECT c_custkey, CASE WHEN {sql_meaningful('seg')} THEN trim(seg) END AS segment, strftime(day, '%Y-%m-%d') AS day FROM (
      SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' NIL ' WHEN 1 THEN ' -- ' ELSE '  ' || c_mktsegment END AS seg,
      DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS day FROM customer)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    raw = load(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 5 == 0, " NIL ").when(k % 5 == 1, " -- ").otherwise(F.concat(F.lit("  "), "c_mktsegment")).alias("segment"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).alias("day"),
    )
    return R.clean_cells(raw, ["segment", "day"])


@query(
    "src8_split_list",
    """SELECT p_partkey, len(x) AS n_items, array_to_string(x, '|') AS items FROM (SELECT p_partkey,
       list_filter(list_transform(string_split_regex(replace(p_name, ' ', ' ;, ') || ',' || p_brand, '[,;\\n]'), lambda v: trim(v)), lambda v: v <> '') AS x FROM part)""",
)
def _(spark, d):
    from corrobora.functions.text import split_list

    items = split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ;, ")), F.lit(","), "p_brand"))
    return load(spark, d, "part").select("p_partkey", items.alias("x")).select(
        "p_partkey", F.size("x").cast("bigint").alias("n_items"), F.array_join("x", "|").alias("items")
    )


@query(
    "src9_dedupe_most_complete",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS value FROM events)
    SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
       (CASE WHEN event_type IS NULL THEN 0 ELSE 1 END) + (CASE WHEN value IS NULL THEN 0 ELSE 1 END) DESC, event_id) AS r FROM e) WHERE r = 1""",
)
def _(spark, d):
    e = load(spark, d, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("value"),
    )
    return R.dedupe_most_complete(e, "user_id", "event_id")


@query(
    "src10_ensure_id",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(concat(source, chr(31), text)) END AS claim_id FROM documents""",
)
def _(spark, d):
    docs = load(spark, d, "documents").withColumn("claim_id", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")))
    return R.ensure_id(docs, ["source", "text"]).select("doc_id", "claim_id")


@query(
    "src11_merge_case_documents",
    """WITH t AS (SELECT conv_id AS archive, concat(CASE turn % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'note' WHEN 2 THEN 'Claim' ELSE 'intimation' END, turn) AS name,
        CASE WHEN turn % 4 = 0 THEN 'policy' ELSE 'claim' END AS type, text FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY CASE WHEN contains(lower(name), 'intimation') THEN 0 WHEN contains(lower(name), 'claim') THEN 1
        WHEN contains(lower(name), 'policy') THEN 3 ELSE 2 END, name) AS n FROM t),
    k AS (SELECT *, bool_or(type <> 'policy') OVER (PARTITION BY archive) AS has_claim FROM r WHERE n <= 6)
    SELECT archive, count(*) AS n_used, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM k WHERE NOT has_claim OR type <> 'policy' GROUP BY archive""",
)
def _(spark, d):
    turn = F.col("turn")
    docs = load(spark, d, "conversations").select(
        F.col("conv_id").alias("archive"),
        F.concat(F.when(turn % 4 == 0, "policy").when(turn % 4 == 1, "note").when(turn % 4 == 2, "Claim").otherwise("intimation"), turn).alias("name"),
        F.when(turn % 4 == 0, "policy").otherwise("claim").alias("type"), "text",
    )
    return R.merge_case_documents(docs)


_HAVE = {"claim_id": "CAST(claim_id AS VARCHAR)", "insured_name": "insured_name", "loss_location": "state",
         "accident_date_time": "CAST(loss_date AS VARCHAR)", "accident_location_region": "region", "state": "state",
         "FIR_cause_narrative": "priority"}


def _contract_sql():
    cols = []
    for header, fields, default in K.CONTRACT_COLUMNS:
        tried = [f"nullif({_HAVE[f]}, '')" for f in fields if f in _HAVE]
        last = "NULL" if default is None else f"'{default}'"
        cols.append(f"coalesce({', '.join(tried + [last])}) AS \"{header}\"")
    return f"WITH {CLAIMS_SQL} SELECT {', '.join(cols)} FROM claims"


@query("snk1_contract", _contract_sql())
def _(spark, d):
    c = claims(spark, d)
    facts = c.select(
        "claim_id", "insured_name", F.col("state").alias("loss_location"), F.col("loss_date").alias("accident_date_time"),
        F.col("region").alias("accident_location_region"), "state", F.col("priority").alias("FIR_cause_narrative"),
    )
    return S.to_contract(facts)


@query(
    "snk2_batch_register",
    f"""WITH {EVIDENCE_SQL}, src AS (SELECT DISTINCT source AS claim_id FROM documents UNION SELECT 'none' AS claim_id)
    SELECT src.claim_id, count(article_id) AS evidence, coalesce(sum(CASE WHEN case_specific THEN 1 ELSE 0 END), 0)::BIGINT AS case_specific,
      arg_min(domain, (-score, article_id)) AS top_source, max(score) AS top_score, arg_min(url, (-score, article_id)) AS top_url
    FROM src LEFT JOIN evidence USING (claim_id) GROUP BY src.claim_id""",
)
def _(spark, d):
    e = evidence(spark, d)
    cases = e.select("claim_id").distinct().unionByName(spark.range(1).select(F.lit("none").alias("claim_id")))
    return S.batch_register(cases, e)


@query(
    "snk3_evidence_bundle",
    f"""WITH {EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE band WHEN 'CONFIRMED' THEN 1 WHEN 'STRONG' THEN 2 ELSE 3 END, score DESC, article_id) AS rank FROM evidence)
    SELECT claim_id, count(*) AS n_items, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM
      (SELECT claim_id, rank, split_part(url, '/a/', 2) AS article_id FROM r WHERE rank <= {K.RANK_LIMIT_BATCH}) GROUP BY claim_id""",
)
def _(spark, d):
    from corrobora.operators.ranking import rank_evidence

    e = evidence(spark, d)
    bundle = S.evidence_bundle(e.select("claim_id").distinct(), rank_evidence(e, K.RANK_LIMIT_BATCH))
    items = F.from_json("bundle", "claim_id STRING, evidence ARRAY<STRUCT<url: STRING, score: INT>>")["evidence"]
    return bundle.select(
        "claim_id", F.size(items).cast("bigint").alias("n_items"),
        F.array_join(F.transform(items, lambda i: F.substring_index(i["url"], "/a/", -1)), ",").alias("ids"),
    )


@query(
    "snk4_flatten_links",
    """SELECT page_id, g AS "group", CASE g WHEN 'plain' THEN url ELSE url || '#' || l END AS link, l AS label FROM pages,
       (VALUES ('plain', 'open'), ('news', 'day'), ('news', 'week')) AS t(g, l)""",
)
def _(spark, d):
    link = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("link"))
    tag = lambda x: F.concat("url", F.lit("#" + x))
    groups = F.array(
        F.struct(F.lit("plain").alias("group"), F.array(link("open", F.col("url"))).alias("links")),
        F.struct(F.lit("news").alias("group"), F.array(link("day", tag("day")), link("week", tag("week"))).alias("links")),
    )
    return S.flatten_links(load(spark, d, "pages").select("page_id", groups.alias("groups")))


@query(
    "snk5_field_values",
    f"""SELECT c_custkey, field, value FROM (
      SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL
      SELECT c_custkey, 'segment', CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE c_mktsegment END FROM customer UNION ALL
      SELECT c_custkey, 'As printed', concat('N', c_nationkey) FROM customer) WHERE {sql_meaningful('value')}""",
)
def _(spark, d):
    c = load(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.array(F.struct(F.lit("As printed").alias("label"), F.concat(F.lit("N"), "c_nationkey").alias("value"))).alias("extra"),
    )
    return S.to_field_values(c, "c_custkey", ["c_name", "segment"], "extra")


@query(
    "snk6_evidence_sheet",
    f"""WITH {EVIDENCE_SQL} SELECT claim_id, article_id, score, domain, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS rank FROM evidence""",
)
def _(spark, d):
    return S.evidence_sheet(evidence(spark, d).select("claim_id", "article_id", "score", "domain"))


