"""Registered queries: entity-linking joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import urls as U
from corrobora.functions.phonetics import latin_words, phonetic_key
from corrobora.functions.text import spelled_words, tokenize, words
from corrobora.operators import joins as J
from corrobora.operators import ranking as R
from corrobora.plans.registry import query
from corrobora.plans.roles import CLAIMS_SQL, claims, sql_fold, sql_host, sql_phonetic, sql_spelled_words, sql_tokens
from corrobora.session import values_frame
from corrobora.sources.tables import load


def doc_terms(spark, d):
    """(article_id, term): distinct tokens of each document. Distinct per row, so no shuffle."""
    docs = load(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("article_id"), F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def item_terms(spark, d):
    """(claim_id, term): distinct tokens of each benchmark passage."""
    items = load(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("claim_id"), F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


DOC_TERMS_SQL = f"dt AS (SELECT DISTINCT article_id, term FROM (SELECT doc_id AS article_id, {sql_tokens('text')} AS ts FROM documents), unnest(ts) AS u(term))"
ITEM_TERMS_SQL = f"it AS (SELECT DISTINCT claim_id, term FROM (SELECT item_id AS claim_id, {sql_tokens('text')} AS ts FROM benchmark), unnest(ts) AS u(term))"


@query(
    "jn1_case_detail",
    """SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_items, coalesce(sum(l_linenumber), 0)::BIGINT AS line_sum, max(l_suppkey) AS top_source
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def _(spark, d):
    li = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source")
    )
    cases = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    detail = J.case_detail(cases, {"evidence": li}, "o_orderkey", "line")
    items = F.from_json("items", "ARRAY<STRUCT<line: INT, source: BIGINT>>")
    one = detail.select("o_orderkey", "o_orderstatus", "n_items", items.alias("i"))
    # The nested lists are chunked, so a case is summed over its chunks.
    return one.groupBy("o_orderkey", "o_orderstatus").agg(
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum(F.aggregate("i", F.lit(0).cast("bigint"), lambda a, x: a + x["line"])), F.lit(0)).alias("line_sum"),
        F.max(F.array_max(F.transform("i", lambda x: x["source"]))).alias("top_source"),
    )


@query("jn2_lookup", "SELECT n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    dim = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return J.lookup(load(spark, d, "nation"), dim, "n_regionkey").select("n_name", "region")


_TIERS = [("example.org", 24), ("ththan.example.net", 30), ("example.net", 18), ("cheap-pills.example.com", 6)]
_HOST = sql_host("url")
_TIER_CASE = " ".join(
    f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN {s}" for h, s in sorted(_TIERS, key=lambda t: -t[1])
)


@query("jn3_domain_score", f"SELECT page_id, host, CASE WHEN host = '' THEN 0 {_TIER_CASE} ELSE 12 END AS domain_score FROM (SELECT page_id, {_HOST} AS host FROM pages)")
def _(spark, d):
    pages = load(spark, d, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))
    return J.domain_score(pages, "host", values_frame(spark, _TIERS, "host STRING, score INT"))


_CODE_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9][A-Z0-9-]*[A-Z0-9]'), lambda t: replace(t, '-', '')), lambda k: length(k) >= 6 AND regexp_matches(k, '[0-9]')))"


@query(
    "jn4_identifiers",
    f"""WITH c AS (SELECT doc_id, code FROM (SELECT doc_id, {_CODE_SQL} AS codes FROM documents), unnest(codes) AS u(code)),
    p AS (SELECT DISTINCT page_id AS claim_id, code FROM (SELECT page_id, {_CODE_SQL.replace('text', 'html')} AS codes FROM pages), unnest(codes) AS u(code)
          UNION SELECT o_orderkey, concat('REF', o_orderkey) FROM orders UNION SELECT doc_id, code FROM c)
    SELECT claim_id, p.code AS key, doc_id AS article_id FROM p JOIN c ON p.code = c.code""",
)
def _(spark, d):
    from corrobora.functions.identifiers import extract_codes

    docs = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), extract_codes(F.col("text"), 6).alias("keys"))
    pages = load(spark, d, "pages").select(F.col("page_id").alias("claim_id"), F.explode(extract_codes(F.col("html"), 6)).alias("key"))
    refs = load(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("REF"), "o_orderkey").alias("key"))
    seen = docs.select(F.col("article_id").alias("claim_id"), F.explode("keys").alias("key"))
    return J.match_identifiers(pages.unionByName(refs).unionByName(seen), docs)


@query(
    "jn4_identifier_hits",
    f"""WITH c AS (SELECT doc_id, code FROM (SELECT doc_id, {_CODE_SQL} AS codes FROM documents), unnest(codes) AS u(code))
    SELECT doc_id AS claim_id, code AS key, count(*) OVER (PARTITION BY code) AS n_articles, min(doc_id) OVER (PARTITION BY code) AS first_article FROM c""",
)
def _(spark, d):
    from corrobora.functions.identifiers import extract_codes

    docs = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), extract_codes(F.col("text"), 6).alias("keys"))
    return J.identifier_hits(docs.select(F.col("article_id").alias("claim_id"), F.explode("keys").alias("key")), docs)


def _sql_heard(docs: str, items: str, key: str) -> str:
    """SQL of the phonetic join between word lists (doc_id, word) and (item_id, word), with the key of a word."""
    return f"""WITH dw AS (SELECT DISTINCT doc_id AS article_id, word AS w FROM ({docs})),
    bw AS (SELECT DISTINCT item_id AS claim_id, word AS w FROM ({items})),
    k AS (SELECT w, {key} AS key FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
    a AS (SELECT claim_id, w AS value, key FROM bw JOIN k USING (w) WHERE length(key) >= 4),
    b AS (SELECT DISTINCT article_id, key FROM dw JOIN k USING (w) WHERE length(key) >= 4)
    SELECT claim_id, article_id, count(DISTINCT value) AS n_values FROM a JOIN b USING (key) GROUP BY ALL"""


def _sql_words(table: str, key: str) -> str:
    split = "string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')"
    return f"SELECT {key}, word FROM (SELECT {key}, {split} AS ws FROM {table}), unnest(ws) AS u(word) WHERE word <> ''"


@query("jn5_phonetic", _sql_heard(_sql_words("documents", "doc_id"), _sql_words("benchmark", "item_id"), sql_phonetic("w")))
def _(spark, d):
    listed = F.explode(F.array_distinct(words(F.col("text"))))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), listed.alias("word"))
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), listed.alias("value"))
    anchors = items.withColumn("key", phonetic_key(F.col("value")))
    return J.count_phonetic(anchors, docs)


@query(
    "jn5_phonetic_all_words",
    _sql_heard(sql_spelled_words("documents", "doc_id"), sql_spelled_words("benchmark", "item_id"), sql_phonetic(sql_fold("w"))),
)
def _(spark, d):
    """Words of any spelling and script; only the length of the key decides."""
    listed = lambda t, c, id, w: load(spark, d, t).select(
        F.col(c).alias(id), F.explode(F.array_distinct(spelled_words(F.col("text")))).alias(w)
    )
    docs, items = listed("documents", "doc_id", "article_id", "word"), listed("benchmark", "item_id", "claim_id", "value")
    keyed = lambda df, w: latin_words(df, w).select(F.col("token").alias(w), "key")
    return J.count_phonetic(items.join(keyed(items, "value"), "value"), docs, keys=keyed(docs, "word"))


_NAME7 = "SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS k FROM part"
_TYPE7 = "SELECT DISTINCT regexp_replace(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '[aeiou]', CASE WHEN p_size % 2 = 0 THEN 'y' ELSE '' END) AS k FROM part"


@query(
    "jn6_one_edit",
    f"SELECT a.k AS a, b.k AS b, levenshtein(a.k, b.k) AS edits FROM ({_NAME7}) a, ({_TYPE7}) b WHERE length(a.k) >= 7 AND length(b.k) >= 7 AND levenshtein(a.k, b.k) <= 1",
)
def _(spark, d):
    letters = F.regexp_replace(F.lower("p_name"), "[^a-z]", "")
    parts = load(spark, d, "part")
    first_vowel = lambda r: F.regexp_replace(letters, "^([^aeiou]*)[aeiou]", "$1" + r)
    a = parts.select(letters.alias("key"))
    b = parts.select(F.when(F.col("p_size") % 2 == 0, first_vowel("y")).otherwise(first_vowel("")).alias("key"))
    return J.match_one_edit(a, b)


@query(
    "jn7_names",
    f"""WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL}
    SELECT claim_id, article_id, count(*) AS hits FROM it JOIN dt USING (term) GROUP BY ALL HAVING count(*) >= 3""",
)
def _(spark, d):
    return J.match_terms(item_terms(spark, d), doc_terms(spark, d), 3)


@query(
    "jn7_names_with_place",
    f"""WITH {DOC_TERMS_SQL}, n AS (SELECT s_suppkey AS claim_id, x AS name, unnest(string_split(x, ' ')) AS term FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'edand erin' ELSE 'haed' END AS x FROM supplier)),
    p AS (SELECT DISTINCT s_suppkey AS claim_id, CASE WHEN s_suppkey % 3 = 0 THEN 'onre' ELSE 'nder' END AS term FROM supplier),
    s AS (SELECT claim_id, name, count(DISTINCT term) AS size FROM n GROUP BY ALL),
    h AS (SELECT claim_id, name, article_id, count(DISTINCT term) AS hits FROM n JOIN dt USING (term) GROUP BY ALL),
    pa AS (SELECT DISTINCT claim_id, article_id FROM p JOIN dt USING (term))
    SELECT claim_id, name, count(*) AS n_articles, sum(hits)::BIGINT AS n_hits FROM h JOIN s USING (claim_id, name) LEFT JOIN pa USING (claim_id, article_id)
    WHERE (size >= 2 AND hits >= 2) OR (size = 1 AND pa.claim_id IS NOT NULL) GROUP BY ALL""",
)
def _(spark, d):
    k = F.col("s_suppkey")
    c = load(spark, d, "supplier")
    name = F.when(k % 2 == 0, "edand erin").otherwise("haed")
    names = c.select(k.alias("claim_id"), name.alias("name"), F.explode(F.split(name, " ")).alias("term"))
    places = c.select(k.alias("claim_id"), F.when(k % 3 == 0, "onre").otherwise("nder").alias("term")).distinct()
    return J.count_names(names, doc_terms(spark, d), places)


@query(
    "jn7_substring",
    f"""WITH n AS (SELECT DISTINCT item_id AS claim_id, trim(unnest(string_split(lower(text), '.'))) AS value FROM benchmark),
    a AS (SELECT doc_id AS article_id, lower(text) AS text FROM documents) SELECT claim_id, value, article_id FROM n JOIN a ON contains(a.text, n.value) WHERE length(value) >= 3""",
)
def _(spark, d):
    needles = load(spark, d, "benchmark").select(
        F.col("item_id").alias("claim_id"), F.explode(F.split(F.lower("text"), r"\.")).alias("value")
    ).select("claim_id", F.trim("value").alias("value")).distinct()
    articles = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return J.match_substring(needles, articles, 6)


@query(
    "jn8_window",
    f"""WITH {CLAIMS_SQL} SELECT claim_id, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS publish_day, date_diff('day', loss_date, CAST(l_shipdate AS DATE)) AS gap_days
        FROM claims JOIN lineitem ON l_orderkey = claim_id WHERE date_diff('day', loss_date, CAST(l_shipdate AS DATE)) BETWEEN -45 AND 45""",
)
def _(spark, d):
    ev = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("publish_day")
    )
    got = J.match_window(claims(spark, d).select("claim_id", "loss_date"), ev, ["claim_id"], 45, 45)
    return got.drop("loss_date")


@query(
    "jn8_window_counts",
    f"""WITH {CLAIMS_SQL}, p AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1),
    ds AS (SELECT DISTINCT loss_date FROM claims), w AS (SELECT loss_date, sum(n)::BIGINT AS n_articles FROM ds JOIN p ON day BETWEEN loss_date - 1 AND loss_date + 2 GROUP BY 1)
    SELECT claim_id, loss_date, coalesce(n_articles, 0) AS n_articles FROM claims LEFT JOIN w USING (loss_date)""",
)
def _(spark, d):
    ev = load(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("publish_day"))
    return J.count_window(claims(spark, d).select("claim_id", "loss_date"), ev, 1, 2).select("claim_id", "loss_date", "n_articles")


@query(
    "jn9_next_day_editions",
    f"""WITH {CLAIMS_SQL}, cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS publish_day, l_returnflag AS edition FROM lineitem)
        SELECT claim_id, publish_day, edition FROM claims JOIN cal ON publish_day = loss_date + 1""",
)
def _(spark, d):
    cal = load(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("publish_day"), F.col("l_returnflag").alias("edition"))
    return J.next_day_editions(claims(spark, d).select("claim_id", "loss_date"), cal).select("claim_id", "publish_day", "edition")


@query(
    "jn10_unknown_terms",
    f"WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL} SELECT term, count(*) AS n_docs FROM dt WHERE term NOT IN (SELECT term FROM it) GROUP BY term",
)
def _(spark, d):
    terms = doc_terms(spark, d).groupBy("term").agg(F.count("*").alias("n_docs"))
    return terms.join(item_terms(spark, d).select("term").distinct(), "term", "left_anti")


@query(
    "jn11_claims_with_evidence",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
)
def _(spark, d):
    hits = load(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.claims_with_evidence(load(spark, d, "customer"), hits, "c_custkey").select("c_custkey", "c_name")


_KEY_SQL = "regexp_replace(split_part(url, '?', 1), '/+$', '')"


@query(
    "jn12_enrich",
    f"""WITH e AS (SELECT page_id AS article_id, split_part(url, '/', 4) AS claim_id, {_KEY_SQL} AS url_key, CAST(page_id * 31 % 101 AS INT) AS score,
      CASE WHEN page_id % 4 = 0 THEN 'CONFIRMED' ELSE 'BACKGROUND' END AS band, page_id % 6 = 1 AS social FROM pages),
    t AS (SELECT {_KEY_SQL} AS url_key, max(length(html)) AS n_chars FROM pages GROUP BY 1),
    w AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, article_id) AS n FROM e WHERE band <> 'CONFIRMED' AND NOT social)
    SELECT claim_id, article_id, score, n_chars FROM w LEFT JOIN t USING (url_key) WHERE n <= 12""",
)
def _(spark, d):
    n = F.col("page_id")
    url_key = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "/+$", "")
    p = load(spark, d, "pages")
    ranked = p.select(
        n.alias("article_id"), F.split_part("url", F.lit("/"), F.lit(4)).alias("claim_id"), url_key.alias("url_key"),
        (n * 31 % 101).cast("int").alias("score"), F.when(n % 4 == 0, "CONFIRMED").otherwise("BACKGROUND").alias("band"),
        (n % 6 == 1).alias("social"),
    )
    texts = p.select(url_key.alias("url_key"), F.col("html").alias("full_text"))
    got = J.enrich(ranked, texts, 12)
    return got.select("claim_id", "article_id", "score", F.length("full_text").cast("bigint").alias("n_chars"))


_HASH_SQL = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))


@query(
    "jn13_hash",
    f"""WITH e AS (SELECT vec_id, CASE WHEN h >= 9223372036854775808::HUGEINT THEN (h - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS x FROM (SELECT vec_id, {_HASH_SQL} AS h FROM embeddings)),
    i AS (SELECT x AS hash64 FROM e UNION ALL SELECT xor(xor(x, 1::BIGINT << (vec_id % 62)), 1::BIGINT << ((vec_id * 7 + 1) % 62)) FROM e),
    h AS (SELECT hash64, count(*) AS n FROM i GROUP BY 1)
    SELECT a.hash64 AS hash_a, b.hash64 AS hash_b, a.n AS n_a, b.n AS n_b, bit_count(xor(a.hash64, b.hash64)) AS distance FROM h a JOIN h b ON a.hash64 < b.hash64 WHERE bit_count(xor(a.hash64, b.hash64)) <= 3""",
)
def _(spark, d):
    # Each image with a re-encoded copy that differs in up to two bits.
    one = image_hashes(spark, d)
    flip = lambda c: F.expr(f"shiftleft(1L, cast({c} % 62 as int))")
    copy = one.select("image_id", F.col("hash64").bitwiseXOR(flip("image_id")).bitwiseXOR(flip("(image_id * 7 + 1)")).alias("hash64"))
    return J.match_hash(one.unionByName(copy), 3, 6)


def image_hashes(spark, d):
    """64-bit hashes from the signs of the embeddings."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    packed = F.aggregate(
        F.reverse(bits), F.lit(0).cast("bigint"), lambda a, b: F.expr("1L") * (F.shiftleft(a, 1).bitwiseOR(b))
    )
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), packed.alias("hash64"))


@query(
    "jn14_prior_claims",
    f"""WITH {CLAIMS_SQL}, day AS (SELECT party, loss_date, count(*) AS n FROM claims GROUP BY ALL),
    h AS (SELECT party, loss_date, coalesce(sum(n) OVER (PARTITION BY party ORDER BY loss_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_claims, lag(loss_date) OVER (PARTITION BY party ORDER BY loss_date) AS last_prior FROM day)
    SELECT claim_id, prior_claims, last_prior FROM claims LEFT JOIN h USING (party, loss_date)""",
)
def _(spark, d):
    c = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("claim_id"), F.col("c_custkey").alias("party"), F.col("o_orderdate").cast("date").alias("loss_date")
    )
    return J.prior_claims(c, "party", "loss_date").select("claim_id", "prior_claims", "last_prior")


@query(
    "flt13_case_specific",
    f"""WITH {DOC_TERMS_SQL}, {ITEM_TERMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY length(term) DESC, term) AS o FROM it),
    c AS (SELECT doc_id, code FROM (SELECT doc_id, {_CODE_SQL} AS codes FROM documents), unnest(codes) AS u(code)),
    h AS (SELECT claim_id, article_id, count(*) FILTER (WHERE o <= 4) AS n, count(*) FILTER (WHERE o = 5) AS n_at FROM r JOIN dt USING (term) WHERE o <= 5 GROUP BY ALL)
    SELECT claim_id, article_id FROM h WHERE n >= 2 OR (n = 1 AND n_at = 1) UNION SELECT a.doc_id, b.doc_id FROM c a JOIN c b ON a.code = b.code WHERE a.doc_id IN (SELECT item_id FROM benchmark)""",
)
def _(spark, d):
    from corrobora.functions.identifiers import extract_codes

    # A passage's longest words stand for its party's name, the next one for its place, and the codes of the
    # document with its number for its plate and claim id.
    words = R.top_k(item_terms(spark, d), ["claim_id"], [F.length("term").desc(), F.col("term").asc()], 5, "o")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("article_id"), extract_codes(F.col("text"), 6).alias("keys"))
    ids = load(spark, d, "benchmark").select(F.col("item_id").alias("article_id")).join(docs, "article_id")
    keys = ids.select(F.col("article_id").alias("claim_id"), F.explode("keys").alias("key"))
    return J.case_specific(
        words.where("o <= 4").select("claim_id", "term"), words.where("o = 5").select("claim_id", "term"), keys,
        doc_terms(spark, d), docs,
    )


