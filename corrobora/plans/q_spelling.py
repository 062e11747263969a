"""Registered queries: matching across scripts and spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions.phonetics import romanise_tokens
from corrobora.functions.text import spelled_words
from corrobora.operators import matching as MA
from corrobora.operators import ranking as R
from corrobora.operators import spelling as SP
from corrobora.operators.joins import match_terms
from corrobora.plans.q_scoring import ITEM_TOP_SQL, _CODES_SQL, article_keys, item_top, rendered_anchors
from corrobora.plans.registry import query
from corrobora.plans.roles import sql_phonetic
from corrobora.session import stored
from corrobora.sources.tables import load

# Half of the documents have their words of plain syllables written in Devanagari, letter by letter. A written "a" is
# long there and is read back as two letters; all others come back as they were.
_SYLLABLES = "^([bdgjklmnprstvh][aiueo]){2,}$"
_LATIN, _NATIVE = "bdgjklmnprstvhaiueo", "बदगजकलमनपरसतवहािुेो"


def rendered_words(spark, d):
    """(article_id, term): distinct words of each document, in the script that the document is written in."""
    docs = load(spark, d, "documents")
    native = lambda w: F.when((F.col("doc_id") % 2 == 1) & w.rlike(_SYLLABLES), F.translate(w, _LATIN, _NATIVE)).otherwise(w)
    return docs.select(
        F.col("doc_id").alias("article_id"), F.explode(F.array_distinct(F.transform(spelled_words(F.col("text")), native))).alias("term")
    )


def _fold_sql(x: str) -> str:
    """SQL for fold_accents on words of the given tables."""
    out = f"strip_accents({x})"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_WORDS_SQL = f"""dw AS (SELECT DISTINCT doc_id AS article_id, w, doc_id % 2 = 1 AND regexp_matches(w, '{_SYLLABLES}') AS native
  FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM documents), unnest(ws) AS u(w) WHERE regexp_matches(w, '\\p{{L}}')),
vl AS MATERIALIZED (SELECT *, {sql_phonetic('latin')} AS key FROM (SELECT DISTINCT w, native, CASE WHEN native THEN replace(w, 'a', 'aa') ELSE {_fold_sql('w')} END AS latin FROM dw)),
wl AS MATERIALIZED (SELECT *, {sql_phonetic('latin')} AS key FROM (SELECT DISTINCT term, {_fold_sql('term')} AS latin FROM item_top)),
near AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM (SELECT DISTINCT key FROM wl WHERE length(latin) >= 4 AND length(key) >= 7) a, (SELECT DISTINCT key FROM vl WHERE length(latin) >= 4 AND length(key) >= 7) b
  WHERE abs(length(a.key) - length(b.key)) <= 1 AND levenshtein(a.key, b.key) = 1),
same AS MATERIALIZED (SELECT term, w, native, min(how) AS how FROM (
  SELECT term, w, native, 1 AS how FROM wl JOIN vl USING (latin) WHERE latin <> ''
  UNION ALL SELECT term, w, native, 2 FROM wl JOIN vl USING (key) WHERE length(wl.latin) >= 4 AND length(vl.latin) >= 4 AND length(key) >= 4
  UNION ALL SELECT term, w, native, 3 FROM near JOIN wl ON wl.key = a JOIN vl ON vl.key = b) GROUP BY ALL),
st AS MATERIALIZED (SELECT article_id, term, min(how) AS how FROM dw JOIN same USING (w, native) GROUP BY ALL)"""


@query(
    "jn5_spelled_terms",
    f"WITH {ITEM_TOP_SQL}, {_WORDS_SQL} SELECT term, how, count(*) AS n_articles, min(article_id) AS first_article FROM st GROUP BY ALL",
)
def _(spark, d):
    """Each wanted word: how many articles have it alike, by sound or within one edit, in either script."""
    got = SP.spelled_terms(item_top(spark, d).select("term"), rendered_words(spark, d))
    return got.groupBy("term", "how").agg(F.count("*").alias("n_articles"), F.min("article_id").alias("first_article"))


@query(
    "jn5_cross_script",
    f"""WITH {ITEM_TOP_SQL}, {_WORDS_SQL}, h AS (SELECT claim_id, article_id, count(*) AS hits FROM item_top JOIN st USING (term) GROUP BY ALL HAVING count(*) >= 2)
    SELECT claim_id, article_id, hits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY hits DESC, article_id) AS rank FROM h) WHERE rank <= 20""",
)
def _(spark, d):
    """Articles of either script that have most of a claim's words, the first 20 of each claim."""
    top = item_top(spark, d).select("claim_id", "term")
    # The match reads them several times.
    spelled = stored(SP.spelled_terms(top.select("term"), rendered_words(spark, d)).select("article_id", "term"))
    order = [F.col("hits").desc(), F.col("article_id").asc()]
    return R.top_k(match_terms(top, spelled, 2), ["claim_id"], order, 20)


@query(
    "sc1_match_spelled",
    f"""WITH {ITEM_TOP_SQL}, {_WORDS_SQL}, plain AS (SELECT article_id, w AS term FROM dw WHERE NOT native), cd AS (SELECT doc_id AS article_id, unnest({_CODES_SQL}) AS code FROM documents),
    tp AS (SELECT claim_id, list(term ORDER BY ordinal) AS t FROM item_top GROUP BY 1),
    ph AS (SELECT claim_id, 'name' AS kind, t[1] || ' ' || t[2] AS value, t[1] AS x, t[2] AS y FROM tp UNION ALL SELECT claim_id, 'org', t[4] || ' ' || t[5], t[4], t[5] FROM tp UNION ALL SELECT claim_id, 'place', t[3], t[3], t[3] FROM tp),
    strong AS (SELECT p.claim_id, a.article_id, kind, value FROM ph p JOIN st a ON a.term = p.x JOIN st b ON b.term = p.y AND b.article_id = a.article_id
      UNION SELECT item_id, b.article_id, 'plate', a.code FROM benchmark JOIN cd a ON a.article_id = item_id JOIN cd b ON b.code = a.code
      UNION SELECT item_id, doc_id, 'corridor', concat('NH ', item_id % 50) FROM benchmark JOIN documents ON doc_id % 70 = item_id % 50),
    two AS (SELECT a.claim_id, article_id FROM item_top a JOIN plain USING (term) WHERE ordinal IN (7, 8) GROUP BY ALL HAVING count(*) = 2),
    pr AS (SELECT claim_id, article_id FROM strong UNION SELECT * FROM two),
    every AS (SELECT * FROM strong UNION SELECT claim_id, article_id, CASE ordinal WHEN 5 THEN 'vehicle' WHEN 6 THEN 'incident' ELSE 'token' END, term FROM pr JOIN item_top USING (claim_id) JOIN plain USING (article_id, term) WHERE ordinal >= 5)
    SELECT claim_id, kind, value, count(*) AS n_articles, min(article_id) AS first_article FROM every GROUP BY ALL""",
)
def _(spark, d):
    """Anchors in Latin script matched to articles of either script: how many articles each anchor is in."""
    got = MA.match_anchors(rendered_anchors(spark, d), article_keys(spark, d), rendered_words(spark, d), spelled=True)
    return got.groupBy("claim_id", "kind", "value").agg(F.count("*").alias("n_articles"), F.min("article_id").alias("first_article"))


@query(
    "str15_romanise_words",
    f"""WITH w AS (SELECT DISTINCT w, replace(w, 'a', 'aa') AS latin FROM (SELECT string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM documents WHERE doc_id % 2 = 1), unnest(ws) AS u(w) WHERE regexp_matches(w, '{_SYLLABLES}'))
    SELECT translate(w, '{_LATIN}', '{_NATIVE}') AS token, latin, {sql_phonetic('latin')} AS key FROM w""",
)
def _(spark, d):
    """Every native word of the documents with its Latin spelling and key."""
    return romanise_tokens(rendered_words(spark, d), "term")
