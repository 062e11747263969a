"""The input tables in the roles of claims, evidence and articles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.text import first_line
from corrobora.sources.tables import load


def lst(items: list[str]) -> str:
    """A SQL list literal."""
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def inlist(items: list[str]) -> str:
    """A SQL IN list."""
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def sql_tokens(x: str) -> str:
    """SQL for :func:`corrobora.functions.text.tokenize`."""
    return (
        f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND NOT list_contains({lst(K.STOPWORDS)}, w))"
    )


def sql_meaningful(x: str) -> str:
    """SQL for :func:`corrobora.functions.text.is_meaningful`."""
    return (
        f"coalesce(lower(trim({x})) NOT IN {inlist(K.NULL_VALUES)} "
        f"AND NOT regexp_matches(lower(trim({x})), '^[-_.\\s]+$'), false)"
    )


def sql_phonetic(x: str) -> str:
    """SQL for :func:`corrobora.functions.phonetics.phonetic_key`."""
    out = f"lower({x})"
    for pattern, repl in K.PHONETIC_RULES:
        if pattern.startswith("(.)"):
            for ch in "abcdefghijklmnopqrstuvwxyz":
                out = f"regexp_replace({out}, '{ch}{ch}+', '{ch}', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{repl}', 'g')"
    return out


def sql_fold(x: str) -> str:
    """SQL for :func:`corrobora.functions.phonetics.fold_accents`, with the SQL engine's own way to take accents off."""
    out = f"translate(lower({x}), 'øłđðħŧı', 'olddhti')"
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"regexp_replace(strip_accents({out}), '\\p{{M}}', '', 'g')"


def sql_spelled_words(table: str, key: str = "") -> str:
    """Rows (key, word) for :func:`corrobora.functions.text.spelled_words` of the column ``text`` of ``table``."""
    key = key + ", " if key else ""
    split = "string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+')"
    return f"SELECT {key}word FROM (SELECT {key}{split} AS ws FROM {table}), unnest(ws) AS u(word) WHERE regexp_matches(word, '\\p{{L}}')"


def sql_host(url: str) -> str:
    """SQL for :func:`corrobora.functions.urls.host_of`."""
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"


def sql_title_words(x: str) -> str:
    """SQL for the word list behind shingles; select it as a column first."""
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+'), lambda q: q <> '')"


def sql_title_chars(x: str) -> str:
    """SQL for the character string behind trigrams; select it as a column first."""
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def sql_shingles(w: str) -> str:
    """SQL for :func:`corrobora.functions.text.shingles` over a word-list column."""
    return (
        f"CASE WHEN len({w}) >= 3 THEN list_distinct(list_transform(list_zip({w}, list_slice({w}, 2, len({w})), list_slice({w}, 3, len({w})), TRUE), "
        f"lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) "
        f"WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE CAST([] AS VARCHAR[]) END"
    )


def sql_trigrams(s: str) -> str:
    """SQL for :func:`corrobora.functions.text.trigrams` over a character-string column."""
    return (
        f"CASE WHEN length({s}) >= 3 THEN list_distinct(list_transform(range(1, length({s}) - 1), "
        f"lambda i: substr({s}, i, 3))) ELSE CAST([] AS VARCHAR[]) END"
    )


def sql_jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {n} > 0 THEN {n} * 1.0 / (len({a}) + len({b}) - {n}) ELSE 0.0 END"


CLAIMS_SQL = """claims AS (
  SELECT o_orderkey AS claim_id, c_custkey AS party, c_name AS insured_name, CAST(o_orderdate AS DATE) AS loss_date,
         n_name AS state, r_name AS region, o_orderstatus AS status, o_orderpriority AS priority,
         o_totalprice AS amount, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's name and place, as a claim register."""
    return (
        load(spark, d, "orders")
        .join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("claim_id"), F.col("c_custkey").alias("party"),
            F.col("c_name").alias("insured_name"), F.col("o_orderdate").cast("date").alias("loss_date"),
            F.col("n_name").alias("state"), F.col("r_name").alias("region"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


EVIDENCE_SQL = """evidence AS (
  SELECT doc_id AS article_id, source AS claim_id, split_part(text, chr(10), 1) AS title, text AS snippet,
         concat('s', doc_id % 7, '.example.net') AS domain,
         concat('https://s', doc_id % 7, '.example.net/a/', doc_id) AS url, lang,
         DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS publish_day,
         CAST((doc_id * 37) % 101 AS INTEGER) AS score,
         CASE WHEN doc_id % 5 = 0 THEN 'CONFIRMED' WHEN doc_id % 5 = 1 THEN 'STRONG' ELSE 'BACKGROUND' END AS band,
         doc_id % 5 = 0 AS case_specific
  FROM documents)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scored evidence rows, one claim per source."""
    n = F.col("doc_id")
    return load(spark, d, "documents").select(
        n.alias("article_id"), F.col("source").alias("claim_id"), first_line(F.col("text")).alias("title"),
        F.col("text").alias("snippet"), F.concat(F.lit("s"), n % 7, F.lit(".example.net")).alias("domain"),
        F.concat(F.lit("https://s"), n % 7, F.lit(".example.net/a/"), n).alias("url"), "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 90).cast("int")).alias("publish_day"),
        ((n * 37) % 101).cast("int").alias("score"),
        F.when(n % 5 == 0, "CONFIRMED").when(n % 5 == 1, "STRONG").otherwise("BACKGROUND").alias("band"),
        (n % 5 == 0).alias("case_specific"),
    )
