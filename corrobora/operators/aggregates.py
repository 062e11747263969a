"""Aggregations over cases, evidence, outcomes and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.counts import first_count
from corrobora.functions.text import tokenize, with_once
from corrobora.operators.ranking import top_k


def batch_summary(cases: DataFrame, status: list[str] | None = None, settled: list[str] | None = None) -> DataFrame:
    """One row: totals, progress, evidence totals and a count for every status."""
    status = status or K.CASE_STATUS
    settled = settled or K.SETTLED_STATUS
    total = F.count("*")
    done = F.count_if(F.col("status").isin(settled))
    return cases.agg(
        total.alias("total"),
        done.alias("settled"),
        F.when(total > 0, F.floor(done * 100 / total + F.lit(0.5))).otherwise(0).cast("bigint").alias("progress"),
        F.coalesce(F.sum("evidence"), F.lit(0)).cast("bigint").alias("evidence"),
        F.count_if(F.col("evidence") > 0).alias("with_evidence"),
        F.count_if(F.col("case_specific") > 0).alias("with_case_specific"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in status],
    )


def value_counts(df: DataFrame, by: str, column: str, values: list[str], prefix: str = "n_") -> DataFrame:
    """Zero-filled count of each listed value per group, in one pass."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_all"),
        *[F.count_if(F.col(column) == v).alias(f"{prefix}{v.lower()}") for v in values],
    )


def overall_score(ranked: DataFrame, n: int = 3) -> DataFrame:
    """Mean score of each claim's best ``n`` rows."""
    best = top_k(ranked, ["claim_id"], [F.col("score").desc(), F.col("article_id").asc()], n, "_n")
    return best.groupBy("claim_id").agg(F.round(F.avg("score") + 1e-7, 2).alias("overall_score"))


def casualty_tally(evidence: DataFrame, by: list[str], text: str) -> DataFrame:
    """How many sources state each figure."""
    stated = with_once(evidence, "figure", first_count(F.col(text))).where(F.col("figure").isNotNull())
    return stated.groupBy(*by, "figure").agg(F.count("*").alias("n_sources"))


def source_outcomes(log: DataFrame, run: list[str]) -> DataFrame:
    """Availability of each source in a run: used when any part answered."""
    used = F.bool_or("ok")
    return log.groupBy(*run, "source").agg(
        used.alias("used"),
        F.when(~used, F.min_by("error", "seq")).alias("reason"),
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.count("*").alias("n_calls"),
    )


# Word edges are those of ASCII words, the same in every regex engine, accented text or not.
HARVEST_RUN = r"(?<![A-Za-z0-9_])[A-Z][a-z]{3,}(?:\s+[A-Z][a-z]{3,})?(?![A-Za-z0-9_])"


def harvest_terms(
    ranked: DataFrame, known: DataFrame, text: str, top: int | None = 20, limit: int = 6, distinct_docs: bool = False,
) -> DataFrame:
    """New candidate terms from each claim's leading articles.

    Capitalised runs counted over the top rows, known anchors removed by an anti
    join after counting, kept when seen twice, best ``limit`` per claim.
    """
    rows = ranked if top is None else ranked.where(F.col("rank") <= top)
    runs = F.regexp_extract_all(text, F.lit(HARVEST_RUN), 0)
    terms = rows.select(
        "claim_id", "rank", F.posexplode(F.array_distinct(runs) if distinct_docs else runs).alias("pos", "term")
    ).where(F.length("term") >= 4)
    counted = (
        terms.groupBy("claim_id", "term")
        .agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
        .where("n >= 2")
        .withColumn("key", F.lower("term"))
    )
    new = counted.join(known.select("claim_id", F.lower("value").alias("key")).distinct(), ["claim_id", "key"], "left_anti")
    order = [F.col("n").desc(), F.col("first").asc(), F.col("term").asc()]
    return top_k(new, ["claim_id"], order, limit, "pick").select("claim_id", "term", "n", "pick")


def ordered_distinct(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """One row per value ignoring case: the first position and the last spelling."""
    return (
        df.groupBy(*by, F.lower(value).alias("_k"))
        .agg(F.min(ordinal).alias(ordinal), F.max_by(value, ordinal).alias(value))
        .drop("_k")
    )


def anchor_coverage(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """Per claim and anchor kind: how many anchors, how many found, in how many records."""
    hits = matches.groupBy("claim_id", "kind").agg(
        F.countDistinct("value").alias("n_found"), F.countDistinct("article_id").alias("n_records")
    )
    sizes = anchors.groupBy("claim_id", "kind").agg(F.countDistinct("value").alias("n_anchors"))
    return sizes.join(hits, ["claim_id", "kind"], "left").fillna(0, ["n_found", "n_records"])


def publication_span(evidence: DataFrame, by: str, loss_date: str, days: int = 3) -> DataFrame:
    """Earliest publication, and how many fall within ``days`` of the loss."""
    return evidence.groupBy(by).agg(
        F.min("publish_day").alias("earliest"),
        F.count_if(F.abs(F.datediff("publish_day", loss_date)) <= days).alias("n_in_window"),
    )


def corroboration_bonus(extra: Column) -> Column:
    return F.least(extra * K.CORROBORATION_STEP, F.lit(K.CORROBORATION_MAX))


def corroborate(stories: DataFrame, by: list[str], domain: str, score: str) -> DataFrame:
    """Other publishers of each story, and its best score with the bonus, at most 100."""
    extra = F.countDistinct(domain) - 1
    return stories.groupBy(*by).agg(
        extra.alias("corroboration"),
        F.least(F.max(score) + corroboration_bonus(extra), F.lit(100)).alias("final_score"),
    )


def keywords(anchors: DataFrame, limit: int = 24) -> DataFrame:
    """A claim's first keywords in order, joined."""
    kept = top_k(anchors, ["claim_id"], [F.col("ordinal").asc(), F.col("value").asc()], limit, "_n")
    parts = F.sort_array(F.collect_list(F.struct("_n", "value")))
    return kept.groupBy("claim_id").agg(F.array_join(F.transform(parts, lambda p: p["value"]), ", ").alias("keywords"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) with stopwords removed."""
    return df.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def vector_norms(counts: DataFrame, key: str) -> DataFrame:
    """Number of terms and Euclidean length of each count vector."""
    return counts.groupBy(key).agg(
        F.count("*").alias("n_terms"), F.sum("n").alias("n_tokens"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")
    )


def audit_rollup(log: DataFrame, by: str) -> DataFrame:
    """Actions per case with the first and latest action."""
    when = F.struct("ts", "seq")
    return log.groupBy(by).agg(
        F.count("*").alias("n_actions"),
        F.max("ts").alias("last_ts"),
        F.max_by("action", when).alias("last_action"),
        F.min_by("action", when).alias("first_action"),
    )


def unmapped_labels(df: DataFrame, details: str) -> DataFrame:
    """How often each unmapped label occurs."""
    return df.select(F.explode(details).alias("_d")).groupBy(F.col("_d.label").alias("label")).agg(F.count("*").alias("n"))
