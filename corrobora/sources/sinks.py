"""Register contracts, evidence bundles and sheets, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.text import is_meaningful
from corrobora.operators.ranking import distributed_rank


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def to_contract(df: DataFrame) -> DataFrame:
    """The ordered 30-column register with its default values."""
    out = []
    for header, fields, default in K.CONTRACT_COLUMNS:
        tried = [F.nullif(_text(df, f), F.lit("")) for f in fields]
        out.append(F.coalesce(*tried, F.lit(default).cast("string")).alias(header))
    return df.select(*out)


def batch_register(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per claim with evidence counts and its top source."""
    best = F.struct(-F.col("score"), F.col("article_id"))
    stats = ranked.groupBy("claim_id").agg(
        F.count("*").alias("evidence"),
        F.count_if("case_specific").alias("case_specific"),
        F.min_by("domain", best).alias("top_source"),
        F.max("score").alias("top_score"),
        F.min_by("url", best).alias("top_url"),
    )
    return cases.join(stats, "claim_id", "left").fillna(0, ["evidence", "case_specific"])


def evidence_bundle(cases: DataFrame, ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON document per claim with its ranked evidence.

    ``ranked`` is a ranked list, which has at most its rank limit per claim, so a
    claim's array has a known greatest size. ``limit`` shortens it further.
    """
    item = F.struct("rank", "title", "url", "domain", "score", "publish_day", "band", "case_specific")
    items = (
        (ranked if limit is None else ranked.where(F.col("rank") <= limit))
        .groupBy("claim_id")
        .agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    )
    joined = cases.join(items, "claim_id", "left")
    return joined.withColumn(
        "bundle", F.to_json(F.struct("claim_id", F.coalesce("evidence", F.array()).alias("evidence")))
    )


def flatten_links(df: DataFrame, groups: str = "groups") -> DataFrame:
    """Grouped links (array of group, links[]) to one row per link."""
    keep = [c for c in df.columns if c != groups]
    return df.select(*keep, F.inline(groups)).select(*keep, "group", F.inline("links"))


def to_field_values(df: DataFrame, key: str, fields: list[str], extras: str | None = None) -> DataFrame:
    """Non-empty fields, and the extras as printed, in long (field, value) form."""
    typed = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    long = typed.unpivot([key], fields, "field", "value")
    if extras:
        printed = df.select(key, F.inline(extras)).withColumnRenamed("label", "field")
        long = long.unionByName(printed)
    return long.where(is_meaningful(F.col("value")))


def evidence_sheet(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Evidence rows numbered per claim by score, newest tie-breaks by id.

    With a limit the rank is a bounded window; without one every row is numbered
    by a range-partitioned rank that splits a claim over many tasks.
    """
    order = [F.col("score").desc(), F.col("article_id").asc()]
    return distributed_rank(ranked, ["claim_id"], order, "rank", limit)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header row."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
