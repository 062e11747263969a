"""Row filters and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions.counts import reported_counts
from corrobora.functions.text import contains_any, is_meaningful
from corrobora.functions.urls import host_in, host_of


def filter_cases(df: DataFrame, risk: str | None, q: str | None, fields: list[str], level: str = "risk_level") -> DataFrame:
    """Portfolio rows by risk level and a case-insensitive search over a few fields."""
    if risk and risk != "ALL":
        df = df.where(F.col(level) == risk)
    if q and q.strip():
        needle = F.lit(q.strip().lower())
        test = F.lit(False)
        for f in fields:
            test = test | F.coalesce(F.contains(F.lower(F.col(f)), needle), F.lit(False))
        df = df.where(test)
    return df


def filter_batch(df: DataFrame, status: str | None, q: str | None, fields: list[str]) -> DataFrame:
    """Batch rows by status and a search over the joined fields."""
    if status and status != "ALL":
        df = df.where(F.col("status") == status)
    if q and q.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
        df = df.where(F.contains(hay, F.lit(q.strip().lower())))
    return df


def filter_results(df: DataFrame, min_score: int, band: str = "ALL", category: str = "ALL") -> DataFrame:
    """Evidence above a score; a CONFIRMED row is never hidden by the score."""
    df = df.where((F.col("band") == "CONFIRMED") | (F.col("score") >= min_score))
    if band != "ALL":
        df = df.where(F.coalesce("band", F.lit("BACKGROUND")) == band)
    if category != "ALL":
        df = df.where(F.col("category") == category)
    return df


def filter_topical(df: DataFrame, text: str, url: str, allow: list[str], deny: list[str], deny_url: list[str]) -> DataFrame:
    """Rows with an allowed keyword and no denied term or URL part."""
    hay = F.concat_ws(" ", text, url)
    return df.where(
        ~contains_any(hay, deny) & ~contains_any(F.col(url), deny_url) & contains_any(hay, allow)
    )


def is_noise(url: Column, text: Column, patterns: list[str], terms: list[str]) -> Column:
    """Index and commerce pages by URL shape, off-topic content by term."""
    by_url = F.coalesce(url, F.lit("")).rlike("(?i)(" + "|".join(patterns) + ")")
    return (by_url | contains_any(text, terms)) if terms else by_url


def reject_noise(df: DataFrame, url: str, text: str, patterns: list[str] | None = None, terms: list[str] = ()) -> DataFrame:
    return df.where(~is_noise(F.col(url), F.col(text), patterns or defaults.NOISE_URL_PATTERNS, list(terms)))


def verified_social(
    source_type: Column, platform: Column, engine: Column, url: Column, trusted: list[str],
    hosts: list[str] | None = None,
) -> Column:
    """A social row counts only with its flag, a platform, a trusted provider and a social host."""
    return F.coalesce(
        (source_type == "social_media")
        & (F.coalesce(platform, F.lit("")) != "")
        & engine.isin(trusted)
        & host_in(host_of(url), hosts or K.SOCIAL_HOSTS),
        F.lit(False),
    )


def apply_floor(df: DataFrame, minimum: int = K.SCORE_FLOOR) -> DataFrame:
    """Drop weak BACKGROUND rows; CONFIRMED and STRONG always stay."""
    return df.where(F.col("band").isin("CONFIRMED", "STRONG") | (F.col("score") >= minimum))


def conflicts_with(text: Column, target: Column) -> Column:
    """The text states counts, and none of them is the target."""
    found = reported_counts(text)
    return F.coalesce((target > 0) & (F.size(found) > 0) & ~F.array_contains(found, target), F.lit(False))


def drop_conflicts_unless_empty(df: DataFrame, by: str, conflict: str) -> DataFrame:
    """Drop conflicting rows, but keep all rows of a claim that has only conflicting ones.

    The per-claim test is an aggregate joined back: a claim's rows are never
    gathered in one task. Rows without a claim are one group.
    """
    kept = df.groupBy(F.col(by).alias("_by")).agg(F.bool_or(~F.col(conflict)).alias("_any_ok"))
    of_claim = F.col(by).eqNullSafe(F.col("_by"))
    return df.join(kept, of_claim).where(~F.col(conflict) | ~F.col("_any_ok")).drop("_by", "_any_ok")


def has_sufficient_anchors(anchors: DataFrame) -> DataFrame:
    """Claims with an identity or place anchor, or at least two free tokens."""
    strong = F.col("kind").isin("plate", "org", "place", "corridor", "police_station", "hospital") | (
        (F.col("kind") == "name") & F.contains(F.trim("value"), F.lit(" "))
    )
    return (
        anchors.groupBy("claim_id")
        .agg(F.bool_or(strong).alias("_s"), F.count_if(F.col("kind") == "token").alias("_t"))
        .where(F.col("_s") | (F.col("_t") >= 2))
        .select("claim_id")
    )


def quality_report(df: DataFrame, critical: list[str], fields: list[str], confidence: str | None = None) -> DataFrame:
    """Completeness of each record: required fields found and missing, populated count, usable."""
    ok = lambda f: is_meaningful(F.col(f).cast("string"))
    found = sum((ok(f).cast("int") for f in critical), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(~ok(f), F.lit(f)) for f in critical]))
    populated = sum((ok(f).cast("int") for f in fields), F.lit(0))
    out = df.withColumns(
        {
            "critical_found": found, "missing_critical": missing, "fields_populated": populated,
            "usable": found >= K.USABLE_MINIMUM,
        }
    )
    if confidence:
        total = sum(
            (F.when(ok(f), F.coalesce(F.try_element_at(F.col(confidence), F.lit(f)), F.lit(0.0))).otherwise(0.0) for f in fields),
            F.lit(0.0),
        )
        mean = F.when(populated > 0, F.round(total / populated, 2)).otherwise(0.0)
        out = out.withColumn("average_confidence", mean)
    return out


def fill_defaults(df: DataFrame) -> DataFrame:
    """Fill empty claim fields from their fallback fields, then from fixed defaults."""
    blank = lambda f: F.nullif(F.col(f), F.lit("")) if f in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {f: F.coalesce(blank(f), *[blank(a) for a in chain], F.lit(last)) for f, chain, last in K.DEFAULT_CHAINS}
    )
