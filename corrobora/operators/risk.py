"""Contradiction flags, risk scores and review levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K

NO_MISMATCH = "No mismatch identified."


def mismatch_flags(texts: DataFrame, rules: list[tuple[str, list[str], list[str], str]], text: str, key: str) -> DataFrame:
    """Raised flags per claim with an explanation each.

    ``rules`` is a bounded list of (rule, terms, flags, explanation); one rule can
    raise several flags and the first rule raising a flag explains it. Rules are
    folded into the projection, so texts are scanned once and nothing is joined.
    """
    from corrobora.functions.text import contains_any

    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    contains_any(F.col(text), terms),
                    F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule"),
                             F.array(*[F.lit(f) for f in flags]).alias("flags"), F.lit(why).alias("explanation")),
                )
                for i, (rule, terms, flags, why) in enumerate(rules)
            ]
        )
    )
    raised = texts.select(key, F.inline(fired)).select(key, "i", "rule", "explanation", F.explode("flags").alias("flag"))
    return raised.groupBy(key, "flag").agg(F.min_by("rule", "i").alias("rule"), F.min_by("explanation", "i").alias("explanation"))


def risk_score(flags: DataFrame, key: str, images: DataFrame | None = None) -> DataFrame:
    """Additive risk 0-100 and its level, from distinct flags and flagged images.

    ``flags`` is (key, flag); ``images`` is (key, flagged).
    """
    table = F.create_map(*[F.lit(x) for kv in K.RISK_WEIGHTS.items() for x in kv])
    points = flags.select(key, "flag").distinct().groupBy(key).agg(
        F.sum(F.coalesce(F.try_element_at(table, F.col("flag")), F.lit(0))).alias("_f"), F.count("*").alias("n_flags")
    )
    if images is not None:
        per = images.groupBy(key).agg((F.count_if("flagged") * K.RISK_IMAGE).alias("_i"))
        points = points.join(per, key, "full_outer").fillna(0, ["_f", "_i", "n_flags"])
    else:
        points = points.withColumn("_i", F.lit(0))
    score = F.least(F.lit(100), F.lit(K.RISK_BASE) + F.col("_f") + F.col("_i")).cast("int")
    return points.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"))).drop("_f", "_i")


def risk_level(score: Column) -> Column:
    return F.when(score >= K.RISK_HIGH, "HIGH").when(score >= K.RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def review_level(any_flag: Column, reused_image: Column, average: Column) -> Column:
    """HIGH for any flag, a reused image or a mean below 0.5; MEDIUM below 0.75; else LOW."""
    return F.when(any_flag | reused_image | (average < 0.5), "HIGH").when(average < 0.75, "MEDIUM").otherwise("LOW")


def batch_level(case_specific: Column, evidence: Column) -> Column:
    """HIGH for any case-specific hit, MEDIUM for any hit, else LOW."""
    return F.when(case_specific > 0, "HIGH").when(evidence > 0, "MEDIUM").otherwise("LOW")


def discrepancy_flags(
    target: Column, figures_seen: Column, agrees: Column, loss: Column, earliest: Column,
    has_plate: Column, records: Column, confirmed: Column, authoritative: Column,
) -> Column:
    """Names of the discrepancies between a claim and its records, in report order."""
    return F.array_compact(
        F.array(
            F.when((target > 0) & (figures_seen > 0) & ~agrees, F.lit("count_disagreement")),
            F.when(F.datediff(loss, earliest) > 2, F.lit("pre_inception")),
            F.when(has_plate & (records > 0) & (confirmed == 0), F.lit("no_identifier")),
            F.when((records > 0) & (authoritative == 0), F.lit("no_authoritative_source")),
        )
    )


def image_status(images: DataFrame, rules: list[tuple[str, str]], name: str, default: str = "Original") -> DataFrame:
    """Status of each image by the first name pattern that fits."""
    status = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        status = F.when(F.col(name).rlike(f"(?i)({pattern})"), F.lit(value)).otherwise(status)
    return images.withColumn("status", F.coalesce(status, F.lit(default)))
