"""Per-claim reports and research links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.operators.aggregates import anchor_coverage
from corrobora.operators.ranking import rank_evidence
from corrobora.operators.risk import discrepancy_flags

# Link templates: (group, label, kind). Kind picks the URL form below.
LINK_TEMPLATES = [
    ("Core", "Plain search", "plain"),
    ("News", "News search", "news"),
    ("Date-locked", "T-1 to T+3 window", "dated"),
]
SEARCH_BASE = "https://www.google.com/search?q="


def claim_report(claims: DataFrame, evidence: DataFrame, top: int = 6) -> DataFrame:
    """One row per claim: verdict counts, leading sources, dates, flags and next steps.

    ``claims`` is (claim_id, loss_date, target_count, has_plate); ``evidence``
    carries article_id, title, domain, score, band, publish_day, figure and
    authoritative. All figures come from one aggregation per claim; the leading
    sources are a bounded rank.
    """
    counts = evidence.join(claims.select("claim_id", "target_count"), "claim_id").groupBy("claim_id").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("band") == "CONFIRMED").alias("n_confirmed"),
        F.count_if(F.col("band") == "STRONG").alias("n_strong"),
        F.count_if(F.col("band") == "BACKGROUND").alias("n_background"),
        F.count_if("authoritative").alias("n_authoritative"),
        F.min("publish_day").alias("earliest"),
        F.count_if(F.col("figure").isNotNull()).alias("n_figures"),
        F.bool_or(F.coalesce(F.col("figure") == F.col("target_count"), F.lit(False))).alias("figure_agrees"),
    )
    leading = rank_evidence(evidence.select("claim_id", "article_id", "band", "score", "domain"), top)
    named = leading.groupBy("claim_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "article_id", "domain").alias("s")))).alias("_l")
    ).select("claim_id", F.array_join(F.transform("_l", lambda x: x["s"]), "; ").alias("top_sources"))
    zero = ["records", "n_confirmed", "n_strong", "n_background", "n_authoritative", "n_figures"]
    joined = claims.join(counts, "claim_id", "left").join(named, "claim_id", "left").fillna(0, zero).fillna(False, ["figure_agrees"])
    verdict = (
        F.when(F.col("n_confirmed") > 0, "confirmed").when(F.col("n_strong") > 0, "circumstantial")
        .when(F.col("records") > 0, "background").otherwise("nil")
    )
    flags = discrepancy_flags(
        F.col("target_count"), F.col("n_figures"), F.col("figure_agrees"), F.col("loss_date"), F.col("earliest"),
        F.col("has_plate"), F.col("records"), F.col("n_confirmed"), F.col("n_authoritative"),
    )
    steps = F.array_compact(F.array(
        F.when(F.col("n_confirmed") == 0, F.lit("run research links")),
        F.when(F.col("n_confirmed") == 0, F.concat(F.lit("check edition of "), F.date_add("loss_date", 1).cast("string"))),
        F.when(F.col("has_plate"), F.lit("verify registration")),
        F.lit("record the search"),
    ))
    return joined.withColumns(
        {"verdict": verdict, "flags": F.array_join(flags, ","), "next_steps": F.array_join(steps, "; ")}
    )


# How a report says whether the anchors of a kind were found; other kinds are listed with their numbers alone.
COVERAGE_TEXTS = {
    "plate": ("in at least one public source", "in no indexed public source"),
    "name": ("named in a public report", "no public mention located"),
}


def coverage_report(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """What of a claim the public record knows, a row per claim and kind of anchor.

    ``anchors`` is (claim_id, kind, value), ``matches`` (claim_id, article_id, kind, value). ``n_found`` of ``n_anchors``
    were found, in ``n_records`` of the claim's ``of_records``; ``finding`` puts it into words.
    """
    covered = anchor_coverage(anchors, matches)
    totals = matches.groupBy("claim_id").agg(F.countDistinct("article_id").alias("of_records"))
    numbers = F.concat(F.lit("referenced by "), F.col("n_records"), F.lit(" of "), F.col("of_records"), F.lit(" records"))
    finding = numbers
    for kind, (yes, no) in COVERAGE_TEXTS.items():
        finding = F.when(F.col("kind") == kind, F.when(F.col("n_found") > 0, yes).otherwise(no)).otherwise(finding)
    return covered.join(totals, "claim_id", "left").fillna(0, ["of_records"]).withColumn("finding", finding)


def _us_date(d: Column) -> Column:
    return F.concat_ws("/", F.month(d), F.dayofmonth(d), F.year(d))


def research_links(claims: DataFrame, text: str, loss_date: str, sites: list[str] = ()) -> DataFrame:
    """One row per claim and link: plain, news, date-locked and one per site.

    Templates and sites are short configured lists, exploded per row.
    """
    q = F.url_encode(F.col(text))
    window = F.concat(
        F.lit("cdr:1,cd_min:"), _us_date(F.date_sub(loss_date, 1)), F.lit(",cd_max:"), _us_date(F.date_add(loss_date, 3))
    )
    forms = {
        "plain": F.concat(F.lit(SEARCH_BASE), q),
        "news": F.concat(F.lit(SEARCH_BASE), q, F.lit("&tbm=nws")),
        "dated": F.concat(F.lit(SEARCH_BASE), q, F.lit("&tbs="), F.url_encode(window)),
    }
    rows = [F.struct(F.lit(g).alias("group"), F.lit(label).alias("label"), forms[kind].alias("link")) for g, label, kind in LINK_TEMPLATES]
    for site in sites:
        query = F.url_encode(F.concat(F.lit(f"site:{site} "), F.col(text)))
        rows.append(F.struct(F.lit("Sources").alias("group"), F.lit(site).alias("label"), F.concat(F.lit(SEARCH_BASE), query).alias("link")))
    return claims.select("claim_id", F.inline(F.array(*rows)))
