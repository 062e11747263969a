"""Claim registers: header detection, header mapping, cleaning, de-duplication."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import clean_cell, is_meaningful, label_norm, let, with_once

# Header vocabulary shipped as a default; callers pass their own (field, synonym) list.
DEFAULT_SYNONYMS = [
    ("claim_id", "claim no"), ("claim_id", "claim number"), ("claim_id", "claim id"),
    ("insured_name", "insured name"), ("insured_name", "insured"), ("insured_name", "name of insured"),
    ("insured_address", "insured address"), ("insured_address", "address"),
    ("driver_name", "driver name"), ("driver_name", "driver"),
    ("vehicle_numbers", "vehicle no"), ("vehicle_numbers", "registration no"),
    ("vehicle_make", "vehicle make"), ("vehicle_make", "make"),
    ("accident_date_time", "date of accident"), ("accident_date_time", "loss date"),
    ("loss_location", "spot of accident"), ("loss_location", "loss location"), ("loss_location", "place of loss"),
    ("accident_location_city", "loss city"), ("accident_location_city", "city"),
    ("state", "state"), ("police_station", "police station"), ("FIR_cause_narrative", "cause of accident"),
    ("hospital_name", "hospital name"), ("hospital_name", "hospital"),
]
# Match scores by how a label contains a synonym; the synonym's length is added.
EXACT, PREFIX, SUFFIX, INNER, SUBSTRING = 1000, 600, 500, 400, 100
SUBSTRING_MIN = 5
HEADER_SCAN_ROWS = 15
HEADER_MIN_FIELDS = 2


def header_match(label: Column, synonyms: list[tuple[str, str]] | None = None) -> Column:
    """Best field for a label as ``struct(score, field)``, null when nothing fits.

    The dictionary is bounded configuration, so it is folded into the expression:
    no join and no shuffle however many labels there are. A label that is a synonym
    is looked up; of the others, only those that hold a synonym are scored.
    """
    table = DEFAULT_SYNONYMS if synonyms is None else synonyms
    if not table:
        return F.lit(None).cast("struct<score:int,field:string>")
    fitting = lambda score, field: F.struct(score.alias("score"), field.alias("field"))
    # Of fields with one synonym the first stands, as an equal label scores above all else.
    exact = {synonym: fitting(F.lit(EXACT + len(synonym)), F.lit(field)) for field, synonym in reversed(table)}
    known = F.create_map(*[x for synonym, hit in exact.items() for x in (F.lit(synonym), hit)])

    def best(n: Column) -> Column:
        scored = []
        for i, (field, synonym) in enumerate(table):
            size = len(synonym)
            score = (
                F.when(n == synonym, EXACT + size)
                .when(n.startswith(synonym + " "), PREFIX + size)
                .when(n.endswith(" " + synonym), SUFFIX + size)
                .when(F.contains(n, F.lit(f" {synonym} ")), INNER + size)
            )
            if size >= SUBSTRING_MIN:
                score = score.when(F.contains(n, F.lit(synonym)), SUBSTRING + size)
            scored.append(F.struct(score.alias("score"), F.lit(-i).alias("o"), F.lit(field).alias("field")))
        return F.array_max(F.filter(F.array(*scored), lambda s: s["score"].isNotNull()))

    def fitted(n: Column) -> Column:
        holds = reduce(or_, [F.contains(n, F.lit(synonym)) for synonym in exact])
        inside = let(best(n), lambda hit: F.when(hit.isNotNull(), fitting(hit["score"], hit["field"])))
        return F.coalesce(F.try_element_at(known, n), F.when(holds, inside))

    return let(label_norm(label), fitted)


def is_header(label: Column, synonyms: list[tuple[str, str]] | None = None) -> Column:
    """True for a label that is one of the synonyms."""
    return F.coalesce(label_norm(label).isin([synonym for _, synonym in (DEFAULT_SYNONYMS if synonyms is None else synonyms)]), F.lit(False))


def map_headers(df: DataFrame, label: str, synonyms: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``field`` and ``score`` for each header label."""
    return (
        with_once(df, "_hit", header_match(F.col(label), synonyms))
        .withColumn("field", F.col("_hit.field"))
        .withColumn("score", F.col("_hit.score"))
        .drop("_hit")
    )


def detect_header_row(cells: DataFrame, synonyms: list[tuple[str, str]] | None = None) -> DataFrame:
    """Header row per sheet: most mapped labels among the first rows, earliest on ties.

    ``cells`` is (src, row_no, col_no, cell). The row filter reaches the scan, so
    only the top of each sheet is examined.
    """
    counted = (
        map_headers(cells.where(F.col("row_no") < HEADER_SCAN_ROWS), "cell", synonyms)
        .where(F.col("field").isNotNull())
        .groupBy("src", "row_no")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= HEADER_MIN_FIELDS)
    )
    return counted.groupBy("src").agg(F.max_by("row_no", F.struct("n", -F.col("row_no"))).alias("header_row"))


def read_register(
    cells: DataFrame, fields: list[str], synonyms: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One record per data row below the detected header; blank rows drop out.

    The header of a sheet is a handful of rows, so both joins have a tiny side;
    AQE broadcasts it, or splits a sheet that dominates the input.
    """
    header_row = detect_header_row(cells, synonyms)
    headers = (
        map_headers(
            cells.where(F.col("row_no") < HEADER_SCAN_ROWS).join(header_row, "src").where("row_no = header_row"),
            "cell", synonyms,
        )
        .where(F.col("field").isNotNull())
        .groupBy("src", "header_row", "field")
        .agg(F.min("col_no").alias("col_no"))
    )
    data = cells.join(headers, ["src", "col_no"]).where("row_no > header_row")
    return (
        data.withColumn("cell", clean_cell(F.col("cell")))
        .where(F.col("cell").isNotNull())
        .groupBy("src", "row_no")
        .pivot("field", fields)
        .agg(F.first("cell"))
    )


def pivot_key_values(
    df: DataFrame, src: str, key: str, value: str, ordinal: str, fields: list[str],
    synonyms: list[tuple[str, str]] | None = None, minimum: int = HEADER_MIN_FIELDS,
) -> DataFrame:
    """Transposed sheet to one record per source: the last value of each mapped key wins."""
    mapped = map_headers(df, key, synonyms).where(F.col("field").isin(fields))
    wide = mapped.groupBy(src).pivot("field", fields).agg(F.max_by(value, ordinal))
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return wide.where(filled >= minimum)


def collect_unmapped(df: DataFrame, mapped: list[str], name: str = "additional_details") -> DataFrame:
    """Unmapped columns as an array of (label, value), empty values left out."""
    rest = [c for c in df.columns if c not in mapped]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in rest]
    )
    return df.select(*mapped, F.filter(pairs, lambda p: is_meaningful(p["value"])).alias(name))


def clean_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """Trim, placeholders to null, timestamps to ISO days."""
    kinds = dict(df.dtypes)
    out = {
        c: F.date_format(c, "yyyy-MM-dd") if kinds[c].startswith(("timestamp", "date")) else clean_cell(F.col(c))
        for c in cols
    }
    return df.withColumns(out)


def dedupe_most_complete(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The most populated record per key, the earliest on ties.

    An aggregation, not a window: records of a hot key are combined before the
    shuffle.
    """
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    row = F.struct(*df.columns)
    best = df.groupBy(key).agg(F.max_by(row, F.struct(filled, -F.col(ordinal))).alias("_r"))
    return best.select("_r.*")


def ensure_id(df: DataFrame, cols: list[str], name: str = "claim_id") -> DataFrame:
    """Stable surrogate key: SHA-256 over the named columns when the id is missing."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    current = F.col(name) if name in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(current, digest))


def merge_case_documents(docs: DataFrame, keep: int = 6) -> DataFrame:
    """Documents of one archive merged into one text.

    ``docs`` is (archive, name, type, text). Names order intimation, claim, other,
    policy; the first ``keep`` are read; policy copies are left out unless there
    is nothing else. The per-archive rank is bounded, so Spark limits each
    partition before the shuffle.
    """
    from pyspark.sql import Window

    n = F.lower("name")
    rank = (
        F.when(n.contains("intimation"), 0).when(n.contains("claim"), 1).when(n.contains("policy"), 3).otherwise(2)
    )
    w = Window.partitionBy("archive").orderBy("_rank", "name")
    kept = docs.withColumn("_rank", rank).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    parts = F.sort_array(F.collect_list(F.struct("_n", "type", "text")))
    grouped = kept.groupBy("archive").agg(parts.alias("_p"))
    claim_parts = F.filter("_p", lambda p: p["type"] != "policy")
    used = F.when(F.size(claim_parts) > 0, claim_parts).otherwise(F.col("_p"))
    return grouped.select(
        "archive",
        F.size(used).alias("n_used"),
        F.array_join(F.transform(used, lambda p: p["text"]), "\n\n").alias("text"),
    )
