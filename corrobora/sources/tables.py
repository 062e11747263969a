"""Parquet tables and free-text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.schema import TABLES
from corrobora.session import spread

# Tables whose rows are long texts, with the key their work is grouped by.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table by name, with its declared schema (no inference pass)."""
    df = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


# Packed texts stand between record separators. A separator or escape sign inside a text is written as the escape sign
# and a letter, so any text survives and the files still split at any byte.
SEPARATOR, ESCAPE = "\u001e", "\u001b"
_SIGNS = ((ESCAPE, "e"), (SEPARATOR, "s"), ("\r", "r"), ("\n", "n"))


def escaped(c: Column) -> Column:
    for sign, letter in _SIGNS:
        c = F.replace(c, F.lit(sign), F.lit(ESCAPE + letter))
    return c


def unescaped(c: Column) -> Column:
    for sign, letter in reversed(_SIGNS):
        c = F.replace(c, F.lit(ESCAPE + letter), F.lit(sign))
    return c


def _parsed(raw: DataFrame, packed: bool) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.lower(F.regexp_extract("_metadata.file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"),
        (unescaped(F.col("value")) if packed else F.col("value")).alias("text"),
    )


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Text documents with their file path.

    One row per file, or one row per record when files pack many documents
    behind a record ``separator`` (small files do not scale, packed ones do: they
    are split by byte range). Escaped signs in packed texts are put back.
    """
    reader = spark.read
    reader = reader.option("lineSep", separator) if separator else reader.option("wholetext", "true")
    return _parsed(reader.text(path), separator is not None)


def stream_documents(spark: SparkSession, path: str, separator: str = SEPARATOR, files_per_batch: int | None = None) -> DataFrame:
    """Packed text documents as they arrive, with the same columns as :func:`read_documents`."""
    reader = spark.readStream.option("lineSep", separator)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(reader.text(path), True)


def write_documents(df: DataFrame, path: str, column: str = "text", separator: str = SEPARATOR) -> None:
    """Texts packed into few files behind a record separator, any sign in them escaped. Null texts are left out."""
    rows = df.where(F.col(column).isNotNull()).select(escaped(F.col(column)).alias(column))
    rows.write.option("lineSep", separator).mode("errorifexists").text(path)
