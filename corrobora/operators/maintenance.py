"""Unions, replacement, upserts and deletes over whole tables, by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources with a provenance column; missing columns are null."""
    tagged = [df.withColumn("provenance", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Incoming rows, then the old rows whose key did not come in."""
    return new.unionByName(old.join(new, key, "left_anti"))


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, plus incoming rows with a new key."""
    return old.unionByName(new.join(old, key, "left_anti"))


def upsert_cases(old: DataFrame, new: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Insert new cases; overwrite the facts of known ones and keep their workflow columns."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        if c in facts:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in new.columns:
            cols.append(F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return joined.select(*cols)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Child rows where every key present in ``new`` has exactly the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_cases(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the deleted keys."""
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}


def expand_terms(base: DataFrame, values: dict[str, list[str]], query: Column) -> DataFrame:
    """Parameter sweep: every row with every combination of short configured lists.

    The lists are exploded in place, so the sweep is a map over the rows; only
    the distinct step shuffles.
    """
    out = base
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return out.withColumn("query", query).dropDuplicates(["query"])
