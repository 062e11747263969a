"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bit-wise majority of the hashes of a text's word shingles. Pairs within ``radius``
differing bits are found with 2^(radius+1) - 1 tables of structured masks: bit i carries a non-zero vector
phi(i) over GF(2) of length radius + 1, and mask v keeps the bits with <phi(i), v> = 1. Any ``radius`` bits
have a non-zero v orthogonal to all their vectors, so a pair that differs in these bits agrees on all bits
of mask v: every pair within the radius meets in some table. Nothing is missed and nothing is sampled.

The work is done on distinct fingerprints, so copies cost nothing. A bucket yields at most a spanning forest
of its links, never its pairs; a bucket of more than ``block`` fingerprints is cut into block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corrobora.llm.common import components, sorted_groups, written
from corrobora.llm.shingle_groups import grouped, with_sets
from corrobora.session import broadcast_checked

BITS = 64
SEED = 42


def fingerprint(data: bytes, width: int = 4) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; zero for a text without words.

    ``bytes`` lower-cases A-Z only and splits on the six ASCII white-space characters only.
    """
    words = data.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        h = xxhash.xxh64_intdigest(flat, SEED)
        return h - (1 << 64) if h >> 63 else h
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def masks(radius: int) -> list[int]:
    """The covering masks as signed 64-bit integers."""
    span = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, span + 1):
        m = sum(1 << i for i in range(BITS) if bin((1 + i % span) & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with the signed fingerprint of ``text`` as a last column."""

    @arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x or b"", width) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.withColumn(name, prints(F.col(text).cast("string")))


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within ``radius`` bits connect, at most one fewer than fingerprints."""
    edges, rest = [], prints.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hit = rest[near]
                edges.extend((int(x), int(y)) for y in hit)
                stack.extend(hit)
                rest = rest[~near]
    return [(a - (1 << BITS) if a >> 63 else a, b - (1 << BITS) if b >> 63 else b) for a, b in edges]


def links(prints: DataFrame, radius: int = 4, block: int = 8192) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (column ``fp``) whose components are those of all links."""
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))
    ])
    rows = prints.select("fp", F.explode(tables).alias("e")).select("e.t", "e.key", "fp")
    buckets = written(
        rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
        "buckets",
    )
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    large = buckets.where("n > 2").select("t", "key", F.ceil(F.col("n") / block).alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (
        rows.join(large, ["t", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )
    keys = ["t", "key", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for group in sorted_groups(batches, keys):
            found.update(forest(group.column("fp").to_numpy(), radius))
            if len(found) > 100_000:
                yield edges_batch(found)
                found = set()
        yield edges_batch(found)

    def edges_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dense = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")
    return pairs.union(dense)


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, block: int = 8192,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the columns in ``carry`` (all by default), ``fingerprint`` and ``component_id``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest id
    reachable. ``keeps`` is true for one row of each group: the first with that id. Null and empty texts and
    texts of white space have fingerprint zero and link like any other. A null id takes part but names no
    component: its group carries the smallest id that is not null, or null. Repeated rows and ids give a row
    each. Columns of ``docs`` named like the new ones are replaced. An empty table gives an empty table.
    """
    new = ["fingerprint", "component_id", "keeps"]
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    inner = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.struct(*carried).alias("row"))
    # The row number is stored with the row, so that it stays the same whenever it is read.
    marked = written(
        with_fingerprints(inner, width=width).select("id", "row", "fp", F.monotonically_increasing_id().alias("n")),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    prints = marked.groupBy("fp").agg(first)
    parts = components(links(prints.select("fp"), radius, block))
    named = prints.join(parts, prints.fp == parts.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    firsts = named.groupBy("component").agg(F.min("first").alias("chosen"))
    groups = named.join(firsts, "component").select("fp", "chosen")
    return marked.join(groups, "fp").select(
        "row.*",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("chosen.id").alias("component_id"),
        (F.col("n") == F.col("chosen.n")).alias("keeps"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest id stays, unchanged.

    Texts are near-duplicates if the sets of their ``width``-word shingles have a Jaccard similarity of ``least`` or more,
    and a group is what such pairs connect. Candidates are texts whose fingerprints differ in ``radius`` bits or fewer, by
    covering masks, and texts that agree on a band of minima; all are verified on the sets (see ``shingle_groups``).
    Null and empty texts and texts of white space are equal. Of equal ids the first row stays, and null ids come last.
    """
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("kept_row"), F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    # The row number is stored with the row, so that it stays the same whenever it is read.
    signed = with_sets(with_fingerprints(held, width=width), width).withColumn("n", F.monotonically_increasing_id()).drop("text")
    marked = written(signed, "signed_texts")
    prints = marked.groupBy("fp").agg(F.min("sig.digest").alias("digest"))
    near = links(prints.select("fp"), radius)
    of = lambda c, d: prints.select(F.col("fp").alias(c), F.col("digest").alias(d))
    linked = near.join(of("a", "digest_a"), "a").join(of("b", "digest_b"), "b").select("digest_a", "digest_b")
    # Texts of one fingerprint and different sets.
    same = marked.select("fp", "sig.digest").join(prints.withColumnRenamed("digest", "least"), "fp").where("digest != least")
    linked = linked.unionByName(same.select(F.col("least").alias("digest_a"), F.col("digest").alias("digest_b"))).distinct()
    groups = grouped(marked.select("n", F.col("kept_row")[text].alias("text"), "sig"), linked, least, width)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    rows = marked.select("id", "n", "sig.digest")
    named = written(rows.join(groups, "digest").select("component", "id", "n"), "shingle_members")
    stays = named.groupBy("component").agg(first).select(F.col("first.n").alias("n"))
    goes = written(named.join(stays, "n", "left_anti").select("n"), "shingle_copies")
    return marked.join(broadcast_checked(goes), "n", "left_anti").select("kept_row.*")
