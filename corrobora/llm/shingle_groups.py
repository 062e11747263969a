"""Groups of texts whose sets of word shingles are similar: what SimHash at a few bits cannot reach.

A fingerprint of 64 bits tells pairs of a Jaccard similarity of 0.8 apart by about ten bits, and masks that cover ten bits
of 64 keep too few bits to select anything. So candidates come from minima of the shingle hashes under random permutations
as well: texts that agree on all minima of a band meet. With 32 bands of 8 a pair of similarity 0.8 meets with
probability 0.997, one of 0.9 with one miss in 10^8. Every candidate is verified by the exact similarity of its sets.

Equal sets are one node. In a bucket of many nodes each is compared with the smallest. Where that leaves more than one
component in a bucket, members of different components are compared in blocks, by all their minima first and then by their
sets, so no group is split, while a block gives a forest of its links and a bucket of near copies one comparison a member.
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
from corrobora.session import broadcast_checked

SEED = 42
BANDS, ROWS = 32, 8
_RNG = np.random.default_rng(7)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Minima that must agree before two members of a bucket are verified: at 0.8 of 256, 0.68 lies five deviations below.
AGREE = 0.68
# A block of a bucket holds about so many bytes of sets at most.
BLOCK_BYTES = 16 * 1024 * 1024


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, one of none has none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest upper halves of the hashes under each permutation."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048, None] * _TIMES[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``sig``: struct of the set's digest and a key for each band."""
    kind = "struct<digest: binary, keys: array<long>>"

    @arrow_udf(kind)
    def signed(texts: pa.Array) -> pa.Array:
        digests, keys = [], []
        for x in texts.cast(pa.binary()):  # one text at a time
            hashes = shingle_set(x.as_py() or b"", width)
            digests.append(xxhash.xxh128_digest(hashes.tobytes()))
            bands = minima(hashes).reshape(BANDS, ROWS)
            keys.append([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(bands)])
        return pa.StructArray.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "keys"],
        )

    return docs.withColumn("sig", signed(F.col("text").cast("string")))


def verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``edges`` (a, b) whose sets (node, set) have a similarity of ``least`` or more."""

    @arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        of = lambda s: np.frombuffer(s.as_py(), np.uint64)
        return pa.array([jaccard(of(a), of(b)) >= least for a, b in zip(x, y)], pa.bool_())

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("_x")), sets.select(F.col("node").alias("b"), F.col("set").alias("_y"))
    both = edges.join(left, "a").join(right, "b")
    sizes = F.least(F.octet_length("_x"), F.octet_length("_y")) >= least * F.greatest(F.octet_length("_x"), F.octet_length("_y"))
    return both.where(sizes).where(alike("_x", "_y")).select("a", "b")


def mixed_links(rows: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Verified edges (a, b) between different components of a bucket; ``rows`` are (key, node, component).

    Buckets are compared in blocks, with their ``sets`` (node, set) beside them. A link is verified where it is found and
    joins its components at once, so a block gives at most a spanning forest of what its links connect, never its pairs.
    """

    @arrow_udf("binary")
    def low_of(sets: pa.Array) -> pa.Array:
        return pa.array([minima(np.frombuffer(x.as_py(), np.uint64)).tobytes() for x in sets], pa.binary())

    met = broadcast_checked(written(rows.select("node").distinct(), "shingle_mixed_nodes"))
    held = written(sets.join(met, "node", "left_semi").select("node", "set", low_of("set").alias("low")), "shingle_mixed_sets")
    rows = rows.join(held, "node")
    full = F.greatest(F.count("*") / block, F.sum(F.octet_length("set").cast("long")) / BLOCK_BYTES)
    sizes = rows.groupBy("key").agg(F.ceil(full).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        rows.join(sizes, "key").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component", "low", "set")
    )
    keys = ["key", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            nodes, parts = group.column("node").to_numpy(), group.column("component").to_numpy().copy()
            low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint32).reshape(len(nodes), -1)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("set")]
            found = forest(parts, low, sets, least)
            a, b = ([pick(nodes[x], nodes[y]) for x, y in found] for pick in (min, max))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long").distinct()


def forest(parts: np.ndarray, low: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places of similar sets of different components, such that they connect what all links do; ``parts`` are changed.

    Members are tried in the order in which they are reached, so that a group of near copies is one component soon.
    """
    size = np.array([len(s) for s in sets])
    edges, waiting, queued = [], list(range(len(sets)))[::-1], np.zeros(len(sets), bool)
    done = np.zeros(len(sets), bool)
    while waiting:
        i = waiting.pop()
        if done[i]:
            continue
        done[i] = True
        rest = np.flatnonzero((parts != parts[i]) & ~done)
        rest = rest[np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i])]
        for k in rest[(low[rest] == low[i]).mean(axis=1) >= AGREE]:
            if parts[k] != parts[i] and jaccard(sets[i], sets[k]) >= least:
                edges.append((i, int(k)))
                parts[parts == parts[k]] = parts[i]
                if not queued[k]:
                    queued[k] = True
                    waiting.append(int(k))
    return edges


def grouped(marked: DataFrame, extra: DataFrame | None = None, least: float = 0.8, width: int = 5, block: int = 1024) -> DataFrame:
    """(digest, component) of texts ``marked`` (n, text, sig): the least row number of all that similar sets connect.

    ``extra`` are candidates (digest_a, digest_b) from elsewhere. ``marked`` is read several times: write it first.
    """
    nodes = written(
        marked.groupBy("sig.digest").agg(F.min("n").alias("node"), F.first("sig.keys").alias("keys")),
        "shingle_nodes",
    )
    band = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    leaders = written(band.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "shingle_buckets")
    # Rows of buckets of two and more are found once; the others meet nobody.
    members = written(band.join(broadcast_checked(leaders.select("key", "a")), "key"), "shingle_band_members")
    stars = members.where("a < node").select("a", F.col("node").alias("b")).distinct()
    if extra is not None:
        name = lambda c, x: nodes.select(F.col("digest").alias(c), F.col("node").alias(x))
        more = extra.join(name("digest_a", "a"), "digest_a").join(name("digest_b", "b"), "digest_b")
        stars = stars.unionByName(more.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    stars = written(stars, "shingle_stars")

    @arrow_udf("binary")
    def set_of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.as_py() or b"", width).tobytes() for x in texts.cast(pa.binary())], pa.binary())

    # Sets are made for nodes in buckets only.
    asked = written(members.select("node").unionByName(
        stars.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "shingle_asked")
    texts = marked.select(F.col("n").alias("node"), F.col("text").cast("string").alias("text")).join(broadcast_checked(asked), "node", "left_semi")
    sets = written(texts.select("node", set_of("text").alias("set")), "shingle_sets")
    links = written(verified(stars, sets, least), "shingle_links")
    parts = components(links)
    placed = written(nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "shingle_parts")
    open_rows = members.select("node", "key").join(placed, "node")
    mixed = open_rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y AND n > 2")
    rows = written(open_rows.join(mixed.select("key"), "key", "left_semi"), "shingle_mixed")
    more = written(mixed_links(rows, sets, least, block), "shingle_more_links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    return nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
