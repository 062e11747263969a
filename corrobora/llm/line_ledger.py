"""Reversible line de-duplication: exact reference-count tables behind sharded cuckoo filters.

A line's key is the line without white space at its ends, with A-Z in lower case. A key that enough documents hold
loses its lines in all of them but the one with the largest id. The ledger remembers which document holds which key,
so documents can be added and deleted, and the lines of what is left come out as if it had been there alone:

* ``refs``: a row for each key and document that holds it (or no longer does). The newest row counts.
* ``counts``: a row for each key and change: number of documents and largest id. The newest row counts.
* ``filters``: one cuckoo filter for each shard of the keys, a few kilobytes each. A key stands in its filter as often as
  documents hold it, up to the threshold. No copy: the key is new, and the exact tables need not be asked. Fewer copies
  than the threshold: its lines stay. Enough copies: the exact table decides, as different keys may look alike.

Changes are appended, never written over; ``compacted`` folds them. Keys are dealt by their hash after they were
reduced to one row each, so a line that stands in every document is a single row wherever its shard is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written

LEAST_CHARS = 20
LEAST_DOCS = 3
WHITE = " \t\n\x0b\x0c\r"
SLOTS = 4
BUCKETS = 4096
# Copies a shard is laid out for; a filter is full at about 95 % of BUCKETS * SLOTS.
SHARD_COPIES = 8192
ROUNDS = 400

# ---------------------------------------------------------------------------------------------- cuckoo filter


def places(hashes: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (1 to 65535) and first bucket of each 64-bit hash."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    prints = (h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
    return prints.astype(np.uint16), ((h >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)


def other(at: np.ndarray, prints: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The second bucket of a fingerprint from its first, and the first from its second."""
    return at ^ (prints.astype(np.int64) * 0x5BD1E995 >> 7 & (buckets - 1))


def _packed(prints: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    return prints.astype(np.int64) << 32 | np.minimum(at, other(at, prints, buckets))


def add(slots: np.ndarray, prints: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Put every fingerprint into one of its two buckets, a newcomer a bucket and round; what finds none is returned packed.

    In a full bucket the newcomer takes a slot drawn by round and bucket, and the fingerprint there moves to its other bucket.
    """
    buckets = len(slots)
    for turn in range(rounds):
        if not len(prints):
            break
        order = np.argsort(at, kind="stable")
        prints, at = prints[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        b, p = at[first], prints[first]
        free = slots[b] == 0
        room = free.any(axis=1)
        slot = np.where(room, free.argmax(axis=1), (b * 0x9E3779B1 + turn * 0x85EBCA77 >> 13) % SLOTS)
        out = slots[b, slot]
        slots[b, slot] = p
        rest = other(at[~first], prints[~first], buckets)
        moved = other(b[~room], out[~room], buckets)
        prints, at = np.concatenate([prints[~first], out[~room]]), np.concatenate([rest, moved])
    return _packed(prints, at, buckets)


def remove(slots: np.ndarray, stash: np.ndarray, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Take one copy of every fingerprint away, from its buckets or else from the stash, whose rest is returned."""
    buckets = len(slots)
    while len(prints):
        _, first = np.unique(_packed(prints, at, buckets), return_index=True)
        p, b = prints[first], at[first]
        for second in (False, True):
            bucket = other(b, p, buckets) if second else b
            match = slots[bucket] == p[:, None]
            hit = match.any(axis=1)
            slots[bucket[hit], match[hit].argmax(axis=1)] = 0
            p, b = p[~hit], b[~hit]
        if len(p) and len(stash):
            for x in _packed(p, b, buckets):
                stash = np.delete(stash, np.flatnonzero(stash == x)[:1])
        rest = np.ones(len(prints), bool)
        rest[first] = False
        prints, at = prints[rest], at[rest]
    return stash


def copies_of(slots: np.ndarray, stash: np.ndarray, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each fingerprint stands in its two buckets and the stash."""
    second = other(at, prints, len(slots))
    n = (slots[at] == prints[:, None]).sum(axis=1)
    n += np.where(second == at, 0, (slots[second] == prints[:, None]).sum(axis=1))
    if len(stash):
        kept = np.sort(stash)
        want = _packed(prints, at, len(slots))
        n += np.searchsorted(kept, want, "right") - np.searchsorted(kept, want, "left")
    return n


# ------------------------------------------------------------------------------------------------------ lines


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(key, id, version, pos) of every line that is long enough; a key is 128 bits of a SHA-256.

    What is told of the text is computed before its lines are parted, once for each text. A key has as many code
    points as the trimmed line, so only lines that are long enough are lowered and digested.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("id", F.unhex(F.md5(text)).alias("version"), F.split(text, "\n", -1).alias("parts"))
    each = whole.select("id", "version", F.posexplode("parts").alias("pos", "line"))
    long = each.where(F.length(F.btrim("line", F.lit(WHITE))) >= least_chars)
    return long.select(F.unhex(F.substring(F.sha2(key_of(F.col("line")), 256), 1, 32)).alias("key"), "id", "version", "pos")


# ----------------------------------------------------------------------------------------------------- ledger


@dataclass(frozen=True)
class Ledger:
    """What is known of all documents added and not deleted. ``generation`` numbers the changes."""

    refs: list[DataFrame]
    counts: list[DataFrame]
    filters: DataFrame | None
    shards: int
    generation: int = 0
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS


EMPTY = Ledger([], [], None, 1)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _current_refs(ledger: Ledger, keys: DataFrame) -> DataFrame:
    """(key, id) of the documents that hold one of ``keys`` (a row each) now."""
    asked = _union(ledger.refs).join(keys.select("key"), "key", "left_semi")
    return asked.groupBy("key", "id").agg(F.max_by("held", "generation").alias("held")).where("held").select("key", "id")


def current_counts(ledger: Ledger, keys: DataFrame | None = None) -> DataFrame:
    """(key, n_docs, last) of all keys, or of ``keys`` (a row each), that some document holds now."""
    rows = _union(ledger.counts)
    if keys is not None:
        rows = rows.join(keys.select("key"), "key", "left_semi")
    newest = F.max_by(F.struct("n_docs", "last"), "generation").alias("c")
    return rows.groupBy("key").agg(newest).select("key", "c.*").where("n_docs > 0")


def _over_filters(ledger: Ledger, rows: DataFrame, fn: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``fn`` on the rows of each shard with its filter's slots and stash, empty ones where the shard has none."""

    def joined(mine: pa.Table, filters: pa.Table) -> pa.Table:
        slots, stash = np.zeros((BUCKETS, SLOTS), np.uint16), np.zeros(0, np.int64)
        if filters.num_rows:
            slots = np.frombuffer(filters.column("slots")[0].as_py(), np.uint16).reshape(-1, SLOTS).copy()
            stash = np.array(filters.column("stash")[0].as_py(), np.int64)
        return fn(mine, slots, stash)

    filters = ledger.filters
    if filters is None:
        filters = rows.sparkSession.createDataFrame([], "shard int, slots binary, stash array<long>")
    dealt = rows.withColumn("shard", _shard("key", ledger.shards)).withColumn("hash", F.xxhash64("key", F.lit("bucket")))
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(joined, schema)


def probed(ledger: Ledger, keys: DataFrame) -> DataFrame:
    """(key, copies) of ``keys`` (a row each) in the filters."""

    def probe(mine: pa.Table, slots: np.ndarray, stash: np.ndarray) -> pa.Table:
        n = copies_of(slots, stash, *places(mine.column("hash").to_numpy()))
        return pa.table({"key": mine.column("key"), "copies": pa.array(n, pa.int32())})

    return _over_filters(ledger, keys.select("key"), probe, "key binary, copies int")


def _changed_filters(ledger: Ledger, changes: DataFrame) -> DataFrame:
    """The filters after ``changes`` (key, before, after: copies)."""

    def change(mine: pa.Table, slots: np.ndarray, stash: np.ndarray) -> pa.Table:
        prints, at = places(mine.column("hash").to_numpy()) if mine.num_rows else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        more = mine.column("after").to_numpy().astype(np.int64) - mine.column("before").to_numpy()
        less = np.maximum(-more, 0)
        stash = remove(slots, stash, np.repeat(prints, less), np.repeat(at, less))
        more = np.maximum(more, 0)
        stash = np.concatenate([stash, add(slots, np.repeat(prints, more), np.repeat(at, more))])
        shard = mine.column("shard")[0].as_py() if mine.num_rows else None
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([slots.tobytes()], pa.binary()),
                         "stash": pa.array([stash.tolist()], pa.list_(pa.int64()))})

    new = _over_filters(ledger, changes, change, "shard int, slots binary, stash array<long>").where("shard IS NOT NULL")
    if ledger.filters is None:
        return new
    return new.unionByName(ledger.filters.join(new.select("shard"), "shard", "left_anti"))


def _recorded(ledger: Ledger, refs: DataFrame, changes: DataFrame) -> Ledger:
    """``ledger`` with new rows of ``refs`` (key, id, held) and ``changes`` (key, n_before, n_docs, last)."""
    now = ledger.generation + 1
    stamp = F.lit(now).alias("generation")
    counts = written(changes.select("key", "n_before", "n_docs", "last", stamp), "line_counts")
    after = replace(
        ledger, refs=[*ledger.refs, written(refs.select("key", "id", "held", stamp), "line_refs")],
        counts=[*ledger.counts, counts.drop("n_before")], generation=now,
    )
    cap = ledger.least_docs
    copies = counts.select("key", F.least("n_before", F.lit(cap)).alias("before"), F.least("n_docs", F.lit(cap)).alias("after"))
    added = copies.agg(F.coalesce(F.sum(F.greatest(F.col("after") - F.col("before"), F.lit(0))), F.lit(0))).first()[0]
    held = 0 if ledger.filters is None else ledger.shards * SHARD_COPIES
    if ledger.filters is None or added > held // 2:
        return _laid_out(after)
    return replace(after, filters=written(_changed_filters(ledger, copies.where("before != after")), "line_filters"))


def _laid_out(ledger: Ledger) -> Ledger:
    """New filters from the exact counts, as many as the copies need."""
    copies = current_counts(ledger).select("key", F.lit(0).cast("long").alias("before"), F.least("n_docs", F.lit(ledger.least_docs)).alias("after"))
    total = copies.agg(F.coalesce(F.sum("after"), F.lit(0))).first()[0]
    bare = replace(ledger, filters=None, shards=max(1, -(-total // SHARD_COPIES)))
    return replace(bare, filters=written(_changed_filters(bare, copies), "line_filters"))


def _named(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"))


def insert(ledger: Ledger, docs: DataFrame, id: str = "doc_id", text: str = "text") -> Ledger:
    """``ledger`` with the lines of ``docs``. A line that a document is known to hold already counts once."""
    fresh = written(_lines(_named(docs, id, text), ledger.least_chars).select("key", "id").distinct(), "line_batch")
    touched = fresh.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    if not ledger.counts:
        return _recorded(ledger, fresh.withColumn("held", F.lit(True)), touched.select(
            "key", F.lit(0).cast("long").alias("n_before"), F.col("n").alias("n_docs"), "last"))
    # Keys that no filter knows need no look at the exact tables.
    marked = written(probed(ledger, touched), "line_probes")
    known = marked.where("copies > 0").select("key")
    here = _current_refs(ledger, known).select("key", "id")
    new = fresh.join(here, fresh.key.eqNullSafe(here.key) & fresh.id.eqNullSafe(here.id), "left_anti")
    new = written(new, "line_new")
    old = current_counts(ledger, known).select("key", F.col("n_docs").alias("n_before"), F.col("last").alias("last_before"))
    added = new.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).join(old, "key", "left")
    before = F.coalesce("n_before", F.lit(0))
    return _recorded(ledger, new.withColumn("held", F.lit(True)), added.select(
        "key", before.alias("n_before"), (before + F.col("n")).alias("n_docs"), F.greatest("last", "last_before").alias("last")))


def delete(ledger: Ledger, ids: DataFrame, id: str = "doc_id") -> Ledger:
    """``ledger`` without the documents in ``ids``, unknown ones ignored."""
    if not ledger.refs:
        return ledger
    asked = ids.select(F.col(id).alias("gone")).distinct()
    refs = _union(ledger.refs)
    newest = refs.join(asked, refs.id.eqNullSafe(asked.gone)).groupBy("key", "id").agg(F.max_by("held", "generation").alias("held"))
    gone = written(newest.where("held").select("key", "id"), "line_gone")
    keys = gone.groupBy("key").agg(F.count("*").alias("n"))
    left = _current_refs(ledger, keys).join(gone.select(F.col("key").alias("k"), F.col("id").alias("i")),
                                            F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
    rest = left.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
    now = keys.join(rest, "key", "left").select(
        "key", (F.coalesce("n_docs", F.lit(0)) + F.col("n")).alias("n_before"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last")
    return _recorded(ledger, gone.withColumn("held", F.lit(False)), now)


def compacted(ledger: Ledger) -> Ledger:
    """The same ledger with one row for each key and document, and for each key."""
    if ledger.generation < 2:
        return ledger
    stamp = F.lit(ledger.generation).alias("generation")
    refs = _union(ledger.refs).groupBy("key", "id").agg(F.max_by("held", "generation").alias("held")).where("held")
    return replace(ledger, refs=[written(refs.select("key", "id", "held", stamp), "line_refs")],
                   counts=[written(current_counts(ledger).select("key", "n_docs", "last", stamp), "line_counts")])


def repeated(ledger: Ledger, keys: DataFrame) -> DataFrame:
    """(key, last) of the ``keys`` (a row each) that enough documents hold: filters first, then exact counts."""
    maybe = probed(ledger, keys).where(F.col("copies") >= ledger.least_docs)
    return current_counts(ledger, maybe).where(F.col("n_docs") >= ledger.least_docs).select("key", "last")


def deduplicated(
    ledger: Ledger, docs: DataFrame, id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs``, all of which the ledger knows, with repeated lines dropped from ``text``, and two counts.

    A null text becomes one empty line, as an empty text is. All rows without an id are one document, below all
    others; rows that share an id are one document, each with its own text. Lines shorter than the least length
    stay, however often they occur. Other columns are carried along; columns named like the counts are replaced.
    """
    carried = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    named = _named(docs, id, text)
    if ledger.counts:
        lines = written(_lines(named, ledger.least_chars), "lines")
        hot = repeated(ledger, lines.select("key").distinct())
        hits = lines.join(hot, "key").where(~F.col("id").eqNullSafe(F.col("last")))
    else:
        hits = _lines(named, ledger.least_chars).where("false")
    drops = hits.groupBy("id", "version").agg(F.collect_set("pos").alias("dropped")).select(
        F.col("id").alias("drop_id"), F.col("version").alias("drop_version"), "dropped")
    body = F.coalesce(F.col("body"), F.lit(""))
    held = docs.select(F.struct(*carried).alias("row"), F.col(id).alias("id"), F.col(text).alias("body"))
    met = held.withColumn("version", F.unhex(F.md5(body))).join(
        drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("version") == F.col("drop_version")), "left")
    split = met.withColumn("all_lines", F.split(body, "\n", -1))
    n = F.size("all_lines")
    # Positions that stay, by a hashed set difference, in their order.
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "dropped")
    rest = F.when(F.col("dropped").isNull(), body).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get("all_lines", p)), "\n"))
    out = [rest.alias(c) if c == text else F.col("row")[c].alias(c) for c in carried]
    return split.select(*out, n.cast("long").alias(n_lines), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(n_dropped))
