"""The prefix trie of conversations by collapse of whole sequences.

Identical conversations become one sequence with a weight and the list of its ends. Sequences that are proper
prefixes of others are told from the leaves by an anti-join. Then every prefix of every distinct sequence sums up
what runs through it. A prefix is known by its depth and the exclusive or of 128-bit digests of its turns, each
salted with its position, so it is a running fold that can be cut anywhere:

* turns are numbered by a range-partitioned rank, and running folds go by blocks of ``BLOCK`` turns, whose totals alone
  are carried from block to block, so one conversation may hold any share of all turns;
* texts are digested first and leave the work there;
* sums over a subtree are taken along the sequences: a suffix sum for each of them, and one sum for each prefix. A node
  that several sequences share is owned by one of them, where its text counts once;
* the list of ends is joined to text in pieces over ranges of ids, and only pieces meet, one after the other, where
  the digest of a list is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import written
from corrobora.operators.ranking import distributed_rank

BLOCK = 4096
# Ids in one piece of a list of ends.
PIECE = 4096


def _halves(hex128: Column) -> tuple[Column, Column]:
    """The first 128 bits of a hex digest as two signed numbers."""
    return tuple(F.conv(F.substring(hex128, at, 16), 16, -10).cast("long") for at in (1, 17))


def _turn_hash(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def running(df: DataFrame, by: str, at: str, folds: dict[str, tuple[Callable, str]], backward: bool = False) -> DataFrame:
    """``df`` with each fold (an aggregate function of a column) over the rows of ``by`` up to the row's place ``at``.

    ``backward``: from the row's place on. Places are dense numbers. A block of places is folded in one task, and
    totals of blocks are folded on; ``df`` is read twice.
    """
    sign = -1 if backward else 1
    blocked = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    totals = blocked.groupBy(by, "_block").agg(*[f(c).alias(f"_{name}") for name, (f, c) in folds.items()])
    before = Window.partitionBy(by).orderBy(F.col("_block") * sign).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(by, "_block", *[f(f"_{name}").over(before).alias(f"_{name}") for name, (f, _) in folds.items()])
    inside = Window.partitionBy(by, "_block").orderBy(F.col(at) * sign).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[f(c).over(inside).alias(name) for name, (f, c) in folds.items()])
    return local.join(carried, [by, "_block"])


def _xor_running(df: DataFrame, by: str, at: str) -> DataFrame:
    """(..., k1, k2): the running exclusive or of d1 and d2."""
    out = running(df, by, at, {"k1": (F.bit_xor, "d1"), "k2": (F.bit_xor, "d2")})
    return out.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0))) for k in ("k1", "k2")}).drop("_k1", "_k2", "_block")


def _sum_backward(df: DataFrame, by: str, at: str, sums: dict[str, str]) -> DataFrame:
    out = running(df, by, at, {name: (F.sum, c) for name, c in sums.items()}, backward=True)
    return out.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop("_block", *[f"_{n}" for n in sums])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, idx, turn_hash, bytes): the turns of each conversation from 1 on, in their order, without texts.

    Turns are ordered by ``turn``, null first, equal ones by their digest. A null role or text counts as empty. Rows
    without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = written(
        turns.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_hash(role, text).alias("turn_hash"),
            F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("number")),
        "turns",
    )
    order = [F.asc_nulls_first("turn"), F.col("turn_hash").asc(), F.col("number").asc()]
    return written(distributed_rank(narrow, ["conv_id"], order, "idx").select("conv_id", F.col("idx").cast("long").alias("idx"), "turn_hash", "bytes"), "numbered_turns")


def rebuilt(numbered: DataFrame, span: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: the first h turns of conversation c - c % span, then c's own after its first h.

    ``h`` is the CRC-32 of c modulo ``heads``. Returns (conv_id, length) of all, and (conv_id, idx, turn_hash, bytes).
    At most heads - 1 turns of a conversation are copied, to at most 2 * span - 1 others.
    """
    own = numbered.groupBy("conv_id").agg(F.max("idx").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    asked = own.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = written(
        asked.join(bases, "base", "left").select(
            "conv_id", "own", "h", "base", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken")),
        "conversation_heads",
    )
    first = numbered.where(F.col("idx") < heads).withColumnRenamed("conv_id", "base")
    copied = first.join(plan.select("base", "conv_id", "h"), "base").where("idx <= h").select("conv_id", "idx", "turn_hash", "bytes")
    rest = numbered.join(plan.select("conv_id", "h", "taken"), "conv_id").where("idx > h").select(
        "conv_id", (F.col("idx") - F.col("h") + F.col("taken")).alias("idx"), "turn_hash", "bytes")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, copied.unionByName(rest)


def _ends(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256) from (seq, conv_id): the digest of a sequence's ids, ascending, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            out: list[tuple[int, int, str]] = []
            start = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or seqs[i] != seqs[start] or i - start == PIECE:
                    out.append((seqs[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["seq", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for seq, piece in zip(batch.column("seq").to_pylist(), batch.column("piece").to_pylist()):
                if seq != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if done:
                yield _pairs(done)
                done = []
        if state is not None:
            yield _pairs([(now, state.hexdigest())])

    def _pairs(done: list[tuple[int, str]]) -> pa.RecordBatch:
        seqs, texts = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(texts, pa.string())], names=["seq", "ends_sha256"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    listed = written(ranged.mapInArrow(pieces, "seq long, first long, piece string"), "end_pieces")
    return listed.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digests, "seq long, ends_sha256 string")


NODE = ["depth", "k1", "k2"]


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length) with their ``turns`` (conv_id, idx, turn_hash, bytes).

    Per node: ``conv_id``, the smallest conversation that runs through it; ``depth``; ``parent_conv_id``, that of its
    parent, null for the root; ``n_convs``; ``n_children``; ``n_leaves``; ``saved_tokens``, the bytes that are held once instead of n_convs
    times in its subtree; ``ends_sha256``, the digest of the ids that end there; ``turn_hash`` of its last turn, null for the
    root. A conversation without turns ends at the root. Without conversations there is no node.
    """
    salted = _halves(F.md5(F.concat_ws(":", "idx", "turn_hash")))
    placed = written(turns.select("conv_id", "idx", "turn_hash", "bytes", salted[0].alias("d1"), salted[1].alias("d2")), "rebuilt_turns")

    # Identical conversations collapse: a sequence is named by the smallest of them.
    whole = placed.groupBy("conv_id").agg(F.bit_xor("d1").alias("k1"), F.bit_xor("d2").alias("k2"))
    keyed = written(
        lengths.join(whole, "conv_id", "left").select(
            "conv_id", F.col("length").alias("depth"), F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2")),
        "keyed_conversations",
    )
    seqs = written(keyed.groupBy(*NODE).agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight")), "sequences")
    ends = _ends(keyed.join(seqs.select(*NODE, "seq"), NODE).select("seq", "conv_id"))

    # Every prefix of every sequence, the textless root included.
    named = seqs.select("seq", "weight", F.col("depth").alias("length"))
    paths = placed.join(named.withColumnRenamed("seq", "conv_id"), "conv_id").withColumnRenamed("conv_id", "seq")
    paths = _xor_running(written(paths, "paths"), "seq", "idx").select(
        "seq", "weight", "length", F.col("idx").alias("depth"), "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("d1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("d2")).alias("p2"), "bytes", "turn_hash")
    none = F.lit(0).cast("long")
    root = named.select("seq", "weight", "length", *[none.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "bytes")],
                        F.lit(None).cast("string").alias("turn_hash"))
    prefixes = written(paths.unionByName(root), "prefixes")

    # Leaves: sequences that are no proper prefix of another.
    proper = prefixes.where("depth < length").select(*NODE).distinct()
    leaves = seqs.join(proper, NODE, "left_anti").select("seq", "depth", F.lit(1).cast("long").alias("leaf"))
    owners = prefixes.groupBy(*NODE).agg(F.min("seq").alias("seq")).select("seq", "depth", F.lit(True).alias("owned"))
    flagged = prefixes.join(owners, ["seq", "depth"], "left").join(leaves, ["seq", "depth"], "left").select(
        *[F.col(c) for c in prefixes.columns], F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.when(F.col("owned"), F.col("bytes")).otherwise(0).alias("once"))
    summed = _sum_backward(written(flagged, "flagged"), "seq", "depth", {"below": "bytes", "below_once": "once", "leaves": "leaf"})
    nodes = written(
        summed.groupBy(*NODE).agg(
            F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaves").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("below") - F.col("below_once")).alias("saved_tokens"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("turn_hash").alias("turn_hash")),
        "nodes",
    )
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    ended = seqs.join(ends, "seq").select(*NODE, "ends_sha256")
    return (
        nodes.join(children, NODE, "left").join(ended, NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "turn_hash",
        )
    )


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the ``role`` and ``text`` of their last turn, looked up by its digest; null for the root."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    texts = turns.select(_turn_hash(role, text).alias("turn_hash"), role.alias("role"), text.alias("text"))
    return nodes.join(texts.groupBy("turn_hash").agg(F.first("role").alias("role"), F.first("text").alias("text")), "turn_hash", "left")
