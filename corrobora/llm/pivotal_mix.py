"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weighted share of the mix, at most ``cap`` times its size. Each document of a source
should be taken target / size times: a whole number of copies, and a fraction that must be rounded. Pairs of
fractional documents transfer mass at random, keeping its expectation, until one of the two is integral; the
other goes on with what is left. Mass is counted in words, so a transfer keeps the words of the source, and the
mix misses a target by part of one document. Documents of like size are paired first, and large ones before
small ones, so that this last document is small. Residuals are combined by a reduction tree: chunks of a size
class, then chunks of chunks, then classes of a source. Every group holds about ``chunk`` documents, so a source
with a third of all rows is spread over as many tasks as it needs. Draws are hashes of ids and a seed: reruns
agree.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import n_words, written
from corrobora.operators.ranking import distributed_rank
from corrobora.session import broadcast_checked

CLASSES_PER_OCTAVE = 8


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares by weight, excess over the cap shared anew.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = written(distributed_rank(sizes, [], order, "rank"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    # The level only rises, and each rise caps one more source at least.
    while level != before:
        before = level
        over = F.col("weight") * level > limit
        full, open_ = ranked.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if open_:
            level = (total * share - (full or 0.0)) / open_
    return ranked.select("source", "source_size", "rank", F.least(F.col("weight") * level, limit).alias("target"))


def _draw(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) * F.lit(2.0**-53)


def _pair(seed: int):
    """Fold step: the fractional document carried so far meets the next; one of them becomes integral."""

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"]
        mine, other = held["mass"] * held["size"], x["mass"] * x["size"]  # in words
        # Words that the first can gain from the second until it is whole or the second is empty, and lose likewise.
        gain = F.least(held["size"] - mine, other)
        loss = F.least(mine, x["size"] - other)
        gains = _draw(seed, held["hash"], x["hash"]) * (gain + loss) < loss
        # The first is settled if its own room is what ends the transfer, else the second is.
        first = F.when(gains, held["size"] - mine <= other).otherwise(mine <= x["size"] - other) | (mine <= 0)
        moved = F.when(gains, gain).otherwise(-loss)
        stays = lambda c: F.when(first, x[c]).otherwise(held[c]).alias(c)
        rest = F.struct(
            F.when(mine <= 0, x["mass"]).when(first, (other - moved) / x["size"]).otherwise((mine + moved) / held["size"]).alias("mass"),
            stays("size"), stays("hash"), stays("n"),
        )
        whole = (mine > 0) & (gains == first)
        taken = F.when(first, held["n"]).otherwise(x["n"])
        return F.struct(rest.alias("held"), F.when(whole, F.array_append(acc["won"], taken)).otherwise(acc["won"]).alias("won"))

    return step


def _reduce(units: DataFrame, keys: list[str], seed: int, name: str) -> DataFrame:
    """One row per group: the residual (mass, size, hash, n) and the rows ``won`` in it."""
    unit = F.struct("size", "hash", "n", "mass")
    empty = F.struct(
        F.struct(F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("hash"),
                 F.lit(-1).cast("long").alias("n")).alias("held"),
        F.array().cast("array<bigint>").alias("won"),
    )
    folded = units.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(unit))).alias("units")).select(
        *keys, F.aggregate("units", empty, _pair(seed)).alias("r")
    )
    return written(folded.select(*keys, "r.held.*", "r.won"), name)


def rounded(units: DataFrame, seed: int, chunk: int) -> DataFrame:
    """Row numbers ``n`` whose fraction is rounded up, from units (rank, size, hash, n, mass)."""
    units = units.withColumn("class", F.floor(F.log2("size") * CLASSES_PER_OCTAVE))
    counts = written(
        units.groupBy("rank", "class").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "chunks"
    )
    # Rows are dealt by their draw, so that reruns agree. Rows that share a draw, as rows without an id do, are alike in all
    # but their texts; where they are more than a chunk they are dealt by their numbers.
    shared = units.groupBy(F.col("hash").alias("draw")).agg(F.count("*").alias("many")).where(F.col("many") > chunk)
    units = units.join(broadcast_checked(counts), ["rank", "class"]).join(shared, F.col("hash") == F.col("draw"), "left")
    dealt = F.xxhash64(F.lit(seed), "hash", F.when(F.col("many").isNotNull(), F.col("n")))
    plain = F.xxhash64(F.lit(seed), "hash")
    units = units.withColumn("chunk", F.pmod(F.when(F.col("many").isNull(), plain).otherwise(dealt), F.col("chunks"))).drop("draw", "many")
    most = counts.agg(F.max("chunks")).first()[0] or 0
    won = None
    keys = ["rank", "class", "chunk"]
    while True:
        level = _reduce(units, keys, seed, "reduced")
        taken = level.select(F.explode("won").alias("n"))
        won = taken if won is None else won.union(taken)
        rest = level.drop("won").where("mass > 0")
        if keys == ["rank"]:
            break
        if most > 1:
            units, most = rest.withColumn("chunk", F.expr(f"chunk div {chunk}")), -(-most // chunk)
        else:
            units, keys = rest, ["rank"]
    # What is left of a source is one fraction. It goes to the nearer whole number: a draw could miss by more.
    return won.union(rest.where("mass >= 0.5").select("n"))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, seed: int = 11, chunk: int = 256, carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the columns in ``carry`` (all by default), then ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken`` (``size`` times ``copies``).

    A null or empty text has size 0 and is not taken. A null source is a source of its own, the last. Repeated
    rows are rounded one by one. Columns of ``docs`` named like the new ones are replaced. An empty table gives
    an empty table; a source without words has target 0.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    # The row number is stored with the row, so that it stays the same whenever it is read.
    marked = written(
        docs.select(
            F.struct(*carried).alias("row"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id), F.col(source)).alias("hash"), F.monotonically_increasing_id().alias("n"),
        ),
        "sized",
    )
    sizes = marked.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = written(targets(sizes, weights, share, cap), "targets")
    numbered = aims.withColumnRenamed("source", "of")
    rows = marked.join(broadcast_checked(numbered), marked.source.eqNullSafe(numbered.of)).withColumn(
        "wanted", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    mass = F.col("wanted") - F.floor("wanted")
    units = rows.select("rank", "size", "hash", "n", mass.alias("mass")).where("mass > 0")
    won = rounded(units, seed, chunk).select("n", F.lit(1).alias("up"))
    copies = (F.floor("wanted") + F.coalesce("up", F.lit(0))).cast("long")
    return rows.join(won, "n", "left").select(
        "row.*", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged."""
    held = docs.select(F.struct(*docs.columns).alias("kept_row"), *[F.col(c).alias(f"mix_{c}") for c in ("doc_id", "text", "source")])
    out = mix(held, "mix_doc_id", "mix_text", "mix_source", carry=["kept_row"], **settings).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("kept_row.*")
