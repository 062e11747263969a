"""A Merkle manifest of a dataset, and its proofs by a recursive climb.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group, in the order of their ids, are hashed in
runs of ``fan`` until one node remains, the group's subroot; the subroots, in the order of their groups, are
hashed likewise up to the root. All digests are lower-case hex, and a node is the digest of its children's
digests, concatenated. A last run may be short; even a single child is hashed.

Built levels are stored as rows, each linked to its parent. A proof is checked by a recursive query: it starts at
the leaves and climbs a level a step, each leaf folding its own, maybe altered, digest with the siblings beside its
way. The leaves of one run have all siblings above the run in common, so a row of the climb carries one run: a step
keeps the ``fan`` folded digests and the siblings of its level, which are appended, level by level, when the climb is
over. A node that many runs climb through stands in copies, so that no key of the join is hot at any height. Digests
are stored as bytes and hashed as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written
from corrobora.operators.ranking import distributed_rank
from corrobora.session import broadcast_checked

FAN = 16
SIZE = 32  # bytes of a digest
# Runs that may meet in one copy of a node.
RUNS_A_COPY = 4096


@dataclass(frozen=True)
class Manifest:
    """``nodes``: a row for each inner node, with its children's digests and its parent. ``runs``: where leaves start."""

    nodes: DataFrame
    runs: DataFrame


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of a row's fields: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hex(digests: Column) -> Column:
    """Binary digests, or several in a row, as text."""
    return F.lower(F.hex(digests))


def _hash(digests: Column) -> Column:
    """The digest of digests in a row."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _row(digests: Column) -> Column:
    """An array of digests as digests in a row."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _beside(row: Column, at: Column, fan: int) -> tuple[Column, Column]:
    """What stands before and behind the digest number ``at`` of a row."""
    return F.substring(row, F.lit(1), at * SIZE), F.substring(row, (at + 1) * SIZE + 1, F.lit(fan * SIZE))


def _up(idx: str, fan: int) -> Column:
    return F.floor(F.col(idx) / fan).cast("long")


def _levels(nodes: DataFrame, most: int, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Every level above ``nodes`` (tree, level, idx, n, digest, runs) as written tables, and the last node of each tree.

    ``n`` is the number of nodes of the tree at this level and ``runs`` that of the runs below; ``most`` is the
    largest ``n``. A level is one grouped aggregation over the level below, of 1/fan of its rows.
    """
    levels, tops, now = [], [nodes.where("n = 1")], nodes
    while most > 1:
        kids = F.sort_array(F.collect_list(F.struct("idx", "digest", "runs")))
        grouped = now.where("n > 1").groupBy("tree", "level", "n", _up("idx", fan).alias("idx")).agg(kids.alias("kids"))
        children = _row(F.transform("kids", lambda k: k["digest"]))
        now = written(
            grouped.select(
                "tree", (F.col("level") + 1).alias("level"), "idx", F.ceil(F.col("n") / fan).cast("long").alias("n"),
                _hash(children).alias("digest"),
                F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["runs"]).alias("runs"),
                children.alias("children"),
            ),
            name,
        )
        levels.append(now)
        tops.append(now.where("n = 1").drop("children"))
        most = -(-most // fan)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def _key(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws("/", tree, level, idx)


def build(
    leaves: DataFrame, id: str = "doc_id", group: str = "source", leaf: str = "leaf", claimed: str = "claimed",
    fan: int = FAN, runs_a_copy: int = RUNS_A_COPY,
) -> Manifest:
    """The manifest of ``leaves``: a row each, with its ``leaf`` digest and the ``claimed`` one to be verified.

    Groups are ordered by the UTF-8 bytes of their text, the null group first and a group of its own; leaves by id,
    null first, equal ids by digest. Repeated rows are leaves like any other. An empty table has no node.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    # The number is stored with its row; it tells repeated rows apart, so that a range can end between them.
    rows = written(
        leaves.select(key.alias("key"), F.col(id).alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(claimed).alias("claimed"),
                      F.monotonically_increasing_id().alias("number")),
        "leaves",
    )
    order = [F.asc_nulls_first("id"), F.col("leaf").asc(), F.col("number").asc()]
    ranked = distributed_rank(rows, ["key"], order, "place").withColumn("idx", F.col("place") - 1)
    member = F.struct("idx", "id", "leaf", "claimed")
    first = written(
        ranked.groupBy("key", _up("idx", fan).alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members")), "runs"
    )
    groups = written(first.groupBy("key").agg(F.sum(F.size("members")).alias("size")), "groups")
    numbered = written(
        distributed_rank(groups, [], [F.col("key").asc()], "tree").withColumn("tree", F.col("tree") - 1), "trees"
    )
    many, largest = groups.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()

    # A run of a group of one leaf is that leaf; other runs are hashed.
    lone = F.col("size") == 1
    digests = _row(F.transform("members", lambda m: m["leaf"]))
    runs = written(
        first.join(numbered, "key").select(
            "tree", F.when(lone, 0).otherwise(1).cast("long").alias("level"), F.col("run").alias("idx"),
            F.ceil(F.col("size") / fan).cast("long").alias("n"),
            F.when(lone, F.col("members")[0]["leaf"]).otherwise(_hash(digests)).alias("digest"),
            F.lit(1).cast("long").alias("runs"), "members",
        ),
        "numbered_runs",
    )
    inner, subroots = _levels(runs.drop("members"), -(-largest // fan), fan, "nodes")
    below = subroots.select(
        F.lit(-1).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("tree").alias("idx"),
        F.lit(many).cast("long").alias("n"), "digest", "runs",
    )
    above, _ = _levels(below, many, fan, "roots")

    # Links: to the next level of the tree; from a subroot to the tree of subroots; the root has none.
    top, subroot = F.col("n") == 1, (F.col("n") == 1) & (F.col("tree") >= 0)
    one_tree = F.lit(many <= 1)
    parent = (
        F.when(~top, _key(F.col("tree"), F.col("level") + 1, _up("idx", fan)))
        .when(subroot & ~one_tree, _key(F.lit(-1), F.lit(1), _up("tree", fan)))
    )
    pos = F.pmod(F.when(top, F.col("tree")).otherwise(F.col("idx")), F.lit(fan)).cast("int")
    linked = [
        _key(F.col("tree"), F.col("level"), F.col("idx")).alias("node"), parent.alias("parent"), pos.alias("pos"), "digest",
        F.when(subroot, F.col("digest")).alias("subroot"), "runs",
    ]
    starts = runs.select(*linked, "members")
    nodes = None
    for level in [*inner, *above]:
        part = level.select(*linked, "children")
        nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:
        nodes = starts.select("node", "parent", "pos", "digest", "subroot", "runs", digests.alias("children")).where("false")
    copies = F.ceil(F.col("runs") / runs_a_copy).cast("long")
    placed = nodes.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return Manifest(written(placed, "manifest"), starts)


# A row is a run at a level: the digests its leaves fold to, in a row, and the siblings that it passes at this level.
CLIMB = """
WITH RECURSIVE climb (step, node, parent, pos, digest, subroot, run, folds, siblings) AS (
  SELECT 0, node, parent, pos, digest, subroot, run, folds, siblings FROM {starts}
  UNION ALL
  SELECT step + 1, node, parent, up_pos, digest, subroot, run,
    unhex(array_join(transform(sequence(1, octet_length(folds), {size}),
      i -> sha2(concat(lower(hex(before)), lower(hex(substring(folds, i, {size}))), lower(hex(behind))), 256)), '')),
    concat(before, behind)
  FROM (
    SELECT c.step, n.node, n.parent, n.pos AS up_pos, n.digest, n.subroot, c.run, c.folds,
      substring(n.children, 1, c.pos * {size}) AS before, substring(n.children, (c.pos + 1) * {size} + 1, {whole}) AS behind
    FROM climb c JOIN {nodes} n ON n.node = c.parent AND n.copy = pmod(xxhash64(c.run), n.copies)
  )
)
SELECT step, digest, subroot, run, folds, siblings FROM climb
"""


def climbed(manifest: Manifest, fan: int = FAN) -> DataFrame:
    """A row for each leaf: ``id``, ``leaf``, ``subroot``, ``root``, ``siblings``, ``folded_root`` and ``verified``.

    ``siblings`` are the digests beside the leaf's way, from the bottom up and from left to right; ``folded_root`` is
    what the claimed digest folds to with them, and ``verified`` whether that is the root.
    """
    spark = manifest.nodes.sparkSession
    leaves = _row(F.transform("members", lambda m: m["leaf"]))
    # Level 0 tells a group of one leaf, which is no run.
    lone = F.split_part("node", F.lit("/"), F.lit(2)) == "0"

    def folded(m: Column) -> Column:
        before, behind = _beside(leaves, (m["idx"] % fan).cast("int"), fan)
        return F.when(lone, m["claimed"]).otherwise(_hash(F.concat(before, m["claimed"], behind)))

    starts = manifest.runs.select(
        "node", "parent", "pos", "digest", "subroot", F.col("node").alias("run"), _row(F.transform("members", folded)).alias("folds"),
        F.unhex(F.lit("")).alias("siblings"),
    )
    # The climb has as many rows as runs times levels, so the guard against runaway recursion is lifted while it runs.
    guard = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(guard)
    spark.conf.set(guard, "-1")
    try:
        climb = spark.sql(CLIMB, starts=starts, nodes=broadcast_checked(manifest.nodes), size=SIZE, whole=SIZE * fan)
        reached = written(climb, "climb")
    finally:
        spark.conf.set(guard, before)
    # A run has a row for each level.
    steps = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    tops = reached.groupBy("run").agg(
        F.max_by("digest", "step").alias("root"), F.max_by("folds", "step").alias("folds"), F.max("subroot").alias("subroot"),
        steps.alias("steps"),
    )
    joined = manifest.runs.select(F.col("node").alias("run"), "members").join(tops, "run")
    above = F.array_join(F.transform("steps", lambda x: _hex(x["siblings"])), "")
    each = joined.select("root", "subroot", "folds", above.alias("above"), leaves.alias("leaves"), F.explode("members").alias("m"))
    at = (F.col("m.idx") % fan).cast("int")
    first, second = _beside(F.col("leaves"), at, fan)
    fold = F.substring("folds", at * SIZE + 1, F.lit(SIZE))
    return each.select(
        F.col("m.id").alias("id"), _hex(F.col("m.leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), F.concat(_hex(F.concat(first, second)), F.col("above")).alias("siblings"),
        _hex(fold).alias("folded_root"), (fold == F.col("root")).alias("verified"),
    )


def tampered_text(id: Column, text: Column, every: int = 5) -> Column:
    """``text`` with A-Z in lower case where ``every`` divides the CRC-32 of the id; a null id or text stays."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(id.cast("string")) % every == 0, lower).otherwise(text)


def verify(docs: DataFrame, fields: list[str], id: str = "doc_id", group: str = "source", text: str = "text", fan: int = FAN,
           runs_a_copy: int = RUNS_A_COPY) -> DataFrame:
    """The proofs of all rows of ``docs``, of which the chosen ones are tampered with: see ``climbed``.

    A null field counts as null, not as an empty text; very long texts are hashed whole; other columns take no part;
    an empty table gives an empty result.
    """
    stored = [F.col(c) for c in fields]
    altered = [tampered_text(F.col(id), F.col(c)) if c == text else F.col(c) for c in fields]
    leaves = docs.select(
        F.col(id).alias("id"), F.col(group).alias("group"), digest_of(stored).alias("leaf"), digest_of(altered).alias("claimed")
    )
    return climbed(build(leaves, "id", "group", fan=fan, runs_a_copy=runs_a_copy), fan)
