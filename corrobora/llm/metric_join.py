"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine at least c lie within r = sqrt(2 - 2c) of each other. Pivots, drawn in the order of a
hash, part the vectors into cells by the nearest pivot. By the triangle inequality a partner of x can lie in
the cell of pivot q only if d(x, q) - d(x, p) <= 2r for x's own pivot p, and d(x, q) <= r + radius(q); for unit
vectors the distance of x from the plane between the pivots bounds it more sharply. Of two cells one is visited
by the other's rows, never both, so each pair is compared once. Cells of more than ``block`` rows are cut, and
their parts visit each other. A task holds one part and one batch of visitors, so its memory does not grow
with a cell, and it returns link counts and a forest of links, never the pairs themselves.

Exact copies of a vector are one vector with a weight. In data without cluster structure (random directions in
64 dimensions) the bounds exclude little and the work is that of a blocked comparison of all vectors; pivots
then cost nothing but gain nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import components, sorted_groups, written

SLACK = 1e-9


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of huge and tiny components in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Linked:
    """Link counts of a cell part and its visitors, and edges whose components are those of the links found."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, least: float) -> None:
        self.ids, self.x, self.weight, self.least = ids, x, weight, least
        self.counts = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))
        self.edges: list[tuple[int, int]] = []

    def near(self, y: np.ndarray) -> np.ndarray:
        """True where a row of ``y`` and a row of the part have a cosine of at least ``least``."""
        g = y @ self.x.T
        hit = g >= self.least
        close = np.argwhere(np.abs(g - self.least) <= SLACK)
        if len(close):
            a, b = y[close[:, 0]], self.x[close[:, 1]]
            exact = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            hit[close[:, 0], close[:, 1]] = exact >= self.least
        return hit

    def join(self, rows: np.ndarray, own: int) -> None:
        """Record that vector ``own`` links to these rows of the part, keeping a forest only."""
        self.edges.append((own, int(self.ids[rows[0]])))
        labels = np.unique(self.label[rows])
        if len(labels) > 1:
            for other in labels[1:]:
                of = rows[self.label[rows] == other][0]
                self.edges.append((int(self.ids[rows[0]]), int(self.ids[of])))
            self.label[np.isin(self.label, labels)] = labels[0]

    def inside(self, block: int = 1024) -> None:
        for a in range(0, len(self.ids), block):
            hit = self.near(self.x[a : a + block])
            rows = np.arange(len(hit))
            hit[rows, rows + a] = False
            self.counts[a : a + block] += hit @ self.weight
            for k in np.flatnonzero(hit.any(axis=1)):
                self.join(np.flatnonzero(hit[k]), int(self.ids[a + k]))

    def visited(self, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, block: int = 1024) -> Iterator[tuple]:
        """Counts of the visitors, as (id, links)."""
        for a in range(0, len(ids), block):
            hit = self.near(y[a : a + block])
            some = np.flatnonzero(hit.any(axis=1))
            if len(some):
                self.counts += weight[a + some] @ hit[some].astype(np.int64)
                for k in some:
                    self.join(np.flatnonzero(hit[k]), int(ids[a + k]))
                yield from zip(ids[a + some].tolist(), (hit[some] @ self.weight).tolist())


def links(classes: DataFrame, least: float, pivots: int | None, block: int) -> DataFrame:
    """Rows (a, b, n) over distinct vectors (id, x, weight): a has n links (b null), or a and b are connected."""
    spark = classes.sparkSession
    total = classes.count()
    wanted = pivots or max(1, min(1024, total // block))
    drawn = np.array([r.x for r in classes.orderBy(F.xxhash64("id"), "id").limit(wanted).select("x").collect()], np.float64)
    if not len(drawn):
        return spark.createDataFrame([], "a long, b long, n long")
    centre = spark.sparkContext.broadcast(unit(drawn))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    k = len(drawn)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = centre.value
        for batch in batches:
            cos = unit(matrix(batch.column(1))) @ p.T
            cell = cos.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "x", "weight", "cell", "far"]
            )

    kind = classes.schema["x"].dataType.simpleString()
    at_home = written(classes.mapInArrow(homes, f"id long, x {kind}, weight long, cell int, far double"), "cells")
    sizes = {r.cell: (r.n, r.reach) for r in at_home.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).collect()}
    parts = np.array([-(-sizes.get(c, (0, 0))[0] // block) for c in range(k)], np.int64)
    reach = np.array([sizes.get(c, (0, 0.0))[1] for c in range(k)])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the part a vector lives in, and one for each part that it must visit."""
        p = centre.value
        between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        # Of cells a < b, b's rows visit a if a + b is even, else a's rows visit b.
        grid = np.arange(k)
        visitor = ((grid[:, None] + grid) % 2 == 0) == (grid[:, None] > grid)
        np.fill_diagonal(visitor, False)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = unit(matrix(batch.column(1)))
            cell = batch.column(3).to_numpy()
            rows = np.arange(len(ids))
            cos = x @ p.T
            own = cos[rows, cell][:, None]
            d = np.sqrt(np.maximum(0, 2 - 2 * cos))
            open_ = d - d[rows, cell][:, None] <= 2 * radius + SLACK
            open_ &= d <= radius + reach + SLACK
            open_ &= own - cos <= radius * between[cell] + SLACK
            open_ &= visitor[cell] & (parts > 0)
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, parts[cell])
            from_, to, sub, role = [rows], [cell], [part], [np.zeros(len(rows), np.int32)]
            who, where = np.nonzero(open_)
            copies = parts[where]
            from_.append(np.repeat(who, copies))
            to.append(np.repeat(where, copies))
            ends = np.cumsum(copies)
            sub.append(np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - copies, copies))
            # Parts of one cell: a part's rows visit all later parts.
            later = parts[cell] - 1 - part
            from_.append(np.repeat(rows, later))
            to.append(np.repeat(cell, later))
            ends = np.cumsum(later)
            sub.append(np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - later, later) + np.repeat(part + 1, later))
            take = np.concatenate(from_)
            role.append(np.ones(len(take) - len(rows), np.int32))
            to, sub, role = (np.concatenate(v) for v in (to, sub, role))
            for a in range(0, len(take), 5000):
                cut = slice(a, a + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cut].astype(np.int32)), pa.array(sub[cut].astype(np.int32)), pa.array(role[cut]),
                     *(batch.column(c).take(pa.array(take[cut])) for c in (0, 1, 2))],
                    names=["cell", "part", "role", "id", "x", "weight"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted: first the rows of a part, then its visitors, in runs of a batch at most."""
        home: Linked | None = None
        at = None
        for group in visiting(batches):
            here = (group.column("cell")[0].as_py(), group.column("part")[0].as_py())
            ids = group.column("id").to_numpy()
            x = unit(matrix(group.column("x")))
            weight = group.column("weight").to_numpy()
            if group.column("role")[0].as_py() == 0:
                if home is not None:
                    yield closing(home)
                home, at = Linked(ids, x, weight, least), here
                home.inside()
            elif at == here:
                yield rows_of([(a, None, n) for a, n in home.visited(ids, x, weight)])
        if home is not None:
            yield closing(home)

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """A part's own rows whole; its visitors batch by batch, so that they are never held together."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for group in sorted_groups(iter([batch]), ["cell", "part", "role"]):
                key = tuple(group.column(c)[0].as_py() for c in ("cell", "part", "role"))
                if held and key != held_key:
                    yield pa.concat_tables(held)
                    held = []
                if key[2] == 0:
                    held.append(group)
                    held_key = key
                else:
                    yield group
        if held:
            yield pa.concat_tables(held)

    def closing(home: Linked) -> pa.RecordBatch:
        some = np.flatnonzero(home.counts)
        return rows_of(
            [(int(home.ids[i]), None, int(home.counts[i])) for i in some] + [(a, b, 0) for a, b in set(home.edges)]
        )

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    dealt = at_home.mapInArrow(visits, f"cell int, part int, role int, id long, x {kind}, weight long")
    # One task for each part of a cell, or a few: parts are of like size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.sum()))
    grouped = dealt.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "role")
    return written(grouped.mapInArrow(compare, "a long, b long, n long"), "links")


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, pivots: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` is the number of other rows with a cosine of ``least`` or more, ``component_id`` the smallest id
    reachable. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so
    do vectors of different lengths. Repeated rows and ids count as vectors of their own; of equal ids in one group
    each row names the same component. A null id takes part in links but names no component. Other columns are not
    carried. An empty table gives an empty table.
    """
    x = F.col(vector)
    sound = (
        x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
        & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.select(F.col(id).alias("id"), F.when(sound, x).alias("x"))
    good = rows.where("x is not null")
    # A class is all rows with the same components; its number is stored, so it stays the same when read again.
    classes = written(
        good.groupBy("x").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    lengths = [r[0] for r in classes.select(F.size("x")).distinct().collect()]
    found = None
    for n in lengths:
        some = links(classes.where(F.size("x") == n).select("id", "x", "weight"), least, pivots, block)
        found = some if found is None else found.union(some)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("id"), "component")
    named = (
        classes.select("x", "id", "first", "weight").join(counts, "id", "left").join(parts, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "component").select(
        "x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    linked = good.join(known, "x").select("id", "n_links", "component_id")
    alone = rows.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
