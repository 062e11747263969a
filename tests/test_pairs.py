"""Joins without given candidates, draws across tiers and packed texts, against plain computations."""

import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.operators import joins, ranking, similarity
from corrobora.session import fresh_path
from corrobora.sources import tables

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(4)
    claims = [(i, DAY + datetime.timedelta(rnd.randint(0, 40)) if i % 7 else None) for i in range(60)]
    # Half of the evidence is of one day.
    pieces = [(i, DAY + datetime.timedelta(20 if i % 2 else rnd.randint(-3, 45)) if i % 11 else None) for i in range(300)]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return claims, pieces, make(claims, "claim_id long, loss_date date"), make(pieces, "piece long, publish_day date")


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_range_pairs(sides, chunk):
    claims, pieces, c, e = sides
    want = sorted((i, p, (d - t).days) for i, t in claims for p, d in pieces if t and d and -1 <= (d - t).days <= 2)
    assert sorted(tuple(r) for r in joins.match_range(c, e, 1, 2, chunk).select("claim_id", "piece", "gap_days").collect()) == want


def test_nearest(sides):
    claims, pieces, c, e = sides
    want = []
    for i, t in claims:
        near = sorted((abs((d - t).days), (d - t).days, p) for p, d in pieces if t and d and -1 <= (d - t).days <= 2)
        want += [(i, p, k + 1) for k, (_, _, p) in enumerate(near[:4])]
    got = joins.nearest_in_window(c, e, 1, 2, 4, "piece").select("claim_id", "piece", "rank").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_cosine_join(spark):
    """Every pair at every threshold, with words that all texts share and copies among the texts."""
    rnd = random.Random(5)
    text = lambda: Counter([*rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 9)), *["common"] * rnd.randint(0, 3)])
    left, right = {i: text() for i in range(40)}, {i: text() for i in range(60)}
    right |= {100 + i: right[0] for i in range(5)}
    frame = lambda d, k: spark.createDataFrame([(i, t, n) for i, c in d.items() for t, n in c.items()], f"{k} long, term string, n long")
    cos = lambda a, b: sum(a[t] * b[t] for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    for least in (0.3, 0.5, 0.9):
        want = {(i, j): cos(a, b) for i, a in left.items() for j, b in right.items() if cos(a, b) >= least - 1e-9}
        got = {(r.x, r.y): r.cosine for r in similarity.cosine_join(frame(left, "x"), frame(right, "y"), "x", "y", least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one, members = similarity.vector_classes(frame(right, "y"), "y")
    named = {r.y: r.class_key for r in members.collect()}
    assert named == {i: min(j for j, o in right.items() if o == c) for i, c in right.items()}
    assert {r.y for r in one.select("y").collect()} == set(named.values())


def test_a_common_word_stands_in_no_prefix(spark):
    vectors = spark.createDataFrame([(i, t, 1) for i in range(50) for t in ("common", f"a{i}", f"b{i}", f"c{i}")], "x long, term string, n long")
    use = vectors.groupBy("term").agg(F.count("*").alias("_df"))
    first = similarity._weighted(vectors, "x", use, 0.6).where("first")
    assert first.where("term = 'common'").count() == 0 and first.count() == 150


def draws(rows, k):
    queues = {t: sorted((s, c) for s, tier, c in rows if tier == t) for t in range(1, 5)}
    used, out = set(), []
    for i in range(9 * k):
        queue = queues[K.TIER_DRAW_ORDER[i % 9]]
        if queue and len(out) < k:
            one = next((x for x in queue if x[1] not in used), queue[0])
            queue.remove(one)
            used.add(one[1])
            out.append(one[0])
    return out


def test_draws_with_classes_across_tiers(spark):
    rnd = random.Random(6)
    plans = {g: [(s, rnd.randint(1, 4), rnd.choice("abcdef"[: rnd.randint(1, 6)])) for s in range(rnd.randint(1, 30))] for g in range(60)}
    plans[60] = [(s, 1, "same") for s in range(500)] + [(1000, 2, "same"), (1001, 2, "other")]
    df = spark.createDataFrame([(g, *r) for g, rows in plans.items() for r in rows], "g long, seq long, tier int, cls string")
    for k in (1, 5, 10):
        got = {}
        for r in ranking.spanning_topk(df, "g", k).collect():
            got.setdefault(r.g, {})[r.pick] = r.seq
        assert {g: [p[i] for i in sorted(p)] for g, p in got.items()} == {g: draws(rows, k) for g, rows in plans.items()}


def test_packed_texts_survive(spark):
    texts = ["plain", "", "a\u001eb", "\u001b", "\u001bs\u001e\u001be", "line\r\nline\n", "ü\u001b\u001b\u001e" * 100]
    folder = fresh_path(spark, "packed")
    tables.write_documents(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").coalesce(1), folder)
    back = tables.read_documents(spark, folder, tables.SEPARATOR)
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    stream = tables.stream_documents(spark, folder).select("text")
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == sorted(texts)
