"""A table kept by key under micro-batches, and streams whose state ends."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import maintenance as M
from corrobora.session import fresh_path
from corrobora.streaming import keyed, rolling

ROWS = "id long, amount double, status string, seq long"


def merge(old, new):
    return M.upsert_cases(old, new, "id", ["amount"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark):
    return keyed.KeyedTable(spark, fresh_path(spark, "register"), "id long, amount double, status string", "id", 8)


def batches(spark):
    rnd = random.Random(3)
    out = []
    for b in range(5):
        some = [(rnd.randint(0, 60), float(rnd.randint(1, 99)) if rnd.random() < 0.8 else None, f"s{b}", b * 1000 + i) for i in range(50)]
        out.append(spark.createDataFrame([*some, (None, 1.0, "lost", 0)], ROWS))
    return out


def plain(parts):
    """The batch form: each batch's last row of a key upserted into all before."""
    state = {}
    for part in parts:
        last = {}
        for r in sorted(part.collect(), key=lambda r: r.seq):
            if r.id is not None:
                last[r.id] = r
        for k, r in last.items():
            old = state.get(k)
            state[k] = (k, r.amount, r.status) if old is None else (k, old[1] if r.amount is None else r.amount, old[2])
    return sorted(state.values())


def test_batches_and_retries(spark, table):
    parts = batches(spark)
    for n, part in enumerate(parts):
        table.apply(n, part, merge, "seq")
        assert rows(table.read()) == plain(parts[: n + 1])
    table.apply(4, parts[4], merge, "seq")
    assert rows(table.read()) == plain(parts)
    table.apply(5, parts[0].where("false"), merge, "seq")
    assert rows(table.read()) == plain(parts)


def test_history_does_not_grow(spark, table):
    parts = batches(spark)
    for n in range(12):
        table.apply(n, parts[n % 5], merge, "seq")
    folder = f"{table.folder}/data"
    kept = [f"{b}/{v}" for b in os.listdir(folder) if b.startswith("batch=") for v in os.listdir(f"{folder}/{b}") if v.startswith("bucket=")]
    assert len(kept) <= 2 * table.buckets


def test_a_batch_that_failed_before_its_commit_is_not_seen(spark, table):
    parts = batches(spark)
    table.apply(0, parts[0], merge, "seq")

    def broken(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.apply(1, parts[1], broken, "seq")
    assert rows(table.read()) == plain(parts[:1])
    table.apply(1, parts[1], merge, "seq")
    assert rows(table.read()) == plain(parts[:2])


def test_stream_of_three_batches(spark, table):
    source, parts = fresh_path(spark, "stream-input"), batches(spark)[:3]
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):
            if f.startswith("part-") and os.path.getmtime(f"{source}/{f}") > 1_700_000_100:
                os.utime(f"{source}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    keyed.stream_upsert(stream, table, merge, fresh_path(spark, "state"), "seq")
    assert rows(table.read()) == plain(parts)
    assert set(table.versions().values()) <= {0, 1, 2}


def test_rule_of_suppression():
    assert rolling.suppress([0, 10, 29, 30, 45, 60, 61], None, 30) == ([True, False, False, True, False, True, False], 60)
    assert rolling.suppress([5, 40], 60, 30) == ([True, False], 60)


EVENTS = "user long, kind string, id long, status string, ts timestamp"


def event_files(spark, files):
    """Files of events, read one a batch in this order."""
    source = fresh_path(spark, "events")
    for n, f in enumerate(files):
        made = spark.createDataFrame([(u, k, i, s, 86_400_000 + m * 60) for u, k, i, s, m in f], "user long, kind string, id long, status string, at long")
        made.select("user", "kind", "id", "status", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(f"{source}/{n}")
        for name in os.listdir(f"{source}/{n}"):
            os.utime(f"{source}/{n}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")


def test_rolling_over_batches(spark):
    """Passes carry over batches; an event out of order is held against the last pass; state leaves and a key starts anew."""
    files = [
        [(1, "a", 1, "x", 0), (1, "a", 2, "x", 10), (2, "a", 3, "x", 5)], [(1, "a", 4, "x", 29), (1, "a", 5, "x", 31), (2, "a", 6, "x", 36)],
        [(1, "a", 7, "x", 25), (1, "a", 8, "x", 50)], [(3, "a", 9, "x", 500)], [(1, "a", 10, "x", 501), (1, "a", 11, "x", 502)],
    ]
    got = rolling.stream_rolling(event_files(spark, files), ["user", "kind"], "id")
    assert sorted(r.id for r in got.collect()) == [1, 3, 5, 6, 9, 10]


def test_cases_leave_when_settled(spark):
    files = [
        [(1, "", 1, "queued", 0), (2, "", 2, "queued", 0), (3, "", 3, "queued", 1)], [(1, "", 4, "done", 5), (2, "", 5, "cancel", 6), (3, "", 6, "searching", 7)],
        [(1, "", 7, "searching", 8), (3, "", 8, "cancel", 9)], [(4, "", 9, "queued", 1000)], [(4, "", 10, "parsed", 1001)], [(4, "", 11, "parsed", 1002)],
    ]
    stream = event_files(spark, files).select("user", "ts", F.col("id").alias("seq"), "status")
    got = {r.user: (r.status, r.n_events, r.ended) for r in rolling.stream_settling(stream, "user").collect()}
    assert got == {"1": ("done", 3, True), "2": ("skipped", 2, True), "3": ("searching", 3, True), "4": ("parsed", 3, False)}
