"""Streams of several micro-batches: what they store equals the batch result, and a retried batch replaces itself."""

import os

import pytest
from harness import SMALL
from pyspark.sql import functions as F

from corrobora.schema import TABLES
from corrobora.session import fresh_path
from corrobora.sources.tables import load
from corrobora.streaming import jobs as J


@pytest.fixture(scope="module")
def folder(spark):
    """Events in six files, in order of time, and documents in four."""
    out = fresh_path(spark, "stream-input")
    for name, parts, order in (("events", 6, "ts"), ("documents", 4, "doc_id")):
        load(spark, SMALL, name).repartitionByRange(parts, order).write.parquet(f"{out}/{name}.parquet")
        # Files are read in the order of their times.
        for n, f in enumerate(sorted(f for f in os.listdir(f"{out}/{name}.parquet") if f.startswith("part-"))):
            os.utime(f"{out}/{name}.parquet/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    return out


def stream(spark, folder, name):
    return J.read_stream(spark, folder, name, files_per_batch=1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ingest_equals_batch(spark, folder):
    got = J.stream_ingest(stream(spark, folder, "documents"))
    assert rows(got) == rows(J.ingest(load(spark, SMALL, "documents")).select(got.columns))


def test_match_equals_batch(spark, folder):
    from corrobora.operators.joins import match_terms
    from corrobora.plans.q_joins import doc_terms, item_terms

    got = J.stream_match(stream(spark, folder, "documents"), item_terms(spark, SMALL), 4)
    assert got.select("batch").distinct().count() > 1
    assert rows(got.drop("batch")) == rows(match_terms(item_terms(spark, SMALL), doc_terms(spark, SMALL), 4))


def test_summary_and_status_equal_batch(spark, folder):
    events = lambda df: df.withColumn("status", F.col("event_type"))
    got = J.stream_summary(events(stream(spark, folder, "events")), "status").drop("batch")
    want = events(load(spark, SMALL, "events")).groupBy("status").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    assert rows(got) == rows(want.select(got.columns))

    def cases(df):
        done = F.when(F.col("event_type") == "purchase", "done").otherwise("searching")
        return df.select("user_id", "ts", F.col("event_id").alias("seq"), done.alias("status"))

    many = J.stream_status(cases(stream(spark, folder, "events")), "user_id")
    one = J.stream_status(cases(J.read_stream(spark, SMALL, "events")), "user_id")
    assert rows(many) == rows(one) and many.count() == many.select("user_id").distinct().count()


def test_windows_equal_batch_when_events_come_in_order(spark, folder):
    keys = ["user_id", "event_type"]
    assert rows(J.stream_dedupe(stream(spark, folder, "events"), keys)) == rows(J.stream_dedupe(J.read_stream(spark, SMALL, "events"), keys))

    def calls(df):
        return df.select(
            "ts", F.col("event_type").alias("source"), (F.col("value") > 30).alias("ok"), F.col("props").alias("error"),
            F.col("event_id").alias("seq"), F.col("value").alias("elapsed_ms"),
        )

    many, one = (J.stream_outcomes(calls(s)) for s in (stream(spark, folder, "events"), J.read_stream(spark, SMALL, "events")))
    assert rows(many) == rows(one)


def events_folder(spark, batches):
    """One file per batch of (event_id, ts), read in this order."""
    out = fresh_path(spark, "stream-input")
    os.makedirs(f"{out}/events.parquet")
    for n, batch in enumerate(batches):
        part = fresh_path(spark, "part")
        given = spark.createDataFrame(batch, "event_id long, ts string")
        known = {"event_id": F.col("event_id"), "ts": F.to_timestamp("ts"), "event_type": F.lit("click")}
        fields = spark.createDataFrame([], TABLES["events"]).schema
        made = given.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        made.coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{file}", f"{out}/events.parquet/{n}.parquet")
        os.utime(f"{out}/events.parquet/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return out


def test_events_behind_the_watermark_are_dropped(spark):
    """A slot closed for over an hour takes no more events; one within the hour does."""
    day = "2024-01-01"
    folder = events_folder(spark, [
        [(1, f"{day} 00:05:00")], [(2, f"{day} 05:00:00")], [(3, f"{day} 04:20:00")], [(4, f"{day} 00:06:00"), (5, f"{day} 04:21:00")],
    ])
    got = {str(r.slot)[11:16]: (r.event_id, r.n_events) for r in J.stream_dedupe(stream(spark, folder, "events"), ["event_type"]).collect()}
    assert got == {"00:00": (1, 1), "05:00": (2, 1), "04:00": (3, 2)}


def test_first_seen_within_the_watermark(spark):
    """The rolling form passes the first event of a key and drops a repeat within the delay."""
    day = "2024-01-01"
    folder = events_folder(spark, [[(1, f"{day} 00:05:00")], [(2, f"{day} 00:20:00")]])
    seen = J.run_available(J.stream_first_seen(stream(spark, folder, "events"), ["event_type"]))
    assert [r.event_id for r in seen.collect()] == [1]


def test_a_retried_batch_replaces_itself(spark):
    """The sink gets batch 0 twice, as after a failure between its write and its commit."""
    out = fresh_path(spark, "sink")
    sink = []

    class Writer:
        def foreachBatch(self, f):
            sink.append(f)
            return self

    class Stream:
        writeStream = Writer()

    J.write_batches(Stream(), out)
    for _ in range(2):
        sink[0](spark.range(5), 0)
    sink[0](spark.range(5, 7), 1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 6]
