"""Arrival-driven runs of the batch operators.

Sources are file streams. Sinks write each micro-batch to its own folder with
overwrite, so a batch that is retried after a failure replaces its own output:
results are exactly once without any driver-side state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corrobora import constants as K
from corrobora.functions.text import tokenize
from corrobora.schema import TABLES
from corrobora.session import broadcast_checked, fresh_path


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, with its declared schema."""
    reader = spark.readStream.schema(TABLES[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A glob serves both layouts: one file, or a folder of part files.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def write_batches(df: DataFrame, out: str, transform=None) -> DataStreamWriter:
    """A writer that stores micro-batch ``n`` under ``out/batch=n``, after ``transform``."""

    def store(batch: DataFrame, number: int) -> None:
        result = transform(batch) if transform else batch
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return df.writeStream.foreachBatch(store)


def run_available(
    df: DataFrame, mode: str = "append", transform=None, latest_only: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Drive a stream over everything available now and return its stored output.

    ``latest_only`` reads the last batch alone, for complete-mode results. With
    ``keys`` the last row stored for each key stands, for update-mode results: a
    batch then writes the rows that it changed, and nothing is written again.
    """
    spark = df.sparkSession
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    query = (
        write_batches(df, out, transform).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    result = spark.read.parquet(out)
    if latest_only:
        last = result.agg(F.max("batch").alias("batch"))
        result = result.join(broadcast_checked(last), "batch", "left_semi")
    if keys:
        rest = [c for c in df.columns if c not in keys]
        result = result.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return result


def ingest(batch: DataFrame) -> DataFrame:
    """Per document: token count and distinct tokens, ready to match."""
    toks = tokenize(F.col("text"))
    return batch.select("doc_id", "lang", "source", F.size(toks).alias("n_tokens"), F.array_distinct(toks).alias("terms"))


def stream_ingest(stream: DataFrame) -> DataFrame:
    """Parse documents as they arrive; a document that arrives again replaces itself on read."""
    stored = run_available(stream, transform=ingest)
    return stored.groupBy("doc_id").agg(F.max_by(F.struct("lang", "source", "n_tokens", "terms"), "batch").alias("_r")).select(
        "doc_id", "_r.*"
    )


def stream_match(stream: DataFrame, terms: DataFrame, need: int) -> DataFrame:
    """Arriving articles matched to static claim terms, per micro-batch.

    An article arrives whole, so its hits are final within its batch and no
    state is kept between batches.
    """
    from corrobora.operators.joins import match_terms

    def match(batch: DataFrame) -> DataFrame:
        arrived = ingest(batch).select(F.col("doc_id").alias("article_id"), F.explode("terms").alias("term"))
        return match_terms(terms, arrived, need)

    return run_available(stream, transform=match)


def stream_top(stream: DataFrame, terms: DataFrame, need: int, k: int) -> DataFrame:
    """The ``k`` best matches of each claim among all articles that arrived, with their rank.

    A batch stores its own best ``k`` of a claim, so what is kept grows with claims and batches, not with articles.
    """
    from corrobora.operators.joins import match_terms
    from corrobora.operators.ranking import top_k

    order = [F.col("hits").desc(), F.col("article_id").asc()]

    def match(batch: DataFrame) -> DataFrame:
        arrived = ingest(batch).select(F.col("doc_id").alias("article_id"), F.explode("terms").alias("term"))
        return top_k(match_terms(terms, arrived, need), ["claim_id"], order, k).drop("rank")

    stored = run_available(stream, transform=match).groupBy("claim_id", "article_id").agg(F.max_by("hits", "batch").alias("hits"))
    return top_k(stored, ["claim_id"], order, k)


def stream_summary(stream: DataFrame, by: str) -> DataFrame:
    """Running count per status; complete mode, so the last batch holds the totals."""
    counts = stream.groupBy(by).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return run_available(counts, "complete", latest_only=True)


def stream_dedupe(stream: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """The first event per key and ``minutes``-long slot; repeats inside a slot are dropped.

    Slots make the outcome independent of batch boundaries, and the minimum is
    combined before the shuffle, so a key with most of the rows is one small
    group. Update mode: a batch writes the slots it touched, and slots that lie an
    hour behind the latest event leave the state; what arrives for them later is
    dropped.
    """
    slot = F.window("ts", f"{minutes} minutes")
    first = (
        stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
        .groupBy(slot.alias("w"), *keys)
        .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events"))
    )
    slots = first.select(F.col("w.start").alias("slot"), *keys, "event_id", "n_events")
    return run_available(slots, "update", keys=["slot", *keys])


def stream_first_seen(stream: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """Rolling variant: Spark's own de-duplication within the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{minutes} minutes")
    return timed.dropDuplicatesWithinWatermark(keys)


def stream_outcomes(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Source availability per time window: used when any call in it answered.

    Update mode; windows that lie ``late`` behind the latest call leave the state.
    """
    used = F.bool_or("ok")
    per = (
        stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "source")
        .agg(
            used.alias("used"), F.count("*").alias("n_calls"), F.max("elapsed_ms").alias("elapsed_ms"),
            F.min_by("error", F.struct("ts", "seq")).alias("_error"),
        )
    )
    flat = per.select(
        F.col("w.start").alias("window_start"), "source", "used", "n_calls", "elapsed_ms",
        F.when(~F.col("used"), F.col("_error")).alias("reason"),
    )
    return run_available(flat, "update", keys=["window_start", "source"])


def stream_status(stream: DataFrame, case: str) -> DataFrame:
    """Final status per case from its event stream.

    State is the time each status was first reached: a fixed number of values per
    case, whatever the order of arrival. A case keeps the first settled status;
    a cancel skips a case that stood at queued or parsed (or nowhere yet);
    otherwise the latest status stands.
    """
    at = F.struct("ts", "seq")
    per = stream.groupBy(case).agg(
        *[F.min(F.when(F.col("status") == s, at)).alias(f"_{s}") for s in [*K.CASE_STATUS, "cancel"]],
        F.count("*").alias("n_events"),
    )
    reached = lambda names: F.filter(
        F.array(*[F.struct(F.col(f"_{s}").alias("at"), F.lit(s).alias("status")) for s in names]),
        lambda r: r["at"].isNotNull(),
    )
    settled = F.array_min(reached(K.SETTLED_STATUS))
    before = F.array_max(F.filter(reached(K.CASE_STATUS), lambda r: r["at"] < F.col("_cancel")))
    last = F.array_max(reached(K.CASE_STATUS))
    waiting = F.coalesce(before["status"], F.lit("queued")).isin("queued", "parsed")
    status = (
        F.when(F.col("_cancel").isNotNull() & waiting, F.lit("skipped"))
        .otherwise(F.coalesce(settled["status"], last["status"], F.lit("queued")))
    )
    # Update mode: a batch writes the cases it touched.
    return run_available(per.select(case, status.alias("status"), "n_events"), "update", keys=[case])
