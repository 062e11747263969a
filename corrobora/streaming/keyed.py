"""A table kept by key under micro-batches: copy-on-write buckets behind a log of committed batches.

Rows lie in a fixed number of buckets by the hash of their key. A batch rewrites the buckets it touches, each as a new
version below ``data/batch=n/bucket=b``, and then commits by writing which buckets it replaced to ``log/batch=n``. Readers
take, for each bucket, the version of the newest committed batch. A batch that is retried starts from the versions before
it and writes the same again, so it changes nothing; a batch that failed before its commit is never seen. Versions that
two newer batches have replaced are deleted, so history does not grow.

Only the list of buckets, whose number is a setting, ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` and ``key`` of the rows, the ``folder`` they are kept in, and the number of buckets."""

    spark: SparkSession
    folder: str
    schema: str
    key: str
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self, before: int | None = None) -> dict[int, int]:
        """For each bucket the newest committed batch that wrote it, of those ``before`` a batch if one is given."""
        if not self._exists(f"{self.folder}/log"):
            return {}
        log = self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/log")
        if before is not None:
            log = log.where(F.col("batch") < before)
        return {r.bucket: r.batch for r in log.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [p for b, n in versions.items() if self._exists(p := f"{self.folder}/data/batch={n}/bucket={b}")]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows as of the newest commit."""
        return self._read(self.versions())

    def apply(self, number: int, rows: DataFrame, merge: Merge, order: str | None = None) -> None:
        """Merge ``rows`` into the table as batch ``number``; of several rows of a key the last by ``order`` counts.

        ``merge(old, new)`` gets the rows of the touched buckets and returns what they become. Rows without a key are
        left out.
        """
        new = rows.where(F.col(self.key).isNotNull())
        if order is not None:
            row = F.struct(*new.columns)
            new = new.groupBy(self.key).agg(F.max_by(row, F.struct(order, row)).alias("_r")).select("_r.*").drop(order)
        new = new.persist()
        try:
            touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]
            now = self.versions(before=number)
            old = self._read({b: now[b] for b in touched if b in now})
            merged = merge(old, new).withColumn("bucket", self._bucket())
            # One writing task a bucket and batch, so a bucket is few files.
            out = merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
            out.parquet(f"{self.folder}/data/batch={number}")
            committed = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
            committed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")
        finally:
            new.unpersist()
        self._vacuum(number, set(touched))

    def _vacuum(self, number: int, touched: set[int]) -> None:
        """Delete the versions of ``touched`` buckets that batch ``number`` and another one before it have replaced."""
        log = self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/log").where(F.col("batch") <= number)
        by_bucket = log.where(F.col("bucket").isin(*touched) if touched else F.lit(False)).groupBy("bucket").agg(
            F.array_sort(F.collect_set("batch")).alias("batches"))
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for r in by_bucket.collect():
            for old in r.batches[:-2]:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/batch={old}/bucket={r.bucket}")
                path.getFileSystem(conf).delete(path, True)


def stream_upsert(stream: DataFrame, table: KeyedTable, merge: Merge, checkpoint: str, order: str | None = None, first: int = 0) -> None:
    """Drive a stream over everything available into ``table``, a micro-batch a commit; ``first`` numbers the first batch."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: table.apply(first + n, batch, merge, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
