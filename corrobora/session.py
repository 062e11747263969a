"""Session set-up, lineage cuts and the size check behind every broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is hinted for broadcast only when the optimizer's own estimate of it is
# at or below this many bytes. Anything larger, or of unknown size, is left to
# Catalyst and AQE, which shuffle it.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

# Temporary folders of local-mode sessions, by application.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "corrobora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,parquet,text",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that every executor sees.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session may fall back
    to a temporary folder; on a cluster a machine-local path would be lost with
    its executor, so an unset value is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint storage and return the re-read frame."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the re-read frame, whose size the optimizer then knows."""
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for written intermediate tables."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_checked(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast only if its estimated size is within ``limit``."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` on ``key`` only if its scan has fewer splits than there are cores.

    A small file of one row group is read by one task, which would then run every
    text function alone. An input with enough splits is returned as it is, so
    large tables are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, key)


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose ``key`` stands once, rows of the other keys or None): the first need no shuffle to be grouped by it.

    Only keys are shuffled to tell, and a null counts as a key. ``df`` is read twice.
    """
    again = stored(df.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    if again.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def values_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A literal table from configuration rows, with exact size statistics.

    ``VALUES`` gives Catalyst a local relation, so its size is known and joins
    against it broadcast without a hint. Meant for dictionaries, not data.
    """
    names_types = [part.strip().split(None, 1) for part in ddl.split(",")]

    def literal(value, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, (int, float)):
            return f"CAST({value!r} AS {kind})"
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind})"

    body = ", ".join(
        "(" + ", ".join(literal(v, kind) for v, (_, kind) in zip(row, names_types)) + ")" for row in rows
    )
    names = ", ".join(f"`{name}`" for name, _ in names_types)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
