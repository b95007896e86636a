"""Session helpers: tuned builder, durable lineage cuts, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "quillstat", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSTAT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the folder must be
    reachable by every executor, so an unset value is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = getattr(shared_dir, "_local", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        shared_dir._local = root
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that the rows survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder (index tables, stream checkpoints)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: for many rows with repeated keys, which a checkpoint writes out in full."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint only when rows and bytes (as JSON) are proven to be within both limits.

    Above a limit the frame is returned unhinted and the join shuffles (with adaptive skew
    splitting), so the result is the same either way.
    """
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if size.n <= max_rows and (size.b or 0) <= max_bytes else df


def bounded_values(df: DataFrame, max_rows: int, max_bytes: int) -> list[str] | None:
    """The distinct values of a one-column frame of strings, or None where they exceed either bound; they are fetched only after they were measured."""
    values = df.select(F.col(df.columns[0]).alias("v")).where("v IS NOT NULL").distinct()
    size = values.agg(F.count("v").alias("n"), F.sum(F.octet_length("v")).alias("b")).first()
    return sorted(r.v for r in values.collect()) if size.n <= max_rows and (size.b or 0) <= max_bytes else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan with fewer splits than cores before CPU-heavy row work.

    Large inputs have more splits than cores and are returned as they are. Frames that already contain a
    shuffle are left alone, since asking for their partitions would run it.
    """
    execution = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in execution.executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
