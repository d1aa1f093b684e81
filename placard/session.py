"""Session and table helpers shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "placard") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parents[1]))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, ``spark.checkpoint.dir``; it goes when the
    application ends. Local sessions that name none have a temporary one; on a cluster there must be one."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _scratch[app] = f"{base.rstrip('/')}/placard-{app}-{uuid.uuid4().hex[:8]}"
        folder, files = _hadoop(spark, _scratch[app])
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return _scratch[app]


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def clear_written(spark: SparkSession) -> None:
    """Removes all that ``written`` has made so far; tables that read it can't be used any more."""
    path = _scratch.pop(spark.sparkContext.applicationId, None)
    if path:
        folder, files = _hadoop(spark, path)
        files.delete(folder, True)


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors. ``codec``: how it is compressed,
    if not as the session says."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 250_000) -> DataFrame:
    """``df``, a written or stored table, as the side of a join: sent to every task up to ``most`` rows, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows: whole texts go to Python workers, so the usual 10,000 would take much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
