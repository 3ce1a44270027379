"""Session helpers: a local session for tests and benches, and lineage cutting that survives lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "lastro", memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are tested under; a running session is reused."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one, or LASTRO_SHARED; a folder of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.environ.get("LASTRO_SHARED")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lastro-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, read back from a parquet table in the shared folder: lineage ends there, and the loss of an executor costs nothing.

    The table is deleted when the driver ends; loops delete what they have superseded with ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._lastro_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a ``written`` table that nothing will read again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._lastro_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
