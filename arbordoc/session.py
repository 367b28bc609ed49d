"""Session helper and table loader."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "arbordoc") -> SparkSession:
    """A session with the settings that the engine expects (UTC, AQE, pushdown into Python data sources).

    On a cluster, pass an existing session to the functions of this package instead; they read their settings from it.
    """
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written into the session's checkpoint folder: later plans read it from there, lost executors don't matter, and retries see the same rows.

    The folder is spark.checkpoint.dir. Where none is set, a local master gets a temporary one; on a cluster that is an error, since executors would not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="arbordoc-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by a path that Spark's own reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, mb: int = 4) -> DataFrame:
    """df dealt out by keys over the session's shuffle partitions, or over more: one for each mb megabytes that Spark expects of it. So a task's rows don't grow with the table, and the
    slow steps after it use all cores even where a file has few row groups. An aggregation by the same keys needs no further shuffle."""
    spark = df.sparkSession
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, expected // (mb << 20) + 1)
    return df.repartition(n, *keys)
