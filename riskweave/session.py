"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting falls
    back to a temporary folder: there the driver and the executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write *df* to the shared folder and read it back, so that later stages start from files."""
    spark = df.sparkSession
    path = shared_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Stages of one job by name, below one folder of the shared root, of which the job drops what it needs no more.

    The shuffle files of a stage go as soon as it is written. Spark 4.1 does so under a setting that holds
    while it writes; where the setting is not known they stay until the driver collects its garbage.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_dir(spark, "stages")

    def keep(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """*df*, written under *name*, in folders by the values of *by*, and read back."""
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(self.CLEANUP) if before is None else self.spark.conf.set(self.CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete stages; no frame that reads them may run after this."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast *df* when it is shown to have at most *max_rows* rows; otherwise leave the join to Spark.

    The check reads at most one row more than the limit.
    """
    from pyspark.sql.functions import broadcast

    return broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
