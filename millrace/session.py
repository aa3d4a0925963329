"""Spark sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "millrace", cpus: str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and interactive work on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir``.

    Only a session without that setting gets a temporary folder of its own, and only when it runs on
    this machine alone; a cluster must name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = named.rstrip("/")
    else:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


class ScratchTable:
    """A table written to the shared folder for the length of an operator.

    Unlike a checkpoint it stays columnar, so later reads prune columns and partitions.
    """

    def __init__(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.partitionBy(*partition_by).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
