"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is configured a local master (tests) gets a fresh folder of its own; on a cluster that is an error, for a folder of one machine isn't shared."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: tables between stages need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; it is removed when the driver's JVM ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tables-{sc.applicationId}"
    marked = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = marked.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.mkdirs(marked):
        fs.deleteOnExit(marked)
    return path


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has cut so far; results that still read them are lost."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    A written table survives the loss of executors, is computed exactly once and gives the next
    plan true sizes, so that a broadcast is only chosen for a side whose size is known.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
