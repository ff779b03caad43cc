"""The folder that driver and executors share, tables written to it, and row numbers over any number of tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir. Where that is unset, one process that is driver and executors at once
    (as in tests) uses a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loamdex-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loamdex-{uuid.uuid4().hex}"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package, where they share its folder with the driver or have it elsewhere."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def until_the_end(spark: SparkSession, path: str) -> None:
    """A written folder is deleted when the application ends: results may be read from it until then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    until_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a number from 1 in the given order: sorted by ranges and numbered in each, so that only one row for each range,
    with its count, meets in one task. The ranges are written, so that they stay the same."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
    held = materialize(held)
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")
