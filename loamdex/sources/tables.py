"""Reading: pages, suffix lists, mirrored files, and template text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def suffix_rules(lines: DataFrame) -> DataFrame:
    """suffix, wildcard, exception from (line_no, line) of a public suffix list; the first line of a suffix counts."""
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("//"))
    wild, no = F.col("line").startswith("*"), F.col("line").startswith("!")
    suffix = F.when(wild, F.expr("substr(line, 3)")).when(no, F.expr("substr(line, 2)")).otherwise(F.col("line"))
    rules = kept.select("line_no", suffix.alias("suffix"), wild.alias("wildcard"), no.alias("exception"))
    return rules.groupBy("suffix").agg(F.min_by(F.struct("wildcard", "exception"), "line_no").alias("r")).select("suffix", "r.wildcard", "r.exception")


def suffix_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text file read whole, so that the order is that of the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def binary_mirror(spark: SparkSession, path: str) -> DataFrame:
    """url_hash (file name) and content of files fetched before."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("url_hash"), "content")


def mirrored(urls: DataFrame, mirror: DataFrame, url: str = "url") -> DataFrame:
    """urls with url_hash (empty where the mirror has no file, or an empty one) and content: what a download gives."""
    ok = mirror.where(F.length("content") > 0).select(F.col("url_hash").alias("_hash"), "content")
    out = urls.withColumn("_name", F.sha2(F.col(url), 256)).join(ok, F.col("_name") == F.col("_hash"), "left")
    return out.withColumn("url_hash", F.when(F.col("content").isNotNull(), F.col("_name")).otherwise("")).drop("_name", "_hash")


def store_files(files: DataFrame, path: str) -> None:
    """(url_hash, content) as a table, one row for each file: on a cluster many small files would cost more than their bytes.
    Rows of equal names are one file."""
    files.dropDuplicates(["url_hash"]).write.mode("overwrite").parquet(path)
