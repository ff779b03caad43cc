"""Operator 6: token ids as ORC files.

Documents are dealt by ranges of doc_id, so that files and rows in them ascend by it, and each file's ids are a list
column under ORC's run-length encoding of integers, in stripes with row indexes (statistics of doc_id) and Bloom filters
on doc_id. Readers take stripes in parallel and skip those whose metadata rule an id out. Each row has its number in its
file, so that the order of the files is the order of the index, also where an id stands in several rows.

Null texts count as empty: they have the end id only. Rows of equal doc_id stand side by side in an order by their text's
hash; null ids come first. An id that many rows share is dealt to several files. Other columns are not read, doc_id may have any type
that has an order; an empty table gives no rows. A text's ids are held by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import gathered
from .common import materialize, shared_dir, small_batches, table, until_the_end
from .tokens import memo, vocabulary

END = 1
#: Bytes of a stripe and rows of a row group in the index; bytes of text that go to one file.
STRIPE, GROUP, FILE = 8 << 20, 10_000, 32 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, stripe: int = STRIPE, group: int = GROUP) -> None:
    """ORC files at path: file_no, row (its number in the file), doc_id, ids (array<int>), ascending by doc_id over files and
    within each."""
    spark = docs.sparkSession
    small_batches(spark)
    names = ["file_no", "row", "doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            done = 0
            for ((data, at),) in gathered(b.column("text"), memo(tokenizer)):
                n, ids = len(at) - 1, data.view("<i4")
                ends = at[1:] // 4  # where each text's end id comes in
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, n + 1)).astype(np.int32)), pa.array(np.insert(ids, ends, end)))
                yield pa.RecordBatch.from_arrays([b.column("file_no").slice(done, n), pa.array(np.arange(row, row + n)), b.column("doc_id").slice(done, n), lists], names)
                done, row = done + n, row + n

    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    n = max(1, size // FILE, spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order).withColumn("file_no", F.spark_partition_id()).sortWithinPartitions(*order)
    tokens = dealt.mapInArrow(run, f"file_no int, row long, doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.stripe.size": stripe, "orc.row.index.stride": group}
    tokens.write.options(compression="zstd", **options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_type: str = "long") -> DataFrame:
    return spark.read.schema(f"file_no int, row long, doc_id {doc_type}, ids array<int>").orc(path)


def read_document(spark: SparkSession, path: str, doc_id: object, doc_type: str = "long") -> DataFrame:
    """One document's ids; row groups and stripes that cannot hold it are skipped by statistics and Bloom filters."""
    return read_tokens(spark, path, doc_type).where(F.col("doc_id") == F.lit(doc_id))


def token_index(spark: SparkSession, path: str, doc_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files, which are read once."""
    names = ["file_no", "row", "doc_id", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = (4 * at).tolist()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_no"), b.column("row"), b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names)

    small_batches(spark)
    rows = materialize(read_tokens(spark, path, doc_type).mapInArrow(run, f"file_no int, row long, doc_id {doc_type}, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    # one small row for each file: the only rows that meet in one task
    before = files.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("before"))
    within = Window.partitionBy("file_no").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.sum("n_tokens").over(within))
    return ranked.join(F.broadcast(before), "file_no").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    until_the_end(spark, path)
    return token_index(spark, path)
