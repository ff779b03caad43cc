"""What the operators of this subpackage share: reading tables, the shared folder, bounded samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, on_workers, shared_dir, until_the_end  # noqa: F401  what operators here use

#: Rows that one Arrow batch may hold: long texts keep a Python worker's memory small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and, where this Spark knows the setting, by bytes; lets workers import this package."""
    on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def split_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def sample_rows(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most so many rows of different `by`, those whose hash of it is lowest: deterministic for given rows, whatever is
    repeated and however often. Hashes are looked at below a bound that about 8 * most rows fall under, so that tasks and driver
    hold few of them; where repeats leave too few different ones there, the bound is raised."""
    keyed = rows.withColumn("sample_hash", F.xxhash64(*(F.col(c).cast("string") for c in by), F.lit("sample")))
    n, share = keyed.count(), 8 * most
    while True:
        bound = 2**63 - 1 if share >= n else (share << 64) // n - 2**63
        low = keyed.where(F.col("sample_hash") <= F.lit(bound)).select("sample_hash").distinct().orderBy("sample_hash").limit(most).collect()
        if len(low) == most or share >= n:
            break
        share *= 64
    kept = keyed.where(F.col("sample_hash") <= F.lit(low[-1].sample_hash)) if low else keyed.where("false")
    return kept.dropDuplicates(["sample_hash"]).drop("sample_hash")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit gives for rows, which must be a bounded sample: it runs in a task of its own, not in the driver, which gets
    the model alone. A lost executor costs the task, which is run again."""
    small_batches(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)), protocol=5)], pa.binary())], ["model"])

    row = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit(pa.table({n: pa.array([], pa.null()) for n in names}))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text column one after the other, and len + 1 offsets into them; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes together, or a single row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
