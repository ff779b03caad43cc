"""A stream of crawled pages kept as a table with one row for each URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.site_index import extracted, upserted


def keep_index(pages: DataFrame, table_path: str, checkpoint: str, rules: list[tuple[str, bool, bool]], once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch of pages (page_id, url, html). Versions are folders named by the batch, so that a batch that
    is run again writes the same folder, and readers take the last whole one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{table_path}/v{number - 1}") if number else None
        upserted(old, extracted(batch, rules)).write.mode("overwrite").parquet(f"{table_path}/v{number}")

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
