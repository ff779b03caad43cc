"""Samples hold the lowest hashes of different rows, whatever is repeated; a fit in a task gives what it gives here."""

import pytest
from pyspark.sql import functions as F

from loamdex.llm.common import fitted, sample_rows


@pytest.mark.parametrize("copies,others,most", [(0, 300, 40), (5000, 300, 40), (5000, 10, 40), (3, 0, 5), (0, 0, 5)])
def test_samples_are_the_lowest_different_hashes(spark, copies, others, most):
    rows = [(i, f"t{i}") for i in range(others)] + [(10**6, "hot")] * copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = df.distinct().withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("sample"))).orderBy("h").limit(most)
    assert sorted(r.doc_id for r in sample_rows(df, most, "doc_id", "text").collect()) == sorted(r.doc_id for r in hashed.collect())


def test_all_lowest_hashes_may_be_one_row(spark):
    """Where copies of the rows of lowest hash fill what tasks hand on, the others still come in."""
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    first = df.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))).limit(2)
    hot = first.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).select("doc_id").union(df)
    assert sample_rows(hot, 10, "doc_id").count() == sample_rows(df, 10, "doc_id").count() == 10


def test_fit_in_a_task(spark):
    fit = lambda t: sorted(t["id"].to_pylist())
    assert fitted(spark.range(20).repartition(3), fit) == list(range(20)) and fitted(spark.range(0), fit) == []
