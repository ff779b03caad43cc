"""A corpus pipeline: language, toxicity, near duplicates, personal data, packing. Counted as part of loamdex.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last keep the columns of documents. Decisions are taken for each row by its own text: rows with a null doc_id, or
with one that other rows have too, stay or go alone. Of rows in one class, equal rows among them, one stays. A null text has
no language, so such rows go at the first stage. An empty table gives an empty one. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import language, order_minhash, packing, pii, toxicity
from loamdex.llm.common import materialize, table
from loamdex.llm.tokens import vocabulary


ROW = "loamdex_row"


def _whole(docs: DataFrame) -> DataFrame:
    """What operators read, with the whole row in place of doc_id: their decision then stands beside the row that it is on,
    whatever its id, and no join brings them together."""
    own = (F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns))
    return docs.select(F.struct(*own).alias("doc_id"), "text")


def _rows(decided: DataFrame, columns: list[str]) -> DataFrame:
    return decided.select(*(F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(columns)))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the field is sure enough of."""
    found = language.classify(_whole(docs), language.train(docs))
    return _rows(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= language.KEEP)), docs.columns)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by the network, which learns from the labels of documents still here."""
    scored = toxicity.score(_whole(docs), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return _rows(scored.where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the least doc_id, a null one last, and of these the first."""
    # a key of each row, written, so that it stays the same: ids may be null, or shared by several rows
    keyed = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))
    of = order_minhash.classes(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "class_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    first = of.join(keyed.select(ROW, "doc_id"), ROW).groupBy("class_id").agg(F.min(place)[ROW].alias(ROW))
    return keyed.join(first.select(ROW), ROW, "left_semi").drop(ROW)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs, pii.fit(docs))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stage_language),
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("pii", stage_pii),
    ("packing", stage_packing),
]

# Trained models and tokenizers: no SQL. tests/llm holds stages against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
