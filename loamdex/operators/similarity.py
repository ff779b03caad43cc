"""Embedding of texts by a pluggable model, and similarity to one vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, guess_score
from ..sources.shared import on_workers

PREFIX = "search_query: "
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@cache
def _loaded(load: Callable) -> Callable:
    return load()


def letter_counts() -> Callable[[list[str]], list[list[float]]]:
    """A model without a file: how often a text has each letter. Others are loaded in the same way."""
    return lambda texts: [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text") -> DataFrame:
    """texts with embedding (unit length). load gives a function from texts to vectors, once for each worker process: it must
    be a function of a module, by which the worker knows it."""
    on_workers(texts.sparkSession)
    names = texts.columns

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        model = _loaded(load)
        for frame in batches:
            v = np.asarray(model([PREFIX + (t or "") for t in frame[column]]), np.float32).reshape(len(frame), -1)
            length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            frame = frame[names].copy()
            frame["embedding"] = list((v / np.where(length == 0, np.nan, length)).astype(np.float32))
            yield frame

    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", embedding array<float>"
    return texts.mapInPandas(run, schema)


def to_target(vectors: DataFrame, target: DataFrame) -> DataFrame:
    """vectors with similarity to the one row of target (embedding): a single vector, so its broadcast is bounded."""
    one = F.broadcast(target.select(F.col("embedding").alias("_target")).limit(1))
    return vectors.join(one).withColumn("similarity", cosine(F.col("embedding"), F.col("_target"))).drop("_target")


def guessed(guesses: DataFrame, secret: str, load: Callable) -> DataFrame:
    """guesses (guess) with similarity to the secret, score and whether it is right: the guess endpoint over a table."""
    spark = guesses.sparkSession
    target = embed(spark.createDataFrame([(secret,)], "text string"), load)
    rows = to_target(embed(guesses, load, "guess"), target).drop("embedding")
    own = F.lit(secret)
    return rows.withColumn("score", guess_score(F.col("guess"), own, F.col("similarity"))).withColumn("correct", F.col("guess") == own)


def pair_similarity(pairs: DataFrame, load: Callable) -> DataFrame:
    """pairs (left_text, right_text) with the similarity of both texts."""
    one = embed(pairs, load, "left_text").withColumnRenamed("embedding", "left_vector")
    both = embed(one, load, "right_text")
    return both.withColumn("similarity", cosine(F.col("left_vector").cast("array<double>"), F.col("embedding").cast("array<double>"))).drop("left_vector", "embedding")
