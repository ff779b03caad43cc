"""Vectors and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products in the vectors' own type, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """NaN in each place for a zero vector."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda _: F.lit(float("nan")))).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def guess_score(guess: Column, secret: Column, similarity: Column) -> Column:
    """1 for the secret itself; else 1000 times the root of the similarity, 1000 at most; NaN below 0."""
    return F.when(guess == secret, 1.0).when(similarity < 0, F.lit(float("nan"))).otherwise(F.least(F.sqrt(similarity), F.lit(1.0)) * 1000)


def percent(score: Column) -> Column:
    return F.exp(-0.001535 * score)


def color(share: Column) -> Column:
    """rgb(...) from red at 0 to green at 1."""
    mix = lambda a, b: F.floor(a + (b - a) * share + 0.5).cast("string")
    return F.concat(F.lit("rgb("), mix(255, 0), F.lit(", "), mix(0, 255), F.lit(", "), mix(0, 0), F.lit(")"))


def rounded(score: Column) -> Column:
    return F.floor(score + 0.5)


def guess_json(score: Column, correct: Column) -> Column:
    return F.to_json(F.struct(F.format_string("%.6f", score).alias("score"), correct.alias("correct")))


def random_int(low: int, high: int, seed: int) -> Column:
    """A number from low to high, both included, each alike likely."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")
