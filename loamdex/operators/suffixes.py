"""Public suffixes by an equality join on the suffixes that a host has: for lists too long for an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import cleaned, host, normalized

#: Bytes of rules that are broadcast at most; a longer list is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def with_suffix(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with suffix, wildcard, exception of the longest rule its host ends with (nulls if there is none)."""
    small = (rules.agg(F.sum(F.octet_length("suffix") + 32).alias("n")).first().n or 0) <= BROADCAST_BYTES
    hosts = urls.select(host(F.col(url)).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    tails = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    found = tails.join(F.broadcast(rules) if small else rules, "suffix").groupBy("_host").agg(F.max_by(F.struct("suffix", "wildcard", "exception"), F.length("suffix")).alias("_r"))
    out = urls.withColumn("_host", host(F.col(url))).join(found, "_host", "left")
    return out.select(*urls.columns, "_r.suffix", "_r.wildcard", "_r.exception")


def normalize(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with url_norm, and error where there is none."""
    ready = urls.withColumn("_clean", cleaned(F.col(url)))
    out = with_suffix(ready, rules, "_clean").withColumn("url_norm", normalized(F.col("_clean"), F.col("suffix"), F.col("wildcard"), F.col("exception")))
    return out.withColumn("error", F.when(F.col("url_norm").isNull(), "no public suffix")).drop("_clean", "suffix", "wildcard", "exception")
