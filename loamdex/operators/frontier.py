"""The frontier of a breadth-first crawl: new URLs, their origins, levels and the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..sources.shared import materialize, numbered, shared_dir
from .robots import decided, ruled


def fresh(found: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs (with the least seq of each) that were not visited."""
    return found.groupBy("url").agg(F.min("seq").alias("seq")).join(visited.select("url"), "url", "left_anti")


def with_origins(found: DataFrame) -> DataFrame:
    """Each URL, then its origin: url, seq, part (0 the URL, 1 its origin)."""
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("url").alias("url")), F.struct(F.lit(1).alias("part"), origin(F.col("url")).alias("url")))
    return found.select("seq", F.explode(both).alias("x")).select("x.url", "seq", "x.part")


def _written(df: DataFrame, paths: list[str]) -> DataFrame:
    """df written and read again; its path is added to paths."""
    paths.append(shared_dir(df.sparkSession))
    return materialize(df, paths[-1])


def crawl(seeds: DataFrame, links: DataFrame, robots: DataFrame, budget: int = 0) -> DataFrame:
    """url, place, depth, fetched of a crawl over known pages, in order of arrival; seeds: url; links: src, pos, url (canonical,
    of pages that can be fetched); robots: origin, http_code, body.

    A level of the queue at a time: its URLs are checked against robots, the links of those that may be fetched follow, each
    before its origin, and what is new of them is the next level. It ends when nothing is new or, for a positive budget,
    after budget + 1 URLs; URLs that robots forbid count too, but are not fetched. A level is written, and numbered by ranges;
    links and robots are written once, as every level reads them."""
    spark, paths = seeds.sparkSession, []
    links, rules = materialize(links.select("src", "pos", "url")), ruled(materialize(robots))
    rows = with_origins(seeds.select("url", F.lit(0).cast("bigint").alias("seq")))
    level, n, depth = rows.groupBy("url").agg(F.min(F.struct("seq", "part")).alias("at")), 0, 0
    while True:
        if budget > 0:
            level = level.orderBy("at", "url").limit(budget + 1 - n)
        placed = numbered(level, "place", "at", "url").withColumn("place", F.col("place") + n).withColumn("depth", F.lit(depth))
        level = _written(decided(placed, rules).select("url", "place", "depth", F.col("allowed").alias("fetched")), paths)
        new = level.count()
        n, depth = n + new, depth + 1
        if new == 0 or (budget > 0 and n > budget):
            break
        seen = spark.read.schema(level.schema).parquet(*paths)
        out = level.where("fetched").join(links, level["url"] == links["src"]).select(links["url"], F.struct("place", "pos").alias("seq"))
        level = with_origins(out).groupBy("url").agg(F.min(F.struct("seq", "part")).alias("at")).join(seen.select("url"), "url", "left_anti")
    return spark.read.schema(level.schema).parquet(*paths)


def breadth_first(seeds: DataFrame, edges: DataFrame, levels: int | None = None, most: int | None = None) -> DataFrame:
    """id, depth of all that is reached from seeds (id) over edges (src, dst): until nothing new is found, or in so many
    levels, or until whole levels hold `most` ids. A written table each level, all read by one scan, so that the plan stays
    short and a lost executor costs no more than a level."""
    spark = seeds.sparkSession
    paths: list[str] = []
    front = _written(seeds.select("id", F.lit(0).alias("depth")).distinct(), paths)
    seen, depth, n = front, 0, front.count()
    while (levels is None or depth < levels) and (most is None or n < most):
        depth += 1
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").cast(seeds.schema["id"].dataType).alias("id")).distinct()
        front = _written(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), paths)
        new = front.count()
        if new == 0:
            break
        n += new
        seen = spark.read.schema(front.schema).parquet(*paths)
    return seen


def within_budget(ordered: DataFrame, budget: int, *by: str) -> DataFrame:
    """The first budget + 1 rows; all of them for a budget of 0 or less."""
    return ordered.orderBy(*by).limit(budget + 1) if budget > 0 else ordered
