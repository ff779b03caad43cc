"""Breadth-first search without a bound on levels."""

from loamdex.operators import frontier
from loamdex.plans import queries as plans

DIR = "/root/testdata/sf0.001"


def test_breadth_first_ends_where_nothing_is_new(spark):
    """A chain of 12 with a way back: no level bound, a level bound, and whole levels until enough ids are there."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0), (1, 20), (50, 51)], "src long, dst long")
    found = lambda **k: sorted((r.depth, r.id) for r in frontier.breadth_first(spark.range(1), edges, **k).collect())
    whole = sorted([(i, i) for i in range(13)] + [(2, 20)])
    assert found() == whole
    assert found(levels=3) == whole[:5]
    assert found(most=3) == whole[:4]


def test_crawl_goes_beyond_six_levels(spark):
    assert plans.crawl_bfs_all(spark, DIR).selectExpr("count(*)", "max(depth)").first() == (160, 12)
