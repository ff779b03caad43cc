"""Every query with SQL gives DuckDB's rows at the smallest size; unit cases of URLs, robots and search patterns."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loamdex.functions import urls as U
from loamdex.operators import robots, site_index
from loamdex.plans import queries as plans

DIR = "/root/testdata/sf0.001"


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = plans.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    ours = sorted([tuple(_plain(r[c]) for c in names) for r in df.collect()], key=str)
    out = db.execute(plans.SQL[name])
    theirs = [d[0] for d in out.description]
    assert sorted(theirs) == names
    assert ours == sorted([tuple(_plain(dict(zip(theirs, r, strict=True))[c]) for c in names) for r in out.fetchall()], key=str)


def test_canonical_urls(spark):
    want = {
        "https://google.com": "https://www.google.com/", "https://blog.example.com/": "https://blog.example.com/", "HTTPS://Example.COM/A/B.html?x=1#y": "https://www.example.com/a/b.html/",
        "https://asd.www.ck/x": "https://asd.www.ck/x/", "https://www.ck/": "https://www.www.ck/", "https://x.foo.ck/": "https://www.x.foo.ck/", "https://foo.ck/": "https://foo.ck/",
        "https://github.io/": "https://github.io/", "https://localhost/": None, "https://1.2.3.4/": None,
    }
    df = spark.createDataFrame(list(want.items()), "url string, want string").withColumn("got", U.normalize(F.col("url"), plans.PSL_ALL))
    assert all(r.got == r.want for r in df.collect())


def test_robots_rules(spark):
    r = spark.createDataFrame([(plans.BODIES[0],)], "body string").select(robots.parsed(F.col("body")).alias("p")).first().p
    assert [tuple(x) for x in r.rules] == [("/a/", False), ("/en/*/", True), ("10", False)]
    assert r.sitemaps == ["https://x.example.com/s.xml"]


def test_search_patterns():
    assert site_index.pattern("a\\b") == "%ab%"
    assert site_index.pattern("100%", literal=True) == "%100\\%%"
    assert site_index.pattern("h_llo") == "%h_llo%"


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([("u", "old", 1), ("v", "x", 2)], "url string, title string, seq long")
    b = spark.createDataFrame([("u", "new", 1)], "url string, title string, seq long")
    once = site_index.upserted(a, b)
    assert sorted((r.url, r.title) for r in site_index.upserted(once, b).collect()) == [("u", "new"), ("v", "x")]
