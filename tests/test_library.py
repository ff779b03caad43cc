"""Readers, sinks, the stream, embedding and numbering, against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loamdex.functions import html as H
from loamdex.functions import vectors as V
from loamdex.operators import frontier, robots, similarity, site_index
from loamdex.plans import queries as plans
from loamdex.sources import shared, tables
from loamdex.streaming.crawl import keep_index

RULES = [("com", False, False), ("org", False, False)]


def test_suffix_list_from_a_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// head\n\ncom\r\n*.ck\n!www.ck\ncom\n")
    rows = tables.suffix_rules(tables.suffix_lines(spark, str(tmp_path / "list.dat")))
    assert sorted(tuple(r) for r in rows.collect()) == [("ck", True, False), ("com", False, False), ("www.ck", False, True)]


def test_icons_from_a_mirror_and_to_a_table(spark, tmp_path):
    url = "https://a.example.com/favicon.ico"
    name = hashlib.sha256(url.encode()).hexdigest()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / name).write_bytes(b"\x00\x01icon")
    (tmp_path / "m" / hashlib.sha256(b"empty").hexdigest()).write_bytes(b"")
    mirror = tables.binary_mirror(spark, str(tmp_path / "m"))
    rows = tables.mirrored(spark.createDataFrame([(url,), ("empty",), ("none",), (None,)], "url string"), mirror)
    assert {r.url: (r.url_hash, r.content) for r in rows.collect()} == {url: (name, bytearray(b"\x00\x01icon")), "empty": ("", None), "none": ("", None), None: ("", None)}
    tables.store_files(mirror.union(mirror), str(tmp_path / "out"))
    assert [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [bytearray(b"\x00\x01icon")]  # files without bytes are not read


def test_attributes_in_any_quotes(spark):
    page = """<html><head><title>t</title><META NAME=description CONTENT='a "b" c'><link href="/x.png" rel=icon></head>
    <body><a href="/1">a</a><A class='x > y' HREF='/2'>b</A><a href=/3>c</a><a data-href="/no" title="href='/no'">d</a><a href="">e</a><a name=z>f</a><!-- <a href="/no"> --></body></html>"""
    h = F.col("h")
    r = spark.createDataFrame([(page,)], "h string").select(H.description(h).alias("d"), H.favicon(h).alias("f"), H.links(h).alias("l")).first()
    assert (r.d, r.f, r.l) == ('a "b" c', "/x.png", ["/1", "/2", "/3", ""])
    general = spark.createDataFrame([("u", page), ("v", None), ("w", "<meta name=description>")], "url string, html string").mapInPandas(H.parse, "url string, title string, description string, favicon string, links array<string>")
    got = {x.url: x for x in general.collect()}
    assert (got["u"].description, got["u"].favicon, got["u"].links) == ('a "b" c', "/x.png", ["/1", "/2", "/3", ""])
    assert got["v"].description == H.NO_DESCRIPTION and got["w"].description is None


def test_rules_by_lines_equal_the_fold(spark):
    body = "\n".join(["User-agent: *", "", "# c", "Disallow: /a/ # x", "User-agent: Foo", "Disallow: /b/", "User-agent: Bar", "User-agent: *", "Allow: /c/", "nonsense", "Sitemap: s", "User-Agent: *", "Disallow:"])
    rows = spark.createDataFrame([("o", body), ("p", ""), ("q", None)], "origin string, body string")
    fold = rows.where("body is not null").select("origin", F.posexplode(robots.parsed(F.col("body"))["rules"]).alias("pos", "r")).select("origin", "pos", "r.rule", "r.allow")
    assert sorted(map(tuple, robots.parsed_lines(rows).collect())) == sorted(map(tuple, fold.collect()))


def test_gate_and_second_visit(spark):
    rows = [(1, "https://a.com/", "<title>one</title>", 200), (2, "https://a.com/", "<title>two</title>", 404), (3, "https://b.org/x", "<title>b</title>", 200), (4, "none", "", 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, http_code int")
    assert sorted(r.title for r in site_index.upserted(None, site_index.extracted(pages, RULES)).collect()) == ["b", "one"]
    only = site_index.upserted(None, site_index.extracted(pages, RULES, scope="origin")).collect()
    assert [(r.url, r.title, r.last_visited) for r in only] == [("https://www.a.com/", "one", None)]


def test_result_pages(spark):
    found = spark.createDataFrame([(f"https://{i}/", f"t<{i}>", None, "f") for i in range(7)], "url string, title string, description string, favicon string")
    one, two, three = (site_index.result_page(found, k, 5).first() for k in range(3))
    assert one["items"] == two["items"] == three["items"] == 7 and one.html.count("item") == 5 and two.html.count("item") == 2 and three.html == ""
    assert "t&lt;6&gt;" in two.html and 'src="favicons/f"' in two.html and "<p>https://6/</p>" in two.html


def test_crawl_visits_in_order_of_arrival(spark):
    links = [("https://a.com/1/", 0, "https://a.com/2/"), ("https://a.com/1/", 1, "https://b.com/no/x/"), ("https://a.com/2/", 0, "https://a.com/3/"), ("https://b.com/no/x/", 0, "https://a.com/4/"), ("https://a.com/3/", 0, "https://a.com/1/")]
    table = spark.createDataFrame(links, "src string, pos int, url string")
    rules = spark.createDataFrame([("https://b.com/", 200, "User-agent: *\nDisallow: /no/*/")], "origin string, http_code int, body string")
    seed = spark.createDataFrame([("https://a.com/1/",)], "url string")
    want = ["https://a.com/1/", "https://a.com/", "https://a.com/2/", "https://b.com/no/x/", "https://b.com/", "https://a.com/3/"]
    got = frontier.crawl(seed, table, rules).orderBy("place").collect()
    assert [r.url for r in got] == want and [r.place for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r.url for r in got if not r.fetched] == ["https://b.com/no/x/"]
    assert [r.url for r in frontier.crawl(seed, table, rules, 3).orderBy("place").collect()] == want[:4]


def test_numbers_over_ranges(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("x"))
    assert sorted((r.n, r.x) for r in shared.numbered(df, "n", "x").collect()) == [(i + 1, i) for i in range(1000)]
    assert shared.numbered(df.where("false"), "n", "x").count() == 0


def test_texts_as_guesses(spark):
    rows = {r.guess: r for r in similarity.guessed(spark.createDataFrame([("house",), ("zq",), ("",)], "guess string"), "house", similarity.letter_counts).collect()}
    assert rows["house"].correct and rows["house"].score == 1.0 and not rows["zq"].correct and 0 < rows["zq"].score < 1000
    pair = spark.createDataFrame([("ab", "ab"), ("ab", None)], "left_text string, right_text string")
    assert abs(similarity.pair_similarity(pair, similarity.letter_counts).first().similarity - 1) < 1e-6


def test_score_of_a_negative_similarity_is_no_number(spark):
    s = spark.createDataFrame([("a", -0.1), ("a", 0.25), ("b", 1.0000001), ("s", 1.0)], "g string, x double").select(V.guess_score(F.col("g"), F.lit("s"), F.col("x")).alias("s")).collect()
    assert s[0].s != s[0].s and [r.s for r in s[1:]] == [500.0, 1000.0, 1.0]


def test_stream_keeps_one_row_a_url(spark, tmp_path):
    schema = "page_id long, url string, html string"
    batch = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}", mode="append")
    (tmp_path / "in").mkdir()
    run = lambda: keep_index(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/site", f"{tmp_path}/cp", RULES).awaitTermination()
    batch("a", [(1, "https://a.com/", "<title>one</title>"), (2, "https://b.org/", "<title>b</title>")])
    run()
    batch("b", [(3, "https://a.com/", "<title>three</title>")])
    run()
    last = max(int(p.name[1:]) for p in (tmp_path / "site").iterdir())
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/site/v{last}").collect()) == ["b", "three"]


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    assert plans.QUERIES.keys() == plans.SQL.keys()
