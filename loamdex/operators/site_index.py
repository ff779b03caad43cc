"""The table of pages: upsert by URL, search by title, result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.urls import is_origin, normalize
from ..sources.shared import materialize

FIELDS = ["url", "title", "description", "favicon"]


def extracted(pages: DataFrame, rules: list[tuple[str, bool, bool]], scope: str = "all") -> DataFrame:
    """url (canonical), title, description, favicon, content_hash, seq, last_visited of pages (page_id, url, html and, if
    known, http_code and visited) that have a URL and were fetched well; only origins with scope='origin'. Of rows whose
    code is 300 or more none is kept; last_visited is null where the time of the visit is not known."""
    has = lambda c, kind: F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    ok = pages.where(F.coalesce(has("http_code", "int"), F.lit(200)) < 300)
    out = ok.select(normalize(F.col("url"), rules).alias("url"), H.title(F.col("html")).alias("title"), H.description(F.col("html")).alias("description"), H.favicon(F.col("html")).alias("favicon"), F.lit(0).cast("bigint").alias("content_hash"), F.col("page_id").alias("seq"), has("visited", "timestamp_ntz").alias("last_visited"))
    out = out.where(F.col("url").isNotNull())
    return out.where(is_origin(F.col("url"))) if scope == "origin" else out


def upserted(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row for each URL: the last by seq; rows of new win over old."""
    rows = new.withColumn("_new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    names = [c for c in new.columns if c != "url"]
    last = F.max_by(F.struct(*names), F.struct("_new", "seq")).alias("_row")
    return rows.groupBy("url").agg(last).select("url", *(F.col(f"_row.{c}").alias(c) for c in names))


def store(site: DataFrame, path: str) -> DataFrame:
    """The table written as Parquet, and read: what searches read, a few columns of it."""
    return materialize(site, path)


def pattern(q: str, literal: bool = False) -> str:
    """For ilike: '%' and '_' in q are wildcards and a backslash escapes them, unless literal."""
    out, i = "", 0
    while i < len(q):
        c = q[i]
        if literal:
            out += "\\" + c if c in "%_\\" else c
        elif c == "\\":
            following = q[i + 1] if i + 1 < len(q) else "%"
            out += "\\" + following if following in "%_\\" else following
            i += 1
            if i >= len(q):  # the escape takes the closing wildcard
                return "%" + out
        else:
            out += c
        i += 1
    return f"%{out}%"


def search(site: DataFrame, q: str, literal: bool = False) -> DataFrame:
    """Rows whose title has q in it, in any case; no order."""
    return site.where(F.col("title").ilike(pattern(q, literal))).select(*FIELDS)


def item_html() -> Column:
    """A result: its favicon, title, shown address and description, all escaped."""
    e = {c: H.escaped(F.coalesce(c, F.lit(""))) for c in FIELDS}
    icon = F.concat(F.lit('<img src="favicons/'), e["favicon"], F.lit('">'))
    return F.concat(F.lit('<div class="item"><a href="'), e["url"], F.lit('">'), icon, F.lit("<p>"), e["title"], F.lit("</p><p>"), e["url"], F.lit("</p></a><p>"), e["description"], F.lit("</p></div>"))


def result_page(found: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """items (how many were found) and html of one page of them, ordered by URL: a page holds `size` items at most, so its one
    row is bounded."""
    shown = found.orderBy("url").offset(page * size).limit(size).select("url", item_html().alias("item"))
    html = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", "item"))), lambda x: x["item"]), "").alias("html"))
    return found.agg(F.count("*").alias("items")).join(html)
