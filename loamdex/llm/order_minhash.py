"""Operator 2: near duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of words (letters and digits, lower case); its k-mers are SHINGLE words in a row, labelled by
their occurrence number. Each of SKETCHES sketches takes the ORDER labelled k-mers of least hash and keeps them in the
order of the text, so that two documents share a sketch with a probability that falls with their edit distance. Documents
with an equal sketch (a bucket) and lengths that allow the similarity are candidates.

A candidate pair is a link if its words align well enough: words matched in order, one to one, within the band of diagonals
that a similar pair can use, over all words of both (matched / (n + m - matched)), are SIMILARITY or more. Classes are the
connected components of links; a class's id is its least doc_id, null only if none of its rows has one.

Equal word sequences are one text to begin with, whatever their ids: texts have ids of their own here, so several texts
under one doc_id, or one text under several, do not disturb each other. In a bucket all members are compared with a hub, the
member whose id has the least hash (so buckets of the same texts mostly have the same hub), which gives most links and a
first set of components. Where a bucket still holds several components, every member outside its largest one is then
compared with every member of another component, in blocks of bounded size: a task holds one block of each side, counts the
words that each pair has in common (no less than an alignment can match) and aligns the pairs for which that is enough. So
no candidate pair is left out but those already in one class, and links, not pairs, leave a task.

A null text is in a class of its own. Texts without words are equal only as written. Texts with fewer words than a k-mer are
copies only if their words are equal. Rows with the same doc_id give a row each, and so do null ids. Columns other than
doc_id (of any type that has an order) and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, materialize, small_batches, table, utf8
from .words import ALNUM, hashes, mix, words

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, ORDER = 24, 3
#: A block of a bucket has about so many members and words at most.
BLOCK_ROWS, BLOCK_WORDS = 256, 1 << 19
#: Words whose incidence matrix is held at once; rows of an alignment that share a window of columns, at least.
COLUMNS, ROWS = 1 << 13, 512
TOGETHER = 1 << 20
#: Texts to look up are sent to every executor only up to this count (about 40 bytes each); beyond it a shuffled join does it.
BROADCAST_TEXTS = 100_000


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers of a sequence of word hashes."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number: equal ones become different, alike in each text."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.concatenate(([True], t[1:] != t[:-1]))
    if new.all():
        return s
    nth = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    with np.errstate(over="ignore"):
        out[order] = np.where(nth > 0, mix(t + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), t)
    return out


def sketches(s: np.ndarray, count: int = SKETCHES, order: int = ORDER) -> np.ndarray:
    """Order MinHash sketches of a text's k-mers, each as one 64-bit hash."""
    s = labelled(s)
    salts = np.arange(1, 2 * count, 2, dtype=np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F)
    order = min(order, len(s))
    picked = np.empty((count, order), np.int64)
    at_once = max(1, (1 << 17) // len(s))  # sketches of short texts together
    for i in range(0, count, at_once):
        own = salts[i : i + at_once]
        h = (s ^ own) * (own | np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        row = np.arange(len(h))
        for k in range(order):
            least = h.argmin(axis=1)
            picked[i : i + at_once, k] = least
            h[row, least] = np.uint64(2**64 - 1)
    picked.sort(axis=1)  # back to the order of the text
    out = np.arange(1, count + 1, dtype=np.uint64)
    for k in range(order):
        out = mix(out * np.uint64(31) + s[picked[:, k]])
    return out


def matched(a: list[int], b: list[int], band: int) -> int:
    """Words of a and b that match in order, within a band of diagonals: a longest common subsequence, a row of the band in
    one step of long integers. A block of rows shares a window of columns, so memory is a few windows."""
    total, rows, n, m = 0, max(ROWS, 2 * band), len(a), len(b)
    v, left, width = 0, 0, 0  # bit k of v is 0 where the count grows at column left + k
    for i in range(0, n, rows):
        lo, hi = max(0, min(m, i - band)), min(m, i + rows + band)
        drop = min(lo - left, width)
        total += drop - (v & ((1 << drop) - 1)).bit_count()  # columns that leave the window keep their count
        v >>= drop
        v |= ((1 << (hi - lo)) - 1) ^ ((1 << (width - drop)) - 1)
        left, width = lo, hi - lo
        full = (1 << width) - 1
        where: dict[int, int] = {}
        for k in range(lo, hi):
            where[b[k]] = where.get(b[k], 0) | 1 << (k - lo)
        for x in a[i : i + rows]:
            y = where.get(x)
            if y is not None:
                u = v & y
                v = ((v + u) | (v - u)) & full
    return total + width - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched words over all, by the best alignment within the band; or some value under `least`, if it is less."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least / (1 + least) * (n + m)  # matches of a similar pair
    if min(n, m) < need:
        return 0.0
    head = int((np.append(a[: min(n, m)] != b[: min(n, m)], True)).argmax())  # equal words at both ends need no alignment
    rest = min(n, m) - head
    tail = int((np.append(a[n - rest :][::-1] != b[m - rest :][::-1], True)).argmax())
    got = head + tail + matched(a[head : n - tail].tolist(), b[head : m - tail].tolist(), int(n + m - 2 * need) + 1)
    return got / (n + m - got)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (of the word sequence), n (words), sketches of each document (with doc_id, text, text_hash)."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "text_hash", "key", "n", "sketches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            null = b.column("text").is_null().to_pylist()
            for i, j in blocks(at, TOGETHER):
                low, starts, ends, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i], ALNUM)
                h = hashes(low, starts, ends)
                key, sig = [], []
                for k in range(j - i):
                    own = h[first[k] : first[k + 1]]
                    raw = b"" if len(own) else data[at[i + k] : at[i + k + 1]].tobytes() + b"."
                    key.append(None if null[i + k] else hashlib.blake2b(own.tobytes() + raw, digest_size=16).digest())
                    s = shingles(own)
                    sig.append(sketches(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                size = np.cumsum([0] + [len(x) for x in sig]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(sig)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in names[:2]), pa.array(key, pa.binary()), pa.array(np.diff(first), pa.int64()), lists], names)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, key binary, n long, sketches array<long>")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many words each of left has in common with each of right, repeats counted."""
    counts = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for own in (left, right):
        sides.append((np.concatenate([labelled(x) for x in own]), np.repeat(np.arange(len(own)), [len(x) for x in own])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for c in range(0, len(shared), COLUMNS):
        part, has = shared[c : c + COLUMNS], []
        for (own_words, row), own in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, own_words), len(part) - 1)
            hit = part[at] == own_words
            m = np.zeros((len(own), len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            has.append(m)
        counts += has[0] @ has[1].T
    return counts


def parts(size: str, n_words: str) -> Column:
    """Into how many blocks so many members with so many words are split."""
    return F.ceil(F.greatest(F.col(size) / BLOCK_ROWS, F.col(n_words) / BLOCK_WORDS, F.lit(1))).cast("int")


def block(n: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("block")), F.col(n)).cast("int")


def spelt(docs: DataFrame, which: DataFrame) -> DataFrame:
    """id, words (64-bit hashes) of some texts. docs: doc_id, text, text_hash; which: id, doc_id, text_hash, cheap to read twice."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, TOGETHER):
                low, starts, ends, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i], ALNUM)
                h = hashes(low, starts, ends)
                own = [h[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(own, pa.binary())], ["id", "words"])

    n = which.limit(BROADCAST_TEXTS + 1).count()
    right = which.select("id", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    found = docs.join(F.broadcast(right) if n <= BROADCAST_TEXTS else right, same).select("id", "text")
    return found.mapInArrow(run, "id long, words binary").dropDuplicates(["id"])


def linked(items: DataFrame, texts: DataFrame, by: list[str], least: float) -> DataFrame:
    """Links (a, b, comp_a, comp_b) within groups. items: the columns `by` of a group, id, comp, is_main, and asks: members
    that ask are compared with those that do not. Within a group components that a link has joined are not compared again."""

    def links(group: pa.Table) -> pa.Table:
        ids, comp, main, asks = (group.column(c).to_numpy() for c in ("id", "comp", "is_main", "asks"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("words")]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            n = np.array([len(x) for x in own])
            counts = common([own[x] for x in left], [own[x] for x in right])
            need = least / (1 + least) * (n[left][:, None] + n[right][None, :])
            open_ = (counts >= need - 1e-6) & (comp[left][:, None] != comp[right][None, :]) & (main[right][None, :] | (ids[left][:, None] < ids[right][None, :]))
            of: dict[int, int] = {}  # components joined here

            def top(c: int) -> int:
                while c in of:
                    c = of[c]
                return c

            x, y = np.nonzero(open_)
            for k in np.argsort(-(counts[x, y] / need[x, y]), kind="stable"):
                a, b = left[x[k]], right[y[k]]
                u, v = top(comp[a]), top(comp[b])
                if u != v and similarity(own[a], own[b], least) >= least:
                    of[max(u, v)] = min(u, v)
                    found.append((ids[a], ids[b], comp[a], comp[b]))
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.table({c: pa.array(np.array(v, np.int64)) for c, v in zip(("a", "b", "comp_a", "comp_b"), cols, strict=True)})

    return items.join(texts, "id").groupBy(*by).applyInArrow(links, "a long, b long, comp_a long, comp_b long")


def to_hubs(now: DataFrame, least: float) -> DataFrame:
    """Blocks of members to compare with their hubs. now: bucket, id, n, hub, hub_n."""
    near = (F.least("n", "hub_n") >= least * F.greatest("n", "hub_n")) & (F.col("id") != F.col("hub"))
    pairs = materialize(now.where(near).select("hub", "id", "n").distinct())
    # written first: a join that stands directly on an aggregate cannot have its skewed partitions split
    many = materialize(pairs.groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("words")).select("hub", parts("size", "words").alias("parts")))
    split = pairs.join(many, "hub")
    members = split.select("hub", block("parts").alias("i"), "id", F.lit(False).alias("asks"))
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("hub").alias("id"), F.lit(True).alias("asks"))
    return materialize(members.unionByName(hubs).withColumn("comp", F.col("id")).withColumn("is_main", F.lit(True)))


def to_rest(member: DataFrame) -> DataFrame:
    """Blocks of members of different components that share a bucket. member: bucket, id, n, comp."""
    each = member.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("words"))
    most = F.max(F.struct("size", "comp", "words"))
    held = each.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("comps"), most.alias("most")).where("comps > 1 AND size > 2")
    held = held.withColumn("rest", F.col("size") - F.col("most.size")).withColumn("rest_words", F.col("words") - F.col("most.words"))
    held = materialize(held.select("bucket", F.col("most.comp").alias("main"), parts("rest", "rest_words").alias("outer_parts"), parts("size", "words").alias("all_parts")))
    split = member.join(held, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = split.where(~F.col("is_main")).select("bucket", "id", "comp", "is_main", F.lit(True).alias("asks"), block("outer_parts").alias("i"), every("all_parts").alias("j"))
    whole = split.select("bucket", "id", "comp", "is_main", F.lit(False).alias("asks"), every("outer_parts").alias("i"), block("all_parts").alias("j"))
    return materialize(outer.unionByName(whole))


def components(edges: DataFrame) -> DataFrame:
    """id, comp (least id) of all ids in edges (a, b), by turns of linking larger, then smaller neighbours to the least. An
    id's least neighbour is written before it is joined, so that the join can split the rows of an id with many neighbours."""

    def turn(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            e = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = materialize(e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        j = e.join(least, "u")
        if larger:
            return j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return j.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    e, open_ = edges, True
    while open_:
        e = materialize(turn(materialize(turn(e, True).distinct()), False).where("a != b").distinct())
        # done when all are stars: each a has one b, which is no a
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("b", F.lit(0), F.lit(1)))
        open_ = not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(F.col("out") + F.col("in") > 1).isEmpty()
    return e.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id").union(e.select("b", "b").distinct())


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, is_first (whether its id is the class's)."""
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = materialize(signed(source))
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    texts = rows.where(F.col("key").isNotNull()).groupBy("key").agg(place, F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("id"), "key", "least.none", "least.doc_id", "least.text_hash", "n", "sketches"))
    member = texts.select(F.posexplode("sketches").alias("band", "value"), "id", "n").select(F.xxhash64("band", "value").alias("bucket"), "id", "n")
    first = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n")).alias("first")
    crowded = materialize(member.groupBy("bucket").agg(F.count("*").alias("size"), first).where("size > 1").select("bucket", F.col("first.id").alias("hub"), F.col("first.n").alias("hub_n")))
    now = materialize(member.join(crowded, "bucket"))
    of = lambda items: texts.join(items.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_hash")
    items = to_hubs(now, least)
    links = materialize(linked(items, spelt(source, materialize(of(items))), ["hub", "i"], least))
    comp = materialize(components(links.select("a", "b")))
    items = to_rest(now.select("bucket", "id", "n").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    if not items.isEmpty():
        more = materialize(linked(items, spelt(source, materialize(of(items))), ["bucket", "i", "j"], least))
        if not more.isEmpty():
            joined = components(more.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("id").alias("old"), F.col("comp").alias("new"))
            ends = more.select(F.col("a").alias("id"), F.col("comp_a").alias("comp")).union(more.select("b", "comp_b")).distinct()
            comp = comp.union(ends.join(comp, "id", "left_anti")).join(joined, F.col("comp") == F.col("old"), "left").select("id", F.coalesce("new", "comp").alias("comp"))
    known = materialize(texts.select("id", "key", "none", "doc_id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    named = materialize(known.groupBy("comp").agg(F.min(F.struct("none", "doc_id")).alias("least")).select("comp", F.col("least.doc_id").alias("class_id")))
    out = rows.select("doc_id", "key").join(known.join(named, "comp").select("key", "class_id"), "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(False)).alias("is_first"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
