"""Spans of regular expressions in texts, as columns: DataFrame functions only.

An array cannot be appended to without a copy, so whatever runs along all spans of a text (places, ends so far) does so in
blocks of about the square root of their number: n spans cost n ** 1.5 small steps, and texts are cut into chunks once, so
that a look at one place of a long text does not start at its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none() -> Column:
    return F.array().cast(SPAN)


#: Code points of a chunk of text; the shortest block of an array that is run along.
CHUNK, RUN = 1024, 32


def running(values: Column, together: Callable[[Column, Column], Column], first: int) -> Column:
    """For each of an array of integers, the sum, least or largest of those up to it: together is that function, first its
    neutral value."""
    nothing = lambda: F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(together(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))

    def run(v: Column) -> Column:
        width = F.greatest(F.lit(RUN), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.aggregate(F.slice(v, k * width + 1, width), nothing(), step))

        def joined(own: Column) -> Column:
            ends = F.aggregate(F.transform(own, lambda x: x["at"]), nothing(), step)["out"]
            before = F.concat(F.array(F.lit(first)), F.slice(ends, 1, F.size(own) - 1))
            return F.flatten(F.zip_with(own, before, lambda x, b: F.transform(x["out"], lambda y: together(y, b))))

        return F.when(F.size(v) <= RUN, F.aggregate(v, nothing(), step)["out"]).otherwise(let(blocks, joined))

    return F.when(F.size(values) > 0, let(values, run)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, for `looked`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def looked(cut: Column, start: Column, end: Column) -> Column:
    """The text between two places (code points), from its chunks."""
    part = lambda k: F.substring(F.get(cut, k), F.greatest(start - k * CHUNK, F.lit(0)) + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - F.greatest(start - k * CHUNK, F.lit(0)))
    number = lambda c: F.floor(c / CHUNK).cast("int")
    return F.when(start < end, F.array_join(F.transform(F.sequence(number(start), number(end - 1)), part), "")).otherwise("")


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost matches of a pattern without capturing groups that matter: kind, start, end (code points), value."""

    def place(found: Column) -> Column:
        # what stands before each match, then the match: both move the place on
        moves = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        own = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))
        return F.when(F.size(found) == 0, none()).otherwise(F.zip_with(found, running(moves, lambda a, b: a + b, 0), own).cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def clear(weak: Column, base: Column) -> Column:
    """The spans of weak that overlap none of base. Few of either are compared directly, many by their order."""
    direct = F.filter(weak, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tagged = lambda a, w: F.transform(a, lambda s: F.struct(s["start"].alias("at"), F.lit(w).alias("weak"), s["end"].alias("end"), s.alias("s")))
    most, least = 2**31 - 1, -1

    def by_order(all_spans: Column) -> Column:
        before = running(F.transform(all_spans, lambda x: F.when(x["weak"] == 0, x["end"]).otherwise(least)), F.greatest, least)
        after = F.reverse(running(F.reverse(F.transform(all_spans, lambda x: F.when(x["weak"] == 0, x["at"]).otherwise(most))), F.least, most))
        kept = F.filter(F.zip_with(F.zip_with(all_spans, before, lambda x, b: F.struct(x.alias("x"), b.alias("before"))), after, lambda z, a: F.struct(z["x"].alias("x"), z["before"].alias("before"), a.alias("after"))), lambda z: (z["x"]["weak"] == 1) & (z["before"] <= z["x"]["at"]) & (z["after"] >= z["x"]["end"]))
        return F.transform(kept, lambda z: z["x"]["s"]).cast(SPAN)

    return F.when((F.size(weak) == 0) | (F.size(base) == 0), weak).when(F.size(weak).cast("bigint") * F.size(base) <= 1024, direct).otherwise(let(F.array_sort(F.concat(tagged(weak, 1), tagged(base, 0))), by_order))


def joined(all_spans: Column) -> Column:
    """kind:start:end of spans in their order, with commas."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(all_spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """Spans by kind (in the order of kinds) and start, or by start and kind."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    keyed = F.transform(all_spans, lambda s: F.struct(*([rank(s).alias("a"), s["start"].alias("b")] if kind_first else [s["start"].alias("a"), rank(s).alias("b")]), s["end"].alias("c"), s.alias("s")))
    return F.when(F.size(all_spans) <= 1, all_spans).otherwise(F.transform(F.array_sort(keyed), lambda k: k["s"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, F.length(number) - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def redacted(text: Column, all_spans: Column) -> Column:
    """Text with each span as [KIND]; of spans that overlap, the one that begins first (then the longest) counts, to the
    end of the last of them."""
    by_place = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("kind"))))

    def cut(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: -s["b"]), F.greatest, 0)

        def pieces(own: Column) -> Column:
            # where a span begins at or after the end of all before it: what stands between, and its kind
            named = lambda s, upto: F.concat(looked(own["cut"], upto, s["a"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            before = F.concat(F.array(F.lit(0)), F.slice(own["ends"], 1, F.size(ordered) - 1))
            parts = F.zip_with(ordered, before, lambda s, upto: F.when(s["a"] >= upto, named(s, upto)).otherwise(""))
            return F.concat(F.array_join(parts, ""), looked(own["cut"], F.element_at(own["ends"], -1), own["size"]))

        return let(F.struct(chunks(text).alias("cut"), ends.alias("ends"), F.length(text).alias("size")), pieces)

    return F.when(F.size(all_spans) == 0, text).otherwise(let(by_place, cut))
