"""URLs as column expressions: canonical form, public suffixes, origins, relative references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_query(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def with_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def ascii_lower(url: Column) -> Column:
    """A to Z only: other letters keep their case."""
    return F.translate(url, UPPER, LOWER)


def has_scheme(url: Column) -> Column:
    return F.contains(url, F.lit("://"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]*://([^/]*)", 1)


def is_origin(url: Column) -> Column:
    """Nothing after the host but a slash at most; null without a scheme."""
    return F.when(has_scheme(url), url.rlike(r"^[^:]*://[^/]*/?$"))


def origin(url: Column) -> Column:
    """Scheme and host with a slash; null without a scheme."""
    return F.when(has_scheme(url), F.concat(F.regexp_extract(url, r"^([^:]*://[^/]*)", 1), F.lit("/")))


def path(url: Column) -> Column:
    """From the first slash after the host, or a slash; null without a scheme."""
    p = F.regexp_extract(url, r"(?s)^[^:]*://[^/]*(/.*)$", 1)
    return F.when(has_scheme(url), F.when(p == "", "/").otherwise(p))


def is_valid(url: Column) -> Column:
    return url.rlike(r"^https?://[^/\s]+") & F.try_parse_url(url, F.lit("HOST")).isNotNull()


def rest_and_suffix(h: Column, suffix: Column, wildcard: Column, exception: Column) -> tuple[Column, Column]:
    """What stands before a host's public suffix, and the suffix, by the kind of rule that matched; rest is null where the
    host is a suffix itself and stays as it is."""
    after = F.substring(suffix, F.instr(suffix, ".") + 1, F.length(suffix))
    before = lambda s: F.substring(h, F.lit(1), F.length(h) - F.length(s) - 1)
    plain = F.when(h != suffix, before(suffix))
    label = F.regexp_extract(plain, r"([^.]*)$", 1)
    wild = F.when(F.contains(plain, F.lit(".")), F.substring(plain, F.lit(1), F.length(plain) - F.length(label) - 1))
    return F.when(exception, before(after)).when(wildcard, wild).otherwise(plain), F.when(exception, after).when(wildcard, F.concat(label, F.lit("."), suffix)).otherwise(suffix)


def normalized(url: Column, suffix: Column, wildcard: Column, exception: Column) -> Column:
    """A canonical URL, given the matched suffix rule of its host: www. before a bare domain. url is already without query,
    lower case and with a slash; null without scheme, suffix or with a host that begins with a dot."""
    h = host(url)
    rest, tail = rest_and_suffix(h, suffix, wildcard, exception)
    named = F.when(rest.isNull(), h).otherwise(F.concat(F.when(F.contains(rest, F.lit(".")), rest).otherwise(F.concat(F.lit("www."), rest)), F.lit("."), tail))
    whole = F.concat(F.regexp_extract(url, r"^([^:]*://)", 1), named, path(url))
    return F.when(has_scheme(url) & suffix.isNotNull() & ~h.startswith("."), whole)


def cleaned(url: Column) -> Column:
    """The steps before the suffix rule: no query or fragment, a slash at the end, lower case."""
    return ascii_lower(with_slash(strip_query(url)))


def lookup(h: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """The longest of a few rules that a host ends with, as a struct; for a long list see operators.suffixes."""
    known = F.array(*(F.struct(F.length(F.lit(s)).alias("n"), F.lit(s).alias("suffix"), F.lit(w).alias("wildcard"), F.lit(e).alias("exception")) for s, w, e in rules))
    return F.array_max(F.filter(known, lambda r: (h == r["suffix"]) | h.endswith(F.concat(F.lit("."), r["suffix"]))))


def normalize(url: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    def ruled(clean: Column) -> Column:
        return once(F.struct(clean.alias("url"), lookup(host(clean), rules).alias("r")), lambda x: normalized(x["url"], x["r"]["suffix"], x["r"]["wildcard"], x["r"]["exception"]))

    return once(once(strip_query(url), lambda u: ascii_lower(with_slash(u))), ruled)


def percent_encoded(url: Column) -> Column:
    """Characters beyond ASCII as their UTF-8 bytes."""
    return once(url, _percent_encoded)


def _percent_encoded(url: Column) -> Column:
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.url_encode(c))), "")
    return F.when(url.rlike(r"[^\x00-\x7F]"), coded).otherwise(url)


def resolve(base: Column, ref: Column) -> Column:
    """A reference against a base URL: absolute, with a host, from the root, or below the base. Dot segments are folded."""
    return once(F.struct(base.alias("base"), ref.alias("ref")), lambda x: once(_resolved(x["base"], x["ref"]), lambda u: F.when(u.rlike(r"/\.\.?(?:/|$)"), _folded(u)).otherwise(u)))


def _resolved(base: Column, ref: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([^:]*:)", 1)
    root = F.regexp_extract(base, r"^([^:]*://[^/]*)", 1)
    below = F.concat(F.regexp_extract(strip_query(base), r"(?s)^(.*/)", 1), ref)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(root, ref)).when(ref == "", base).when(ref.rlike("^[?#]"), F.concat(strip_query(base), ref)).otherwise(below)


def _folded(url: Column) -> Column:
    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(F.regexp_replace(F.regexp_extract(url, r"^[^:]*://[^/]*/([^?#]*)", 1), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.concat(F.regexp_extract(url, r"^([^:]*://[^/]*/)", 1), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), F.regexp_extract(url, r"(?s)([?#].*)$", 1))


def trimmed(line: Column) -> Column:
    """Without white space at both ends, then cut at the first '#'."""
    return F.substring_index(F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), "#", 1)
