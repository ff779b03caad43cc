"""Operator 7: secrets, with credentials of several parts linked by an interval join, in DataFrame functions.

Base spans (assign, access, hex by fixed rules) always stay. Beside them stand weak parts: identifiers (names of accounts or
clients given a value), opaque strings that could be a secret, and endpoints. Parts are rows with a place; an interval join
over scopes of SCOPE code points (an equality on the document and on the number of each scope that a part touches, with
neighbours, then the distance) finds which have a complement nearby: an opaque string is reported if an identifier or access id is, an identifier if a
secret of any kind is, an endpoint if both are. A part alone is not reported.

A null text counts as empty. Repeated rows get equal results; other columns are not read. An empty table gives no rows.
Patterns take linear time in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import SPAN, clear, joined, let, none, ordered, spans

BASE, WEAK = ["assign", "access", "hex"], ["opaque", "identifier", "endpoint"]
KINDS = BASE + WEAK
SCOPE = 400
# The base patterns; the weak ones are this module's own.
_PATTERN = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "opaque": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
    "identifier": r"""(?i:client_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{3,}+""",
    "endpoint": r"""(?i:https?|wss?|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]++""",
}
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and weak (arrays of spans) of each document."""
    text = F.coalesce("text", F.lit(""))
    may = {"assign": text.rlike("[:=]"), "access": F.contains(text, F.lit("AKIA")), "identifier": text.rlike("[:=]"), "endpoint": F.contains(text, F.lit("://"))}
    found = {k: F.when(may[k], spans(text, k, p)).otherwise(none()) if k in may else spans(text, k, p) for k, p in _PATTERN.items()}
    found["assign"] = F.filter(found["assign"], lambda s: F.length(F.regexp_replace(s["value"], _VALUE, "")) >= 12)
    # opaque: letters of both cases, or letters and digits mixed
    found["opaque"] = F.filter(found["opaque"], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    out = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *(c.cast(SPAN).alias(k) for k, c in found.items()))
    base = ordered(F.concat(*BASE).cast(SPAN), KINDS, kind_first=False)
    free = let(F.struct(F.concat(*WEAK).cast(SPAN).alias("w"), F.col("base").alias("b")), lambda x: clear(x["w"], x["b"]))
    return out.withColumn("base", base).withColumn("weak", free).select("doc_id", "text_hash", "base", "weak")


def near(left: DataFrame, right: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows of left (doc_id, text_hash, start, end, ...) that have one of right in the same document at most `scope` away,
    whichever comes first and however long either is: both are dealt to all scopes that they touch, right to those beside too."""
    number = lambda c: F.floor(F.col(c) / scope)
    spread = right.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.sequence(number("start") - 1, number("end") + 1)).alias("r_scope")).distinct()
    close = (F.col("r_start") <= F.col("end") + scope) & (F.col("start") <= F.col("r_end") + scope)
    rows = left.withColumn("scope", F.explode(F.sequence(number("start"), number("end"))))
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("scope") == F.col("r_scope"))
    return rows.join(spread, same & close, "left_semi").drop("scope").distinct()


def linked(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, kind of the weak parts that have their complements in scope."""
    one = lambda c: rows.select("doc_id", "text_hash", F.explode(c).alias("s")).select("doc_id", "text_hash", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    weak = one("weak").distinct()
    every = one(F.concat("base", "weak").cast(SPAN))
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    names, secrets = of(every, "access", "identifier"), of(every, "assign", "hex", "opaque")
    return near(of(weak, "opaque"), names).unionByName(near(of(weak, "identifier"), secrets)).unionByName(near(near(of(weak, "endpoint"), names), secrets))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and all_spans (both by start, then kind) of each row of docs."""
    rows = materialize(parts(docs))
    links = linked(rows.where(F.size("weak") > 0))
    own = links.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end", F.lit("").alias("value"))).alias("more")).withColumnsRenamed({"doc_id": "l_id", "text_hash": "l_hash"})
    both = rows.join(own, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")), "left")
    more = F.coalesce(F.col("more").cast(SPAN), none())
    return both.select("doc_id", "base", ordered(F.concat("base", more).cast(SPAN), KINDS, kind_first=False).alias("all_spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
