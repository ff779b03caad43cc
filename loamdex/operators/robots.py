"""robots.txt: rules that hold for all agents, their matching, and the decision for URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin, path, trimmed

RULES = "array<struct<rule:string,allow:boolean>>"
#: Bytes of robots files whose rules are broadcast at most.
BROADCAST_BYTES = 8 << 20


def parsed(body: Column, agent: str = "*") -> Column:
    """Struct of rules (in order) and sitemaps, by a fold over the lines."""
    state = F.struct(F.lit(False).alias("active"), F.lit(False).alias("block"), F.array().cast(RULES).alias("rules"), F.array().cast("array<string>").alias("sitemaps"))

    def step(s: Column, raw: Column) -> Column:
        line = trimmed(raw)
        colon = F.instr(line, ":")
        key = F.when(colon == 0, line).otherwise(trimmed(F.substring(line, F.lit(1), colon - 1)))
        value = F.when(colon == 0, line).otherwise(trimmed(F.substring(line, colon + 1, F.length(line))))
        is_agent, is_map = key == "User-agent", key == "Sitemap"
        active = F.when(is_agent, (s["active"] & s["block"]) | (value == agent)).otherwise(s["active"])
        rule = F.struct(value.alias("rule"), (key == "Allow").alias("allow"))
        rules = F.when(~is_agent & ~is_map & s["active"], F.concat(s["rules"], F.array(rule))).otherwise(s["rules"])
        block = F.when(is_agent, True).when(is_map | s["active"], False).otherwise(s["block"])
        maps = F.when(is_map, F.concat(s["sitemaps"], F.array(value))).otherwise(s["sitemaps"])
        new = F.struct(active.alias("active"), block.alias("block"), rules.cast(RULES).alias("rules"), maps.alias("sitemaps"))
        return F.when(line == "", s).otherwise(new)

    return F.aggregate(F.split(body, "\n"), state, step, lambda s: F.struct(s["rules"].alias("rules"), s["sitemaps"].alias("sitemaps")))


def parsed_lines(robots: DataFrame, agent: str = "*") -> DataFrame:
    """origin, pos, rule, allow of robots (origin, body): the same rules by windows over lines, for files too long for a fold."""
    lines = robots.select("origin", F.posexplode(F.split("body", "\n")).alias("n", "raw")).withColumn("line", trimmed(F.col("raw"))).where("line <> ''")
    colon = F.instr("line", ":")
    key = F.when(colon == 0, F.col("line")).otherwise(trimmed(F.substring("line", F.lit(1), colon - 1)))
    value = F.when(colon == 0, F.col("line")).otherwise(trimmed(F.substring("line", colon + 1, F.length("line"))))
    by_line = Window.partitionBy("origin").orderBy("n")
    rows = lines.select("origin", "n", key.alias("k"), value.alias("v"))
    rows = rows.withColumn("first", (F.col("k") == "User-agent") & (F.coalesce(F.lag("k").over(by_line), F.lit("")) != "User-agent"))
    rows = rows.withColumn("block", F.sum(F.col("first").cast("int")).over(by_line))
    named = ((F.col("k") == "User-agent") & (F.col("v") == agent)).cast("int")
    rows = rows.withColumn("active", F.max(named).over(Window.partitionBy("origin", "block"))).where("active = 1 AND k NOT IN ('User-agent', 'Sitemap')")
    return rows.select("origin", (F.row_number().over(by_line) - 1).cast("bigint").alias("pos"), F.col("v").alias("rule"), (F.col("k") == "Allow").alias("allow"))


def matches(p: Column, rule: Column) -> Column:
    """Equal counts of slashes, and segment by segment equal or '*'."""
    slashes = lambda s: F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit("")))
    segments = lambda s: F.regexp_extract_all(s, F.lit("^[^/]+|/[^/]*"), F.lit(0))
    each = F.zip_with(segments(p), segments(rule), lambda a, b: a.isNull() | F.coalesce(b.isin("/*", "*"), F.lit(False)) | F.coalesce(a == b, F.lit(False)))
    return (slashes(p) == slashes(rule)) & F.forall(each, lambda x: x)


def decision(p: Column, rules: Column) -> Column:
    """Whether the first rule that matches allows; true if none does."""
    return F.coalesce(F.get(F.filter(rules, lambda r: matches(p, r["rule"])), F.lit(0))["allow"], F.lit(True))


def ruled(robots: DataFrame) -> DataFrame:
    """_origin and _rules of robots (origin, http_code, body) that were fetched well, broadcast if their files are small."""
    ok = robots.where((F.col("http_code") < 300) & (F.col("http_code") > 0)).select(F.col("origin").alias("_origin"), parsed(F.col("body"))["rules"].alias("_rules"))
    small = (robots.agg(F.sum(F.octet_length("body") + 64).alias("n")).first().n or 0) <= BROADCAST_BYTES
    return F.broadcast(ok) if small else ok


def decided(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed, by rules as `ruled` gives them; without rules all is allowed."""
    joined = urls.withColumn("_origin", origin(F.col(url))).join(rules, "_origin", "left")
    return joined.withColumn("allowed", F.coalesce(decision(path(F.col(url)), F.col("_rules")), F.lit(True))).drop("_origin", "_rules")


def allowed(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed. robots: origin, http_code, body; a missing or failed file allows all."""
    return decided(urls, ruled(robots), url)
