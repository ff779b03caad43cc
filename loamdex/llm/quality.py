"""Operator 8: quality rules whose cutoffs are certified on labelled documents, in DataFrame functions.

Each rule compares one figure of a text with a cutoff from a fixed grid. In each stratum (texts of like length), documents labelled good are
the holdout: a cutoff is certified if, by the exact binomial (Clopper-Pearson) bound, the rule rejects at most its share of
FALSE_REJECTION of good documents, with an error probability of at most ERROR over all rules, cutoffs and strata together
(Bonferroni). Of a rule's certified cutoffs the one that rejects most is used; a rule without one is not used in that
stratum. Only counts per stratum, rule and cutoff reach the driver. Cutoffs are not chosen by looking at the labels of any
other sample, so all labelled documents serve as the holdout.

A null text counts as empty; it has no words and fails the base rule. Repeated rows get equal results, and a label of a repeated
id counts once (the best label). Without labels only the base rule rejects. Columns other than doc_id and text are not
read; an empty table gives no rows. Very long texts are handled whole, in time n log n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import let

FALSE_REJECTION, ERROR = 0.05, 0.05
#: Strata by words: up to the first bound, the second, and more.
STRATA = (200, 1000)
# Rules: figure, whether more of it is worse, cutoffs from loose to strict.
RULES = {
    "symbol_share": (True, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "dup_line_share": (True, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeat_share": (True, [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "mean_word": (True, [20.0, 16.0, 14.0, 12.0, 10.0, 9.0]),
    "short_word": (False, [1.5, 2.0, 2.5, 3.0, 3.5, 4.0]),
}
_BLANK = r"[\x20\x09-\x0D]"


def _repeated(w: Column) -> Column:
    """How many words are in 3-word windows that the text has twice or more. Windows are told apart by 96 bits of two hashes:
    in a text of 10 million words the chance of one false repeat is under 10 ** -14."""
    n = F.size(w)
    three = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(*three(i)))).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        # hashes and place, sorted: equal windows side by side
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.hash(*three(i)).alias("g"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
            again = F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0))))) | same(x, F.get(s, i + 1)))
            places = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, F.greatest(i - 1, F.lit(0)))))), F.lit(0).cast("bigint"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(keyed, covered))

    return let(windows, count)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base, and the rules' figures."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, _BLANK + "+"), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    out = docs.select("doc_id", counted.alias("w"), by_line.alias("l"), (F.length(text) - F.regexp_count(text, F.lit(_BLANK))).cast("bigint").alias("word_chars"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    return out.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def _rule_figures() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    mean = share("word_chars", "n_words")
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "mean_word": mean, "short_word": mean}


def _rejects(rule: str, cutoff: float) -> Column:
    value = _rule_figures()[rule]
    return value > cutoff if RULES[rule][0] else value < cutoff


def stratum() -> Column:
    return F.when(F.col("n_words") <= STRATA[0], 0).when(F.col("n_words") <= STRATA[1], 1).otherwise(2)


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def at_most(rejected: int, good: int, share: float, error: float) -> bool:
    """Whether the exact upper bound of a rejection rate, seen so often, is at most share: the chance of so few at that rate
    is at most error."""
    if good == 0:
        return False
    logs = [math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * math.log(share) + (good - k) * math.log1p(-share) for k in range(rejected + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(error)


def certify(rows: DataFrame, labels: DataFrame) -> dict[tuple[int, str], float]:
    """The cutoff in force for each stratum and rule that has a certified one."""
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = rows.join(good, "doc_id", "left_semi").where(~failed())
    tests = [(r, c) for r, (_, grid) in RULES.items() for c in grid]
    counts = held.groupBy(stratum().alias("stratum")).agg(F.count("*").alias("good"), *(F.count_if(_rejects(r, c)).alias(f"t{i}") for i, (r, c) in enumerate(tests))).collect()
    share, error = FALSE_REJECTION / len(RULES), ERROR / (len(tests) * (len(STRATA) + 1))
    out: dict[tuple[int, str], float] = {}
    for row in counts:
        for i, (rule, cutoff) in enumerate(tests):  # from loose to strict: the last certified one stays
            if at_most(row[f"t{i}"], row.good, share, error):
                out[row.stratum, rule] = cutoff
    return out


def verdicts(rows: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """rows with base_failed and kept."""
    rejected = F.lit(False)
    for (s, rule), cutoff in sorted(cutoffs.items()):
        rejected = rejected | ((stratum() == s) & _rejects(rule, cutoff))
    return rows.withColumn("base_failed", failed()).withColumn("kept", ~failed() & ~rejected)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(figures(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return verdicts(rows, certify(rows, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
