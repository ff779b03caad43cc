"""Operator 5: personal data by gradient-boosted trees over candidate spans, in DataFrame functions.

Generators with high recall propose spans, which may overlap: runs of digits with separators, spelt-out e-mail addresses,
and account numbers that begin with letters. Boosted trees score each by its format and context; a kind's threshold is the
least one that keeps PRECISION on examples held out from fitting. Base spans (email, ip, card, phone by fixed rules) always
stay; a candidate that overlaps one is dropped. The trees become CASE expressions over the features of each candidate.

Nobody labelled the tables' candidates, so labels come from examples: surroundings of at most SNIPPETS documents, cut at
hashed places of the whole text, into which made personal data (telephone and social security numbers, account numbers with
valid check digits, spelt-out addresses) and look-alikes (dates, versions, amounts, serial numbers, plain prose around "at")
are put, with and without words that announce them. Features of examples come from the same expressions as those of texts.
The examples' number does not depend on the table's size, so rare kinds are found in large tables as in small ones.

A null text counts as empty and has no spans. Repeated rows get equal results; columns other than doc_id and text are not read
by `find`, and `redact` passes them through. An empty table gives an empty one. Patterns take linear time in the text, places
and overlaps of n spans n ** 1.5 small steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample_rows, table
from .spans import SPAN, chunks, clear, digits, joined, let, looked, luhn, none, ordered, redacted, spans

BASE = ["email", "ip", "card", "phone"]
#: Kinds that the method adds, by the generators' names.
ADDED = ["number", "spelt_email", "account"]
KINDS = BASE + ADDED
#: Documents that surroundings are taken from, examples of each form; trees, their depth and step; precision asked of thresholds.
SNIPPETS, EXAMPLES, TREES, DEPTH, SHRINK, PRECISION = 1000, 60, 30, 4, 0.3, 0.95
CONTEXT = 32
_LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns, with possessive forms that match the same spans in linear time.
_PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": r"(?<![0-9+(])[+(]?[0-9](?:[ ().:/-]{0,2}[0-9]){6,}+",
    "spelt_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|dot |\.) ?[a-z0-9-]++)++",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
_MAY = {"email": "@", "phone": "+"}
_WORDS = "tel|telephone|phone|call|calls|fax|mobile|contact|reach|mail|card|account|iban|ssn|social|passport|ip"


def _base(text: Column, kind: str) -> Column:
    found = spans(text, kind, _PATTERN[kind])
    if kind in _MAY:
        found = F.when(F.contains(text, F.lit(_MAY[kind])), found).otherwise(none())
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.filter(found, lambda s: s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.filter(found, lambda s: let(digits(s["value"]), lambda d: F.length(d).between(16, 19) & luhn(d)))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(digits(s["value"])).between(8, 15))
    return found


FEATURES = ["length", "digits", "letters", "dots", "dashes", "spaces", "colons", "brackets", "plus", "luhn", "longest", "context", "before", "after", "marks", "kind", "groups", "year", "check", "sentence"]


def _check_digits(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    v = F.regexp_replace(value, " ", "")
    one = lambda total, c: F.when(c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)
    turned = F.concat(F.substring(v, 5, 60), F.substring(v, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), one) == 1


def _features(text: Column, s: Column) -> Column:
    """Of a span in a text that is given as its chunks."""
    v = s["value"]
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    before = looked(text, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
    return F.array(
        F.length(v).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[.]"), count("[-]"), count("[ ]"), count("[:/]"), count("[()]"),
        flag(v.startswith("+")), flag(let(digits(v), lambda d: F.length(d).between(12, 19) & luhn(d))),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda d: F.length(d))), F.lit(0)).cast("double"),
        flag(F.lower(before).rlike(rf"\b(?:{_WORDS})\b")), flag(before.rlike(r"[A-Za-z0-9=#.,-]$")), flag(looked(text, s["end"], s["end"] + 1).rlike("[A-Za-z0-9%]")),
        count(r"(?i)[(\[{](?:at|dot)[)\]}]"), F.array_position(F.array(*map(F.lit, ADDED)), s["kind"]).cast("double"),
        count("[0-9]+"), flag(v.rlike(r"^(?:19|20)[0-9]{2}[-/.]|[-/.](?:19|20)[0-9]{2}$|[0-9]:[0-9]{2}")),
        F.when(s["kind"] == "account", flag(_check_digits(v))).otherwise(F.lit(0.0)), flag(v.rlike(r"\. ")),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """docs with base (spans by the fixed rules) and proposed (spans by the generators that overlap none of them)."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("base", F.concat(*(_base(text, k) for k in BASE)).cast(SPAN))
    proposed = F.concat(*(spans(text, k, _PATTERN[k]) for k in ADDED)).cast(SPAN)
    return out.withColumn("proposed", let(F.struct(proposed.alias("p"), F.col("base").alias("b")), lambda x: clear(x["p"], x["b"])))


def _numbered(rng: np.random.Generator, form: str) -> str:
    """A form with # as digits, @ as capital letters."""
    return "".join(str(rng.integers(10)) if c == "#" else chr(65 + int(rng.integers(26))) if c == "@" else c for c in form)


def _account(rng: np.random.Generator, form: str) -> str:
    """An account number of a form whose third and fourth characters are its check digits."""
    own = _numbered(rng, form)
    bare = own.replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in bare[4:] + bare[:2] + "00"))
    return own[:2] + f"{98 - number % 97:02d}" + own[4:]


_PHONES = ["(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "0## #### ####", "1-###-###-####", "0##/#######", "0### ######", "(0##) #### ####"]
_NUMBERS = ["##########", "0##########", "#########"]
_PERSONS = ["###-##-####", "### ## ####"]
_PLAIN = ["########", "################", "################ ################", "20##-##-## ##:##:##", "##.##.20## ##:##", "20##/##/##", "19##-19##, 19##", "#.#########", "##.#.##.#.#", "#.###.###.###", "## ### ###", "20##-#####-#####", "###############", "######.##", "## : ## : ## : ##", "20##.####.#####"]
_ACCOUNTS = ["@@## #### #### #### ####", "@@##@@@@##############", "@@## @@@@ #### #### #### ##", "@@####################"]
_SERIALS = ["@@##@@@@@@@@@@@@", "@@## #### #### #### ####", "@@##@@@@##############", "@@##@#@#@#@#@#@#@#", "@@## @@@@ #### #### #### ##"]
_CUES = {"phone": ["tel", "phone:", "call me at", "mobile", "fax", "contact"], "person": ["ssn", "social security", "passport no"], "account": ["iban", "account", "pay to account"], "mail": ["mail", "contact", "reach me:", "e-mail to"]}
_OTHER_CUES = ["order", "serial no", "version", "on", "from", "total", "part", "id"]
_AT, _DOT = [(" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" {at} ", ".")], ["com", "org", "net", "de", "co dot uk"]


def examples(around: list[tuple[str, str]], seed: int = 5) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of made examples in given surroundings."""
    rng = np.random.default_rng(seed)
    around = around or [("", "")]
    out: list[tuple[str, str, int, int, int]] = []

    def add(kind: str, value: str, cues: list[str], share: float, label: int) -> None:
        left, right = around[int(rng.integers(len(around)))]
        cue = str(rng.choice(cues)) + " " if cues and rng.random() < share else ""
        start = len(left) + 1 + len(cue)
        out.append((f"{left} {cue}{value} {right}", kind, start, start + len(value), label))

    for _ in range(EXAMPLES):
        for f in _PHONES:
            add("number", _numbered(rng, f), _CUES["phone"], 0.5, 1)
        for f in _NUMBERS:
            add("number", _numbered(rng, f), _CUES["phone"], 1.0, 1)
            add("number", _numbered(rng, f), _OTHER_CUES, 0.5, 0)
        for f in _PERSONS:
            add("number", _numbered(rng, f), _CUES["person"], 0.5, 1)
        for f in _PLAIN:
            add("number", _numbered(rng, f), _OTHER_CUES, 0.5, 0)
        for f in _ACCOUNTS:
            add("account", _account(rng, f), _CUES["account"], 0.5, 1)
        for f in _SERIALS:
            add("account", _numbered(rng, f), _OTHER_CUES, 0.5, 0)
        words = [w.strip(".,;:!?\"()").lower() for w in " ".join(around[int(rng.integers(len(around)))]).split()]
        words = [w for w in words if w.isascii() and w.isalpha()] or ["word"]
        word = lambda: str(rng.choice(words))
        for at, dot in _AT:
            add("spelt_email", f"{word()}{at}{word()}{dot}{rng.choice(_DOT)}", _CUES["mail"], 0.5 if at != " at " else 0.8, 1)
        for end in (". ", ".", " dot ", "dot "):
            add("spelt_email", f"{word()} at {word()}{end}{word()}", _OTHER_CUES, 0.3, 0)
        add("spelt_email", f"{word()} at {word()}. {word()}", _OTHER_CUES, 0.3, 0)
    return out


class Trees:
    """Boosted regression trees of the logistic loss, as nested tuples: (feature, cut, low, high), or a number."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.start, self.trees = math.log(rate / (1 - rate)), []
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), DEPTH)
            self.trees.append(tree)
            f += self._value(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = round(float(SHRINK * g.sum() / (h.sum() + 1)), 6)
        if depth == 0 or len(g) < 8:
            return leaf
        best = (1e-6, 0, 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - whole
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, float(v[at[i]] + v[at[i] + 1]) / 2)
        if best[0] <= 1e-6:
            return leaf
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        return np.where(low, self._value(tree[2], x), self._value(tree[3], x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def column(self, f: Column) -> Column:
        def one(t) -> Column:
            return F.when(F.get(f, F.lit(t[0])) <= t[1], one(t[2])).otherwise(one(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + one(t)
        return total


def cuts(score: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict[str, float]:
    """A threshold for each kind: the least score down to which PRECISION holds on these examples."""
    out = {}
    for k in ADDED:
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-score[own], kind="stable")]
        good = np.cumsum(y[own]) >= PRECISION * np.arange(1, len(own) + 1)
        last = np.append(score[own][1:] < score[own][:-1], True) if len(own) else good  # equal scores stand or fall together
        ok = np.flatnonzero(good & last)
        out[k] = float(score[own[ok[-1]]]) - 1e-9 if len(ok) else math.inf
    return out


def surroundings(docs: DataFrame, most: int = SNIPPETS) -> list[tuple[str, str]]:
    """What stands on both sides of a hashed place of at most so many documents: 40 code points each."""
    few = sample_rows(docs.where(F.length("text") > 0).select("text"), most, "text")
    at = F.pmod(F.xxhash64("text", F.lit("place")), F.length("text")).cast("int")
    rows = few.select(F.substring("text", F.greatest(at - 39, F.lit(1)), F.least(at, F.lit(40))).alias("left"), F.substring("text", at + 1, F.lit(40)).alias("right")).collect()
    return sorted((r.left.rstrip(), r.right.lstrip()) for r in rows)


def described(spark: SparkSession, made: list[tuple[str, str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of examples; of the span that is proposed at an example's place, if any is."""
    text = F.col("text")
    proposed = F.concat(*(spans(text, k, _PATTERN[k]) for k in ADDED)).cast(SPAN)
    here = lambda s: (s["kind"] == F.col("kind")) & (s["start"] < F.col("end")) & (s["end"] > F.col("start"))
    table_ = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "n int, text string, kind string, start int, end int, label int")
    rows = table_.select("n", "kind", "label", F.get(F.filter(proposed, here), F.lit(0)).alias("s"), chunks(text).alias("cut")).where("s is not null")
    found = rows.select("n", "kind", "label", _features(F.col("cut"), F.col("s")).alias("x")).collect()
    found.sort(key=lambda r: r.n)
    return np.array([r.x for r in found]), np.array([r.label for r in found], float), np.array([r.kind for r in found])


def fit(docs: DataFrame, most: int = SNIPPETS) -> tuple[Trees, dict[str, float]] | None:
    """Trees from two thirds of the examples in surroundings of at most so many documents, thresholds from the rest."""
    x, y, kind = described(docs.sparkSession, examples(surroundings(docs, most)))
    part = np.random.default_rng(3).random(len(y)) < 2 / 3
    trees = Trees(x[part], y[part])
    return trees, cuts(trees.margin(x[~part]), y[~part], kind[~part])


def find(docs: DataFrame, model: tuple[Trees, dict[str, float]] | None) -> DataFrame:
    """docs with base and all_spans (both by kind, then start). Columns of these names are replaced."""
    out = candidates(docs)
    text = F.coalesce("text", F.lit(""))
    if model is None:
        added = none()
    else:
        trees, cut = model
        least = lambda s: F.coalesce(*(F.when(s["kind"] == k, F.lit(v)) for k, v in cut.items()))
        strong = let(chunks(text), lambda own: F.filter("proposed", lambda s: let(_features(own, s), trees.column) >= least(s)))
        added = F.when(F.size("proposed") == 0, none()).otherwise(strong)
    out = out.withColumn("added", added)
    out = out.withColumn("all_spans", ordered(F.concat("base", "added").cast(SPAN), KINDS, kind_first=True))
    return out.drop("added", "proposed")


def redact(docs: DataFrame, model: tuple[Trees, dict[str, float]] | None) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; n_chars, if there, is the new length."""
    names = docs.columns
    own = docs.select("*").withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(names) if c != "text"})
    found = find(own, model).withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("all_spans"))))
    out = found.select(*(F.col("text") if c == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(names)))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    return found.select("doc_id", *map(_count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
