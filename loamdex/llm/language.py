"""Operator 4: language by a linear-chain conditional random field over words.

Each word's score for each language is the sum of learned weights of its prefixes, suffixes, letter n-grams and, if it is in
the lexicon, of itself; learned transitions link neighbours. Chains are the words of a document, SPAN at a time. Training
chains are spliced from documents of different languages, so that transitions are learned too. Forward-backward gives each
word's probabilities; `label_words` returns runs of words of one language, and a document's language is the one with the
largest mean probability.

A null text, or one without a letter, is `und` with score 0. A text whose only letters lie outside what the model has seen
still gets its likeliest language. Repeated rows get equal results, other columns are not read, an empty table gives none.
Without a labelled row to learn from every text is `und`. Very long texts are labelled whole, chain by chain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fitted, small_batches, split_of, table, utf8
from .wordfeats import Distinct, find
from .words import words as words_of

SPAN = 64
#: Labelled documents that the field is fitted to about, of any one language at least (if it has so many), languages learned
#: (those with most documents), stretches of 4 to 24 words of a document at most, from all of its text.
SAMPLE, LEAST_EACH, LANGUAGES, STRETCHES = 1500, 100, 200, 10
#: Hashed features, lexicon.
SLOTS, LEXICON = 1 << 14, 5000
ROUNDS, RATE = 40, 0.15
UNKNOWN = "und"
#: The pipeline keeps documents whose language is at least so sure.
KEEP = 0.5
TOGETHER = 1 << 20


class Field:
    """Weights of features (slots x languages), of lexicon words, and log transitions between languages."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.p = {"slot": np.zeros((SLOTS, n)), "word": np.zeros((len(lexicon) + 1, n)), "move": np.eye(n) * 2.0}

    def features(self, words: Distinct) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Slots of each word: arrays with one for each word, or with several and where each word's own begin."""
        one = [(words.affix(k, end, SLOTS), None) for k in (1, 2, 3) for end in (False, True)]
        return one + [words.grams(k, SLOTS) for k in (2, 3)]

    def emit(self, words: Distinct, feats: list | None = None) -> np.ndarray:
        """Score of each distinct word for each language."""
        out = self.p["word"][find(self.lexicon, words.hash)].copy()
        for slot, begin in feats if feats is not None else self.features(words):
            w = self.p["slot"][slot]
            if begin is None:
                out += w
            elif len(words):
                out += np.add.reduceat(w, begin) / np.diff(np.append(begin, len(slot)))[:, None] * 3
        return out

    def marginals(self, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Forward-backward. scores: (chains, SPAN, languages); chains by decreasing length. Probabilities of each word's
        languages, and the expected counts of transitions."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.p["move"] - self.p["move"].max())
        t = int(length[0]) if len(length) else 0
        live = [int(np.searchsorted(-length, -k, "left")) for k in range(t)]  # chains longer than k
        a, b = np.zeros_like(e), np.ones_like(e)
        for k in range(t):
            n = live[k]
            f = e[:n, k] if k == 0 else (a[:n, k - 1] @ move) * e[:n, k]
            a[:n, k] = f / f.sum(axis=1, keepdims=True)
        pairs = np.zeros_like(move)
        for k in range(t - 1, 0, -1):
            n = live[k]
            g = b[:n, k] * e[:n, k]
            f = g @ move.T
            b[:n, k - 1] = f / f.sum(axis=1, keepdims=True)
            z = np.einsum("ni,ij,nj->n", a[:n, k - 1], move, g)
            pairs += (a[:n, k - 1] / z[:, None]).T @ g
        p = a * b
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-30)
        return p, pairs * move


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of chains of texts whose words begin at first, and the text of each."""
    n = np.diff(first)
    many = -(-n // SPAN)
    text = np.repeat(np.arange(len(n)), many)
    start = np.repeat(first[:-1], many) + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * SPAN
    return start, np.minimum(first[1:][text] - start, SPAN), text


def stretches(text: bytes, most: int = STRETCHES) -> list[bytes]:
    """A text cut into stretches of 4 to 24 words: all of them, or so many at random places of the whole text."""
    _, starts, ends, _ = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    if not len(starts):
        return []
    rng = np.random.default_rng(zlib.crc32(text))
    cut = np.cumsum(rng.integers(4, 25, -(-len(starts) // 4)))
    first = np.concatenate(([0], cut[cut < len(starts)]))
    last = np.append(first[1:], len(starts)) - 1
    pick = np.sort(rng.choice(len(first), most, replace=False)) if len(first) > most else np.arange(len(first))
    return [text[starts[first[k]] : ends[last[k]]] for k in pick]


def fit(texts: list[list[bytes]], langs: list[str], seed: int = 11) -> Field | None:
    """A field learned from stretches of words of each text. Stretches of different texts are spliced into chains."""
    flat = [(part, x) for t, x in zip(texts, langs, strict=True) for part in t]
    if not flat:
        return None
    rng = np.random.default_rng(seed)
    names = sorted({x for _, x in flat})
    lang = np.array([names.index(x) for _, x in flat])
    words = Distinct(np.frombuffer(b"".join(t for t, _ in flat), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t, _ in flat]))))
    count = np.bincount(words.of, minlength=len(words))
    often = np.flatnonzero(count >= 3)
    field = Field(names, words.hash[np.sort(often[np.argsort(-count[often], kind="stable")[:LEXICON]])])
    parts = [(words.first[k], words.first[k + 1] - words.first[k], lang[k]) for k in range(len(flat)) if words.first[k + 1] > words.first[k]]
    if not parts:
        return None
    of, gold = [], []
    for i in rng.permutation(len(parts)):
        a, n, y = parts[i]
        of.append(words.of[a : a + n])
        gold.append(np.full(n, y))
    of, gold = np.concatenate(of), np.concatenate(gold)
    n = -(-len(of) // SPAN)
    length = np.full(n, SPAN)
    length[-1] = len(of) - SPAN * (n - 1)
    there, of = np.unique(of, return_inverse=True)
    own = words.take(there)
    feats, row = field.features(own), find(field.lexicon, own.hash)
    pad = np.zeros(n * SPAN, np.int64)
    pad[: len(of)] = of
    y = np.zeros((n * SPAN, len(names)))
    y[np.arange(len(of)), gold] = 1
    true_pairs = np.zeros((len(names),) * 2)
    inner = np.arange(len(of) - 1)
    inner = inner[(inner + 1) % SPAN != 0]
    np.add.at(true_pairs, (gold[inner], gold[inner + 1]), 1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in field.p.items()}
    for t in range(1, ROUNDS + 1):
        emit = field.emit(own, feats)
        p, pairs = field.marginals(emit[pad].reshape(n, SPAN, -1), length)
        miss = (p.reshape(n * SPAN, -1) - y)[: len(of)]
        each = np.stack([np.bincount(of, miss[:, c], len(own)) for c in range(len(names))], axis=1)
        grads = {"slot": np.zeros_like(field.p["slot"]), "move": pairs - true_pairs, "word": np.stack([np.bincount(row, each[:, c], len(field.lexicon) + 1) for c in range(len(names))], axis=1)}
        grads["word"][-1] = 0
        for slot, begin in feats:
            if begin is None:
                g = each
            else:
                many = np.diff(np.append(begin, len(slot)))
                g = np.repeat(each / many[:, None] * 3, many, axis=0)
            for c in range(len(names)):
                grads["slot"][:, c] += np.bincount(slot, g[:, c], SLOTS)
        for k, g in grads.items():
            g = g / len(of) + 1e-5 * field.p[k]
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            field.p[k] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return field


def _probabilities(field: Field, words: Distinct) -> np.ndarray:
    """Of each word's languages, in text order."""
    start, length, _ = chains(words.first)
    emit = field.emit(words)
    out = np.empty((len(words.of), len(field.langs)))
    order = np.argsort(-length, kind="stable")
    of = np.append(words.of, np.zeros(SPAN, np.int64))
    for i in range(0, len(order), 4096):
        rows = order[i : i + 4096]
        at = start[rows][:, None] + np.arange(SPAN)
        inside = np.arange(SPAN) < length[rows][:, None]
        p, _ = field.marginals(emit[of[at]], length[rows])
        out[at[inside]] = p[inside]
    return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def classify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score, and mix: how many words have each language, as `lang:n` by decreasing n."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, TOGETHER):
                lang, score, mixed = [UNKNOWN] * (j - i), np.zeros(j - i), [""] * (j - i)
                words = Distinct(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if field is not None and len(words):
                    p = _probabilities(field, words)
                    best = p.argmax(axis=1)
                    total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
                    n = np.diff(words.first)
                    mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)[:, None]
                    text = np.repeat(np.arange(j - i), n)
                    votes = np.bincount(text * len(field.langs) + best, minlength=(j - i) * len(field.langs)).reshape(j - i, -1)
                    plain = np.bincount(text, (words.low[words.starts] < 0x80)[words.of], j - i) > 0
                    for k in np.flatnonzero(n > 0):
                        if plain[k] or _has_letter(data[at[i + k] : at[i + k + 1]].tobytes()):
                            c = int(mean[k].argmax())
                            lang[k], score[k] = field.langs[c], min(1.0, round(float(mean[k, c]), 6))
                            mixed[k] = ",".join(f"{field.langs[x]}:{votes[k, x]}" for x in np.argsort(-votes[k], kind="stable") if votes[k, x])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(lang), pa.array(score), pa.array(mixed)], ["doc_id", "lang_pred", "score", "mix"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, mix string")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, first, last, lang: runs of words (numbered from 0) of one language in each text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, TOGETHER):
                words = Distinct(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if not len(words):
                    continue
                best = _probabilities(field, words).argmax(axis=1)
                text = np.repeat(np.arange(j - i), np.diff(words.first))
                new = np.flatnonzero(np.concatenate(([True], (np.diff(best) != 0) | (np.diff(text) != 0))))
                end = np.append(new[1:], len(best))
                base = words.first[:-1][text[new]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i + text[new])), pa.array(new - base), pa.array(end - 1 - base), pa.array([field.langs[c] for c in best[new]])], ["doc_id", "first", "last", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, first long, last long, lang string")


def train(docs: DataFrame, most: int = SAMPLE) -> Field | None:
    """Fitted, in one task, to about so many different documents with text and lang, of each language a share like its own or
    LEAST_EACH; remainder 2 of crc32(doc_id) modulo 4 is never learned from. All rows are looked at to choose them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (split_of("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    order = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("sample"))
    share = lambda n: max(most * n / sum(sizes.values()), LEAST_EACH) / n
    bound = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(int(share(n) * 2**64) - 2**63, 2**63 - 1))) for x, n in sizes.items()))
    few = known.withColumn("order", order).where(F.col("order") <= bound).dropDuplicates(["order"])
    small_batches(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [stretches(t.as_buffer().to_pybytes()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("lang"), pa.array(own, pa.list_(pa.binary()))], ["order", "lang", "parts"])

    def learn(held: pa.Table) -> Field | None:
        rows = sorted(zip(*(held[c].to_pylist() for c in ("order", "lang", "parts")), strict=True))
        return fit([p for *_, p in rows], [x for _, x, _ in rows])

    return fitted(few.mapInArrow(draw, "order long, lang string, parts array<binary>"), learn)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs))
    return out.select("doc_id", (F.coalesce(split_of("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "mix")
