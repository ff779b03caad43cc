"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a learned vector of the word (of a vocabulary) beside one of its characters: the mean of learned vectors
of its character trigrams plus those of its first bytes. Windows of WINDOW words, each starting STRIDE words after the one before, are all scored; attention pools the
states of both directions in each. A document's score comes from its two strongest windows, calibrated on training
documents that the network has not seen. The network is trained in numpy on at most SAMPLE labelled documents, from random
vectors, in a task of its own.

Null texts count as empty. A text without words gets the score of a window without words. Repeated rows get equal scores,
other columns are not read. Without labelled rows of both kinds every score is 0 and nothing is predicted toxic. An empty
table gives no rows. Very long texts are scored whole, window by window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fitted, sample_rows, small_batches, split_of, table, utf8
from .wordfeats import Distinct, find
from .words import words as words_of

WINDOW, STRIDE = 48, 24
#: Labelled documents that the network is fitted to at most; words and trigrams with vectors of their own.
SAMPLE, VOCABULARY, TRIGRAMS = 3000, 30_000, 4096
#: Lengths in bytes of word beginnings with vectors of their own, and their hashed slots.
HEADS, HEAD_SLOTS = (5, 7), 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, STEPS, RATE = 8, 6, 8, 320, 0.02
#: Windows of a document, at random places of it, that the fit reads at most; how often toxic documents' windows are picked anew.
EACH, REPICKS = 64, 7
THRESHOLD = 0.7
#: Bytes of text scored together.
TOGETHER = 1 << 20


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the windows of texts whose words begin at first; how many each text has (1 at least)."""
    n = np.diff(first)
    many = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    upto = np.cumsum(many)
    k = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - many, many)
    start = np.repeat(first[:-1], many) + k * STRIDE
    return start, np.clip(np.repeat(first[1:], many) - start, 0, WINDOW), many


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, and passes over windows given as word vectors (time x windows x features)."""

    def __init__(self, rng: np.random.Generator, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        g = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": g(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": g(TRIGRAMS, CHAR_DIM, scale=0.1), "v": g(2 * h, scale=0.3), "out": g(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        self.p["word"][-1] = 0
        for k in HEADS:
            self.p[f"head{k}"] = g(HEAD_SLOTS, CHAR_DIM, scale=0.03)
        for side in "fb":
            self.p |= {f"w{side}": g(d, 3 * h, scale=d**-0.5), f"u{side}": g(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}

    def vectors(self, words: Distinct) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Vector of each distinct word; rows of the tables that it comes from; where its trigrams begin."""
        gram, begin = words.grams(3, TRIGRAMS)
        rows = {"word": find(self.vocabulary, words.hash), "char": gram} | {f"head{k}": words.affix(k, False, HEAD_SLOTS) for k in HEADS}
        x = np.zeros((len(words), WORD_DIM + CHAR_DIM), np.float32)
        if len(words):
            x[:, :WORD_DIM] = self.p["word"][rows["word"]]
            x[:, WORD_DIM:] = np.add.reduceat(self.p["char"][gram], begin) / np.diff(np.append(begin, len(gram)))[:, None]
            for k in HEADS:
                x[:, WORD_DIM:] += self.p[f"head{k}"][rows[f"head{k}"]]
        return x, rows, begin

    def scan(self, side: str, inputs: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, list]:
        """States over time. inputs: (time, n, 3h) already projected; alive: (time, n, 1), 0 beyond a window's end."""
        h, u = HIDDEN, self.p[f"u{side}"]
        t, n, _ = inputs.shape
        state, states, kept = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32), [None] * t
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            a = inputs[k]
            zr = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
            c = np.tanh(a[:, 2 * h :] + (zr[:, h:] * state) @ u[:, 2 * h :])
            kept[k] = (state, zr, c)
            state = state + alive[k] * zr[:, :h] * (c - state)
            states[k] = state
        return states, kept

    def unscan(self, side: str, grad_states: np.ndarray, kept: list, alive: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of the projected inputs; adds that of the recurrent weights."""
        h, u = HIDDEN, self.p[f"u{side}"]
        t, n, _ = grad_states.shape
        carry, out, gu = np.zeros((n, h), np.float32), np.empty((t, n, 3 * h), np.float32), np.zeros_like(u)
        for k in range(t - 1, -1, -1) if side == "f" else range(t):
            state, zr, c = kept[k]
            z, r = zr[:, :h], zr[:, h:]
            g = carry + grad_states[k]
            move = g * alive[k]
            gc = move * z * (1 - c * c)
            gz = move * (c - state) * z * (1 - z)
            through = gc @ u[:, 2 * h :].T
            gr = through * state * r * (1 - r)
            out[k, :, :h], out[k, :, h : 2 * h], out[k, :, 2 * h :] = gz, gr, gc
            gu[:, : 2 * h] += state.T @ out[k, :, : 2 * h]
            gu[:, 2 * h :] += (r * state).T @ gc
            carry = g - move * z + out[k, :, : 2 * h] @ u[:, : 2 * h].T + through * r
        grads[f"u{side}"] = gu
        return out

    def pool(self, states: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights (time x n), pooled states and logits."""
        e = np.where(alive[..., 0] > 0, states @ self.p["v"], -30)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return a, pooled, pooled @ self.p["out"] + self.p["bias"]

    def logits(self, x: np.ndarray, of: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One for each window. x: vectors of distinct words; of: which word stands where."""
        projected = {s: np.vstack([x @ self.p[f"w{s}"] + self.p[f"c{s}"], self.p[f"c{s}"][None]]) for s in "fb"}
        of = np.append(of, len(x))
        out = np.empty(len(start), np.float32)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), 4096):
            rows = order[i : i + 4096]
            at = np.arange(max(1, int(length[rows].max())))[:, None]
            alive = at < length[rows]
            which = of[np.where(alive, start[rows] + at, len(of) - 1)]
            alive = alive[..., None].astype(np.float32)
            states = np.concatenate([self.scan(s, projected[s][which], alive)[0] for s in "fb"], axis=2)
            out[rows] = self.pool(states, alive)[2]
        return out

    def step(self, words: Distinct, start: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[dict, float]:
        """Gradients of the weighted logistic loss over some windows."""
        at = np.arange(WINDOW)[:, None]
        alive = at < length
        there, which = np.unique(np.where(alive, words.of[np.where(alive, start + at, 0)], words.of[0]), return_inverse=True)
        x, rows, begin = self.vectors(words.take(there))
        seen = (rng.random(which.shape) > 0.1)[..., None]  # some words are read by their letters alone
        v = x[which] * alive[..., None]
        v[..., :WORD_DIM] *= seen
        alive = alive[..., None].astype(np.float32)
        grads: dict[str, np.ndarray] = {}
        scans = {s: self.scan(s, v @ self.p[f"w{s}"] + self.p[f"c{s}"], alive) for s in "fb"}
        states = np.concatenate([scans["f"][0], scans["b"][0]], axis=2)
        a, pooled, logit = self.pool(states, alive)
        p = _sigmoid(logit)
        g = ((p - label) * weight / weight.sum()).astype(np.float32)
        grads["out"], grads["bias"] = g @ pooled, g.sum(keepdims=True)
        gp = g[:, None] * self.p["out"]
        ga = np.einsum("nh,tnh->tn", gp, states)
        ge = a * (ga - (a * ga).sum(axis=0))
        grads["v"] = np.einsum("tn,tnh->h", ge, states)
        gs = a[..., None] * gp + ge[..., None] * self.p["v"]
        gv = np.zeros_like(v)
        for k, s in enumerate("fb"):
            gi = self.unscan(s, gs[..., k * HIDDEN : (k + 1) * HIDDEN], scans[s][1], alive, grads)
            flat = gi.reshape(-1, 3 * HIDDEN)
            grads[f"w{s}"], grads[f"c{s}"] = v.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
            gv += gi @ self.p[f"w{s}"].T
        gv *= alive
        gv[..., :WORD_DIM] *= seen
        flat, to = gv.reshape(-1, gv.shape[-1]), which.ravel()
        each = np.stack([np.bincount(to, flat[:, c], len(there)) for c in range(flat.shape[1])], axis=1)
        many = np.diff(np.append(begin, len(rows["char"])))
        letters = each[:, WORD_DIM:]
        for name, r in rows.items():
            g = each[:, :WORD_DIM] if name == "word" else np.repeat(letters / many[:, None], many, axis=0) if name == "char" else letters
            grads[name] = np.stack([np.bincount(r, g[:, c], len(self.p[name])) for c in range(g.shape[1])], axis=1)
        grads["word"][-1] = 0
        return grads, float((weight * np.where(label > 0, -np.log(p + 1e-7), -np.log(1 - p + 1e-7))).sum() / weight.sum())


def strongest(logits: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text: the largest logit, the second (or the same), log of the count of windows, 1."""
    first = np.cumsum(many) - many
    top = np.maximum.reduceat(logits, first)
    text = np.repeat(np.arange(len(many)), many)
    place = np.full(len(many), len(logits))
    hit = np.flatnonzero(logits == top[text])[::-1]
    place[text[hit]] = hit
    rest = logits.copy()
    rest[place] = -np.inf
    second = np.maximum.reduceat(rest, first)
    return np.stack([top, np.where(np.isfinite(second), second, top), np.log(many), np.ones(len(many))], axis=1)


def known(unit: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """The units that are in three texts or more, the most frequent VOCABULARY of them, in order."""
    n = np.bincount(np.unique(text * np.int64(size) + unit) % size, minlength=size)
    often = np.flatnonzero(n >= 3)
    return np.sort(often[np.argsort(-n[often], kind="stable")[:VOCABULARY]])


def drawn(text: bytes, most: int = EACH) -> list[bytes]:
    """The words of a text's windows, with a space between: all windows, or so many at random places of the whole text."""
    low, starts, ends, first = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    start, length, _ = windows(first)
    if len(start) > most:
        pick = np.sort(np.random.default_rng(zlib.crc32(text)).choice(len(start), most, replace=False))
        start, length = start[pick], length[pick]
    return [b" ".join(low[a:b].tobytes() for a, b in zip(starts[s : s + n], ends[s : s + n], strict=True)) for s, n in zip(start, length, strict=True)]


def fit(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> tuple[Network, np.ndarray] | None:
    """The network and the calibration's weights, from the windows of each text; None without texts of both labels.

    A toxic text need not be toxic all over: it teaches by all its windows at first and then, REPICKS times, by those that
    the network itself finds strongest."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order].astype(np.float32)
    own = np.arange(len(texts)) % 5 != 4  # a fifth is for calibration
    if labels[own].min() == labels[own].max() or labels[~own].size == 0 or labels[~own].min() == labels[~own].max():
        own = np.ones(len(texts), bool)
    many = np.array([max(1, len(t)) for t in texts])
    of_text = np.repeat(np.arange(len(texts)), many)
    flat = [w for t in texts for w in (t or [b""])]
    words = Distinct(np.frombuffer(b"".join(flat), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in flat]))))
    if not len(words):
        return None
    start, length = words.first[:-1], np.diff(words.first)
    text = of_text[np.repeat(np.arange(len(flat)), length)]
    mine = own[text]
    net = Network(rng, words.hash[known(words.of[mine], text[mine], len(words))])
    y = labels[of_text]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    size, each = 256, STEPS // (REPICKS + 1)
    for t in range(1, each * (REPICKS + 1) + 1):
        if t % each == 1:
            strength = net.logits(net.vectors(words)[0], words.of, start, length) if t > 1 else rng.random(len(flat))
            rank = np.lexsort((-np.where(y > 0, strength, rng.random(len(flat))), of_text))
            nth = np.arange(len(rank)) - np.repeat(np.cumsum(many) - many, many)
            top = many if t == 1 else np.maximum(1, many // 4)
            usable = rank[((y[rank] == 0) | (nth < np.repeat(top, many))) & own[of_text[rank]]]
            # a text counts alike however many windows it has, and both labels do
            share = 1 / np.bincount(of_text[usable], minlength=len(texts))[of_text[usable]]
            p = np.where(y[usable] > 0, share / share[y[usable] > 0].sum() * 0.4, share / share[y[usable] == 0].sum() * 0.6)
            picks = usable[rng.choice(len(usable), each * size, p=p / p.sum())]
        part = picks[(t - 1) % each * size : ((t - 1) % each + 1) * size]
        grads, _ = net.step(words, start[part], length[part], y[part], np.ones(len(part)), rng)
        for k, g in grads.items():
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = RATE * (1 - 0.9 * t / STEPS)
            net.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)).astype(np.float32)
    seen = strongest(net.logits(net.vectors(words)[0], words.of, start, length), many)
    held = ~own if (~own).any() else own
    f, target, w = seen[held], labels[held], np.array([1.0, 0, 0, 0])
    for _ in range(200):  # Newton steps for a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hess = (f * (p * (1 - p))[:, None]).T @ f + 0.1 * np.eye(4)
        move = np.linalg.solve(hess, f.T @ (p - target) + 0.1 * (w - [1, 0, 0, 0]))
        w = w - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return net, w


def score(docs: DataFrame, model: tuple[Network, np.ndarray] | None) -> DataFrame:
    """doc_id, score (0 to 1), windows of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at, TOGETHER):
                words = Distinct(data[at[i] : at[j]], at[i : j + 1] - at[i])
                start, length, many = windows(words.first)
                if model is None:
                    p = np.zeros(j - i)
                else:
                    net, w = model
                    f = strongest(net.logits(net.vectors(words)[0], words.of, start, length), many)
                    p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.round(p, 6), pa.float64()), pa.array(many, pa.int64())], ["doc_id", "score", "windows"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, windows long")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Network, np.ndarray] | None:
    """Fitted, in one task, to at most so many documents with a label; split of crc32(doc_id), remainder 1 of 3, is never
    learned from. Of a document at most EACH windows are drawn, from all of its text. Rows that share an id share its label."""
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (split_of("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most `most` ids, so their broadcast is bounded
    ids = sample_rows(labelled.join(docs.select("doc_id"), "doc_id", "left_semi"), most, "doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    small_batches(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [drawn(t.as_buffer().to_pybytes()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("toxic").cast(pa.int32()), pa.array(own, pa.list_(pa.binary()))], ["order", "toxic", "windows"])

    def learn(held: pa.Table) -> tuple[Network, np.ndarray] | None:
        rows = sorted(zip(*(held[c].to_pylist() for c in ("order", "windows", "toxic")), strict=True))
        return fit([w for _, w, _ in rows], np.array([y for *_, y in rows], np.float32))

    few = sample_rows(rows, most, "doc_id", "text").select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("order"), "text", "toxic")
    return fitted(few.mapInArrow(draw, "order long, toxic int, windows array<binary>"), learn)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.coalesce(split_of("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "windows")
