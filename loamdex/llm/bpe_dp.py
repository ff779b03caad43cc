"""Operator 3: BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is one token with which its encoding ends. A suffix automaton of the vocabulary gives, at
each position, all tokens that end there; the one that fits is the one whose pair with the last token of the prefix before
it is compatible, i.e. no merge joins pieces across their border. Back-pointers from the whole word give its ids.

The model knows one kind of file: BPE with word ends over bytes, the normaliser and patterns below, no decoder; others are
refused. Null texts count as empty and have no ids; an empty text decodes to an empty text. Repeated rows give repeated
results, other columns are not read, and an empty table gives an empty one. Words of any length take time in proportion.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Memo, gathered
from .common import small_batches, table
from .tokens import byte_letters, vocabulary

#: Verdicts on pairs of tokens that one worker keeps.
PAIRS = 1_000_000
# The white space that the tokenizer's patterns know, its pattern of words, and the parts of the file that this
# model stands for.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


class Suffixes:
    """A suffix automaton of many strings: a state for each set of their substrings that end at the same places. Moves are one
    table, keyed by state and letter; `link` leads from a state to that of its strings' longest suffixes elsewhere."""

    def __init__(self, strings: dict[str, int]):
        self.code = {c: i for i, c in enumerate(sorted({c for s in strings for c in s}))}
        self.width = len(self.code)
        self.move: dict[int, int] = {}
        self.link, self.size, self.letters = [-1], [0], [bytearray()]
        own: dict[int, list[tuple[int, int]]] = {}
        for s, value in strings.items():
            at = 0
            for c in s:
                at = self._extend(at, self.code[c])
        for s, value in strings.items():
            at = 0
            for c in s:
                at = self.move[at * self.width + self.code[c]]
            own.setdefault(at, []).append((len(s), value))
        self.own = {k: sorted(v, reverse=True) for k, v in own.items()}
        self.cached: dict[int, list[tuple[int, int]]] = {}
        del self.letters

    def _new(self, size: int) -> int:
        self.link.append(0)
        self.size.append(size)
        self.letters.append(bytearray())
        return len(self.link) - 1

    def _put(self, state: int, c: int, to: int) -> None:
        key = state * self.width + c
        if key not in self.move:
            self.letters[state] += c.to_bytes(2, "little")
        self.move[key] = to

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for q's strings that are no longer than p's with one letter more; q keeps the longer ones."""
        new = self._new(self.size[p] + 1)
        for k in range(0, len(self.letters[q]), 2):
            x = int.from_bytes(self.letters[q][k : k + 2], "little")
            self._put(new, x, self.move[q * self.width + x])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.move.get(p * self.width + c) == q:
            self.move[p * self.width + c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        """The state of the string of `last` with one letter more, which may be known."""
        q = self.move.get(last * self.width + c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.size[last] + 1), last
        while p >= 0 and p * self.width + c not in self.move:
            self._put(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.move[p * self.width + c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def ending(self, state: int) -> list[tuple[int, int]]:
        """(length, value) of whole strings that a state's strings end with, the longest first."""
        found = self.cached.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                found += self.own.get(at, [])
                at = self.link[at]
            self.cached[state] = found
        return found

    def matches(self, s: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """For each position: it, the length of the longest substring of any string that ends there, and the whole strings
        that may (those that are no longer)."""
        state, long, move, width, code = 0, 0, self.move, self.width, self.code
        for end, c in enumerate(s, 1):
            x = code.get(c, -1)
            if x < 0:
                state = long = 0
                continue
            to = move.get(state * width + x)
            while to is None and state:
                state = self.link[state]
                long = self.size[state]
                to = move.get(state * width + x)
            if to is None:
                long = 0
                continue
            state, long = to, long + 1
            yield end, long, self.cached.get(state) or self.ending(state)


class PrefixBpe:
    """A BPE model with word ends, read from a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if any(spec[k] != v for k, v in _PARTS.items()) or any(model[k] != v for k, v in _MODEL.items()):
            raise ValueError(f"{path}: not the kind of tokenizer that this model stands for")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in {**self.vocab, **self.special}.items()}
        self.letters = byte_letters()
        never = 1 << 60
        self.pair: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair.setdefault((x, y), rank)
            parts.setdefault(z, (x, y, rank))

        def spine(token: int, side: int) -> list[tuple[int, int, int]]:
            """The pieces at one border of a token, from the whole down: piece, rank it is made at, rank it is used at."""
            out, used = [], never
            while token in parts:
                out.append((token, parts[token][2], used))
                used, token = parts[token][2], parts[token][side]
            return [*out, (token, -1, used)]

        self.right = {t: spine(t, 1) for t in self.vocab.values()}
        self.left = {t: spine(t, 0) for t in self.vocab.values()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.symbols: dict[int, int] = {}
        known: dict[str, int] = {}
        for name, t in self.vocab.items():
            if t in parts:
                x, y, rank = parts[t]
                if not self.compatible(x, y, rank):  # its own pieces would be joined otherwise: never made
                    continue
            spelt = self._spelt(name)
            if t in parts or len(spelt) == 1:
                known[spelt] = t
        self.matches = Suffixes(known).matches
        s, p = f"[{_SPACE}]", __import__("regex")
        self.blank = re.compile(s + "+")
        self.words = p.compile(_WORD.replace(r"\s", _SPACE)).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda x: [x]

    def _spelt(self, name: str) -> str:
        """A token's letters; the last of a word becomes one letter of a plane of its own."""
        if self.end and name.endswith(self.end) and len(name) > len(self.end):
            name = name[: -len(self.end)]
            return name[:-1] + chr(0x10000 + ord(name[-1]))
        return name

    def compatible(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """No merge (of a rank under `below`) joins a piece at the right border of a with one at the left border of b."""
        for x, made_x, used_x in self.right[a]:
            for y, made_y, used_y in self.left[b]:
                rank = self.pair.get((x, y))
                if rank is not None and rank < below and rank < used_x and rank <= used_y and made_x <= used_y and made_y < used_x:
                    return False
        return True

    def word(self, w: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        s = w[:-1] + chr(0x10000 + ord(w[-1])) if self.end else w
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        fits, compatible = self.fits, self.compatible
        for end, long, found in self.matches(s):
            for n, t in found:
                if n > long:
                    continue
                start = end - n
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    ok = fits.get(key := (before[0], t))
                    if ok is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        ok = fits[key] = compatible(*key)
                    if not ok:
                        continue
                last[end] = (t, start)
                break
        ids, at = [], len(s)
        while at:
            t, at = last[at]
            ids.append(t)
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                part = self.blank.sub(" ", unicodedata.normalize("NFC", part))
                part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
                for w in self.words(part):
                    ids += self.word("".join([self.letters[b] for b in w.encode()]))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokenizer has no decoder: tokens with a space between."""
        return " ".join(map(self.names.__getitem__, ids))


@cache
def model(path: str) -> PrefixBpe:
    return PrefixBpe(path)


@cache
def memo(path: str) -> Memo:
    m = model(path)

    def fill(texts: list[str]) -> list[tuple[bytes, bytes]]:
        ids = map(m.encode, texts)
        return [(b"".join(i.to_bytes(4, "little") for i in x), (" " + m.decode(x)).encode() if x else b"") for x in ids]

    return Memo(fill)


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded; or SHA-256 of the latter two (hex) instead."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for (data, at), (spelt, to) in gathered(b.column("text"), memo(path)):
                n = np.diff(at) // 4
                one = [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                two = [spelt[i + 1 : j].tobytes() for i, j in zip(to[:-1], to[1:], strict=True)]  # without the first space
                if digests:
                    one, two = ([hashlib.sha256(x).hexdigest() for x in side] for side in (one, two))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(n)), pa.array(n, pa.int64()), pa.array(one, pa.string() if digests else pa.binary()), pa.array(two, pa.string())], names)
                done += len(n)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, {names[2]} {'string' if digests else 'binary'}, {names[3]} string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary(), digests=True)
