"""Distinct words of a batch of texts and hashed features of their letters."""

from __future__ import annotations

import numpy as np

from .words import LETTERS, hashes, mix, words


class Distinct:
    """Words of texts given as bytes and offsets: hash of each distinct word, which of them each word is, first word of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low, starts, ends, self.first = words(data, at, LETTERS)
        self.hash, where, self.of = np.unique(hashes(low, starts, ends), return_index=True, return_inverse=True)
        self.low, self.starts, self.ends = low, starts[where], ends[where]

    def __len__(self) -> int:
        return len(self.hash)

    def take(self, which: np.ndarray) -> Distinct:
        """Some of the distinct words, without where they stand."""
        out = object.__new__(Distinct)
        out.low, out.hash, out.starts, out.ends = self.low, self.hash[which], self.starts[which], self.ends[which]
        return out

    def padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of '<word>' one after the other, start of each and length."""
        size = self.ends - self.starts + 2
        start = np.cumsum(size) - size
        out = np.full(int(size.sum()), ord("<"), np.uint8)
        k = np.arange(len(out)) - np.repeat(start, size)
        inner = (k > 0) & (k < np.repeat(size, size) - 1)
        out[inner] = self.low[(np.repeat(self.starts, size) + k - 1)[inner]]
        out[start + size - 1] = ord(">")
        return out, start, size

    def grams(self, width: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all n-grams of '<word>' and, for each word, where its own begin. Each word has one at least."""
        out, start, size = self.padded()
        code = np.zeros(len(out), np.uint64)
        for i in range(width):
            code[: len(out) - i] |= out[i:].astype(np.uint64) << np.uint64(8 * i)
        many = np.maximum(size - width + 1, 1)
        first = np.cumsum(many) - many
        which = np.repeat(start - first, many) + np.arange(int(many.sum()))
        return (mix(code[which] + np.uint64(width)) % np.uint64(slots)).astype(np.int64), first

    def affix(self, width: int, end: bool, slots: int) -> np.ndarray:
        """Slot of each word's first or last bytes."""
        code = np.zeros(len(self), np.uint64)
        for i in range(width):
            at = self.ends - 1 - i if end else self.starts + i
            code |= np.where(i < self.ends - self.starts, self.low[np.clip(at, 0, max(len(self.low) - 1, 0))], 0).astype(np.uint64) << np.uint64(8 * i)
        return (mix(code + np.uint64((width * 2 + end) << 40)) % np.uint64(slots)).astype(np.int64)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among sorted ones; len(sorted_keys) for those that are not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    i = np.searchsorted(sorted_keys, keys)
    i[i == len(sorted_keys)] = 0
    return np.where(sorted_keys[i] == keys, i, len(sorted_keys))
