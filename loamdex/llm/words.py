"""Words of many texts at once, as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate(([np.uint64(1)], np.full(_SLICE + 1, _BASE))), dtype=np.uint64)
_INV = np.cumprod(np.concatenate(([np.uint64(1)], np.full(_SLICE + 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))), dtype=np.uint64)
#: Bytes of letters (all of UTF-8 beyond ASCII counts as letters), lower case; 0 elsewhere.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x80:] = np.arange(0x80, 0x100)
for _a, _b in ((b"a", b"z"), (b"A", b"Z")):
    LETTERS[_a[0] : _b[0] + 1] = np.arange(ord("a"), ord("z") + 1)
#: The same with digits.
ALNUM = LETTERS.copy()
ALNUM[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-stirred 64-bit hash of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Lower-case bytes with 0 between words; of letters beyond ASCII, those of Latin-1 are lowered too. Marks of Latin-1,
    general punctuation and the first marks for East Asian scripts, and spaces among all these, stand between words."""
    out = table[data]
    if len(out) > 2:
        two, latin, three, east = (np.flatnonzero(data[:-1] == b) for b in (0xC2, 0xC3, 0xE2, 0xE3))
        after = data[two + 1]
        two = two[(after != 0xAA) & (after != 0xB5) & (after != 0xBA)]
        after = data[latin + 1]
        two = np.concatenate((two, latin[(after == 0x97) | (after == 0xB7)]))
        out[latin[(after <= 0x9E) & (after != 0x97)] + 1] += 0x20
        out[two] = out[two + 1] = 0
        last = np.concatenate((three[data[three + 1] == 0x80], east[data[east + 1] == 0x80]))
        last = last[last < len(out) - 2]
        last = last[(data[last] == 0xE2) | (data[last + 2] <= 0x82)]
        for k in range(3):
            out[last + k] = 0
    return out


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of words in them, and for each text the index of its first word (len + 1 entries)."""
    low = fold(data, table)
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 0
    edge = np.diff(inside)
    # a word never runs on into the next text
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(low))]
    if len(cut):
        cut = cut[(low[cut] != 0) & (low[cut - 1] != 0)]
        starts[cut] = True
        ends[cut - 1] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, starts, ends, np.searchsorted(starts, at)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of low; memory beyond the result is bounded by a slice."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
            if j == i + 1 and ends[i] - base > _SLICE:
                out[i] = int.from_bytes(__import__("hashlib").blake2b(low[base : ends[i]].tobytes(), digest_size=8).digest(), "little")
                i = j
                continue
            part = low[base : ends[j - 1]].astype(np.uint64)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _POW[: len(part)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64))
            i = j
    return out
