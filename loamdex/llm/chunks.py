"""Values of whole texts, piece by piece between ASCII white space, each distinct piece of a block made once.

The tokenizer drops white space, and no token, merge or normalisation reaches across it, so ids of a text are those of
its pieces one after the other. A block's texts are cut by numpy and Arrow, which find its distinct pieces too; `Memo` holds
what recent pieces gave, in two generations of bounded size; the values are then gathered in text order, again by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import blocks, utf8

#: Pieces that one generation of the memo holds, and bytes of the longest piece that it keeps.
MEMO_PIECES, MEMO_BYTES = 340_000, 64
#: Bytes of text handled together.
BLOCK = 4 << 20
#: Bytes with ASCII letters in lower case; which are ASCII marks (but for the apostrophe, which begins pieces of words).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MARKS = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])
LETTER = np.array([chr(b).islower() and b < 0x80 for b in range(256)])


class Memo:
    """Values (tuples of bytes) of pieces. fill: gets pieces (str), gives their values."""

    def __init__(self, fill: Callable[[list[str]], list[tuple[bytes, ...]]]):
        self.fill = fill
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def look(self, pieces: list[bytes]) -> list[tuple[bytes, ...]]:
        """Values of different pieces."""
        if len(self.new) > MEMO_PIECES:
            self.old, self.new = self.new, {}
        found, new, old, rest = list(map(self.new.get, pieces)), self.new, self.old, []
        for k, v in enumerate(found):
            if v is None:
                v = found[k] = old.get(pieces[k])
                if v is None:
                    rest.append(k)
                else:
                    new[pieces[k]] = v
        if rest:
            for k, v in zip(rest, self.fill([pieces[k].decode("utf-8", "replace") for k in rest]), strict=True):
                found[k] = v
                if len(pieces[k]) <= MEMO_BYTES:
                    new[pieces[k]] = v
        return found


def cut(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each text (bytes and offsets) its pieces: ASCII letters are lowered, as the tokenizer's normaliser does, and a mark
    that follows a letter begins a piece, as its patterns have it, so that words are the same pieces whatever follows them.
    A text that might spell a special token, which is looked for before all that, is cut at white space alone."""
    low = LOWER[data]
    before = np.zeros(len(low), bool)
    if len(low) > 2:
        letter = LETTER[low[:-1]]
        letter[1:] |= (low[:-2] == 0xC3) & (low[1:-1] >= 0x80) & (low[1:-1] != 0x97) & (low[1:-1] != 0xB7)  # of Latin-1
        before[1:] = MARKS[low[1:]] & letter
        before[at[:-1][at[:-1] < len(low)]] = False
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for k in np.unique(np.searchsorted(at, special, "right") - 1):
            low[at[k] : at[k + 1]] = data[at[k] : at[k + 1]]
            before[at[k] : at[k + 1]] = False
    where = np.flatnonzero(before)
    if len(where):
        low, at = np.insert(low, where, ord(" ")), at + np.searchsorted(where, at)
    texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(low)])
    return pc.ascii_split_whitespace(texts)


def gathered(column: pa.Array, memo: Memo) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], ...]]:
    """For each block of a text column, for each part of the memo's values: the bytes of all its texts one after the other,
    and len + 1 offsets. A null is an empty text."""
    data, at = utf8(column)
    for i, j in blocks(at, BLOCK):
        parts = cut(data[at[i] : at[j]], at[i : j + 1] - at[i])
        first = parts.offsets.to_numpy()
        coded = pc.dictionary_encode(parts.flatten())
        values = list(zip(*memo.look(pc.cast(coded.dictionary, pa.large_binary()).to_pylist()), strict=True)) or [(), ()]
        out = []
        for part in values:
            whole = pa.array(part, pa.binary()).take(coded.indices)
            _, ends, held = whole.buffers()
            ends = np.frombuffer(ends, np.int32)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int32)
            out.append((np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), ends[first - first[0]]))
        yield tuple(out)
