"""Ids of whole texts by the tokenizers library, in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .chunks import Memo, gathered


#: Letters that stand alone under the normaliser and are one byte or two: a to z, Latin-1 and its extensions, but for those
#: whose lower case is two characters.
_LATIN = "".join(chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100), *range(0x140, 0x250)] if chr(c).isalpha() and len(chr(c).lower()) == 1)


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_SPELT = dict(enumerate(byte_letters()))


def vocabulary() -> str:
    """Path of the tokenizer that the queries use; the operators take any such path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def memo(path: str) -> Memo:
    """One per worker process and tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tokenize, whole, pack = tok.model.tokenize, _whole(tok), struct.pack

    def fill(texts: list[str]) -> list[tuple[bytes]]:
        out, words, rest = [(b"",)] * len(texts), [], []
        for k, t in enumerate(texts):
            (words if whole(t) else rest).append(k)
        for k, word in zip(words, _spelt([texts[k] for k in words]), strict=True):
            ids = [x.id for x in tokenize(word)]
            out[k] = (pack(f"<{len(ids)}I", *ids),)
        for k, e in zip(rest, tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False) if rest else (), strict=True):
            out[k] = (np.asarray(e.ids, "<u4").tobytes(),)
        return out

    return Memo(fill)


def _spelt(words: list[str]) -> list[str]:
    """Words in lower case, their bytes as letters; all at once, with a line feed between."""
    return "\n".join(words).lower().encode().decode("latin-1").translate(_SPELT).split(_SPELT[10]) if words else []


def _whole(tok) -> Callable[[str], object]:
    """Tells pieces of Latin letters, of which this tokenizer's normaliser and patterns make one word, if they do."""
    pairs = [x + y for x, y in zip(_LATIN, _LATIN[1:], strict=False)]
    if tok.normalizer is None or any([x for x, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(w))] != _spelt([w]) for w in pairs):
        return lambda t: None
    return re.compile(f"[{_LATIN}]+").fullmatch


def encoded(column: pa.Array, path: str) -> Iterator[bytes]:
    """For each text its ids, as little-endian unsigned 32-bit integers. A null is an empty text."""
    for ((data, at),) in gathered(column, memo(path)):
        whole = memoryview(data)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield bytes(whole[i:j])


def mapped(make: Callable, path: str) -> Callable:
    """A function for mapInArrow: make(doc ids, iterator of ids of each text) gives a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from make(b.column("doc_id"), encoded(b.column("text"), path))

    return run
