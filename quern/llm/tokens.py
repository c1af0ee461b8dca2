"""Tokens of many texts at once, in numpy: runs of bytes of one class, hashed.

Letters (with all bytes from 0x80 on), digits and marks form runs; white space and
control bytes separate them.  Positions are bytes of the text's UTF-8.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: Classes of bytes.
SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a longer text that are looked at together, about.
SLICE = 1 << 20
_GAP = re.compile(rb"[\x00-\x20\x7f]")


def cut_at(text: bytes, size: int) -> int:
    """The first place from ``size`` on where a separating byte stands; a word of more than ``SLICE`` bytes is cut."""
    if size >= len(text):
        return len(text)
    gap = _GAP.search(text, size, min(len(text), size + SLICE))
    return gap.start() if gap else min(len(text), size + SLICE)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; its lower-cased value as a hash; powers of an odd number."""
    kind = np.full(256, MARK, np.uint8)
    kind[:33] = SPACE
    kind[127] = SPACE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = kind[128:] = LETTER
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    powers = np.cumprod(np.full(256, _ODD, np.uint64))
    return kind, mix(low + np.uint64(1)), powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Tokens of ``texts``: ``doc``, ``begin`` and ``end`` (bytes within the text), ``kind``, ``code``
    (hash, A-Z lower-cased) and ``upper`` (the number of A-Z bytes)."""

    def __init__(self, texts: list[bytes], marks: bool = True):
        kinds, low, powers = _tables()
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        kind = kinds[data]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        # White space runs and, if so wanted, marks go; a run's bytes are summed before.
        at = np.flatnonzero(first)
        run = np.diff(np.append(at, len(data)))
        within = np.arange(len(data)) - np.repeat(at, run)
        codes = np.add.reduceat(low[data] * powers[within & 255], at)
        upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int32), at)
        keep = kind[at] != SPACE if marks else (kind[at] != SPACE) & (kind[at] != MARK)
        at, run = at[keep], run[keep]
        self.kind, self.upper, self.code = kind[at], upper[keep], mix(codes[keep] + run.astype(np.uint64))
        self.doc = np.searchsorted(starts, at, side="right") - 1
        self.begin = at - starts[self.doc]
        self.end = self.begin + run


def grams(code: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` tokens in a row within a document, and the position of the first."""
    if len(code) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = code[: len(code) - n + 1].copy()
    for i in range(1, n):
        total = mix(total * _ODD + code[i : len(code) - n + 1 + i])
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return total[at], at


def chunks(ids: list, texts: list[bytes | None], most: int = 1 << 18):
    """Lists of ids and texts of about ``most`` bytes together."""
    i, t, size = [], [], 0
    for a, b in zip(ids, texts):
        i.append(a)
        t.append(b or b"")
        size += len(t[-1]) + 1
        if size >= most:
            yield i, t
            i, t, size = [], [], 0
    if i:
        yield i, t
