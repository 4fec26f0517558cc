"""Vectorised character-level kit: texts as one array of code points.

Operators that must look at every character work on blocks of texts joined into a single
numpy array of code points, so the per-character work runs in numpy and not in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters worked on at a time; bounds the memory of a Python worker whatever the batch holds.
BLOCK_CHARS = 1 << 20
#: Texts of a block (their numbers fit in 16 bits).
BLOCK_TEXTS = 50_000
LETTER, DIGIT, MARK, SPACE, UPPER, PUNCT, SYMBOL = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Bit flags of every code point (categories L*, N*, M*, white space, Lu, P*, S*)."""
    out = np.zeros(0x110000, np.uint8)
    by = {"L": LETTER, "N": DIGIT, "M": MARK, "P": PUNCT, "S": SYMBOL}
    category = unicodedata.category
    # planes 4 to 13 are unassigned and 15, 16 private: none of the flags
    for lo, hi in ((0, 0x40000), (0xE0000, 0xE0200)):
        cats = [category(chr(i)) for i in range(lo, hi)]
        out[lo:hi] = [by.get(c[0], 0) | (UPPER if c == "Lu" else 0) for c in cats]
    for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] |= SPACE
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def values(column, step: int = 256) -> Iterator:
    """The Python values of an Arrow array, made a few rows at a time (a batch may hold very long texts)."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def blocks(keys: Iterable, texts: Iterable[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Group (key, text) into blocks of about ``chars`` characters; null texts count as empty."""
    ks: list = []
    ts: list[str] = []
    n = 0
    for k, t in zip(keys, texts):
        t = t or ""
        if n and (n + len(t) > chars or len(ks) == BLOCK_TEXTS):
            yield ks, ts
            ks, ts, n = [], [], 0
        ks.append(k)
        ts.append(t)
        n += len(t) + 1
    if ks:
        yield ks, ts


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and the start of each text (n + 1)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes("\n".join(texts) + "\n"), starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _P, np.uint64)
        up[0] = 1
        down = np.full(n, np.uint64(_inverse(int(_P))), np.uint64)
        down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that polynomial hashes spread evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings cp[start:end], equal for equal substrings anywhere."""
    size = 1 << max(10, int(len(cp)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class SpanHashes:
    """Hashes of single substrings of one text, each in constant time."""

    def __init__(self, cp: np.ndarray):
        self.up, self.down = _powers(1 << max(10, int(len(cp)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * self.up[: len(cp)], dtype=np.uint64)))

    def of(self, start: int, end: int) -> int:
        """As ``span_hashes`` has it."""
        with np.errstate(over="ignore"):
            h = (self.sums[end : end + 1] - self.sums[start : start + 1]) * self.down[start]
            return int(mix(h + np.uint64(end - start) * np.uint64(0xD6E8FEB86659FD93))[0])
