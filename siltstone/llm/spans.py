"""Vectorised text spans: pre-tokens and words of many texts at once.

Texts of a batch are laid end to end as one array of code points, and spans
are found, hashed and numbered with array operations, so no Python object is
made per token.  A span's identity is a 128-bit pair of polynomial hashes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Endings that the byte-level pattern splits off after an apostrophe (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_R = (np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xD6E8FEB86659FD93))
_R_INV = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in _R)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as code points, and the offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def pre_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the byte-level pattern's matches, and each text's first match.

    Matches tile each text, so a match ends where the next one starts.  The
    rules are those of the published pattern: runs of letters, of numbers and
    of other characters, each with one leading space; contractions; a run of
    white space leaves its last character to what follows.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = class_table()[cp]
    edge = np.zeros(n + 1, bool)  # a text starts here, or all end
    edge[offsets] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    last = blank & run[1:] & ~edge[1:]  # the last white space before something else
    starts = run[:n].copy()
    lead = last & (cp == 32)
    starts |= last  # it starts a match of its own, or leads the next one
    starts[1:] &= ~lead[:-1]
    alone = (cp == 39) & run[:n] & run[1:] & ~edge[1:]
    alone[1:] &= edge[1:n] | ~(cp[:-1] == 32)
    at = np.flatnonzero(alone)
    at = at[kind[at + 1] == LETTER]
    if len(at):
        run_at = np.flatnonzero(run)
        run_end = run_at[np.searchsorted(run_at, at + 1, "right")]
        done = np.zeros(len(at), bool)
        for tail in CONTRACTIONS:
            hit = ~done & (run_end - at - 1 >= len(tail))
            for i, c in enumerate(tail):
                hit &= cp[np.minimum(at + 1 + i, n - 1)] == ord(c)
            done |= hit
            starts[at[hit] + 1] = False
            rest = at[hit] + 1 + len(tail)
            starts[rest[rest < run_end[hit]]] = True
    at = np.flatnonzero(starts)
    return at, np.searchsorted(at, offsets)


def words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the words ``[^\x20\x09-\x0D]+``, and each text's first word."""
    n = len(cp)
    ink = np.ones(n + 1, bool)
    ink[:n] = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = ink[:n]
    starts = np.flatnonzero(ink[:n] & (~before[:n] | edge[:n]))
    ends = np.flatnonzero(before[1:] & (~ink[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers) < 2:
        _powers.append((np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(_powers[which][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_R[which], _R_INV[which]):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers[which] = tuple(made)
    return _powers[which]


def span_hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; it depends on the span's characters alone."""
    with np.errstate(over="ignore"):
        up, down = _power(which, len(cp) + 1)
        value = cp.astype(np.uint64)
        value += np.uint64(0x100 + which)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value *= up[: len(cp)]
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        out = total[ends]
        out -= total[starts]
        out *= down[starts]
        return mix(out)


def number(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: bool = False) -> tuple[np.ndarray, ...]:
    """The number of each span's content, by first appearance, and the first span of each number; with ``hashes`` two of each number too."""
    one = span_hash(cp, starts, ends)
    codes, kinds = pd.factorize(one)
    first = np.full(len(kinds), len(codes), np.int64)
    at = np.arange(len(codes) - 1, -1, -1)
    first[codes[::-1]] = at
    other = span_hash(cp, starts, ends, 1)
    if not np.array_equal(other, other[first][codes]):  # two contents under one 64-bit hash
        both = np.stack([codes.astype(np.uint64), other], 1)
        _, first, codes = np.unique(both, axis=0, return_index=True, return_inverse=True)
        codes = codes.reshape(-1)
    return (codes, first, one[first], other[first]) if hashes else (codes, first)


def take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the given rows, end to end, and their offsets."""
    size = (offsets[1:] - offsets[:-1])[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    at = np.arange(ends[-1], dtype=np.int64)
    at += np.repeat(offsets[:-1][rows] - ends[:-1], size)
    return flat[at], ends
