"""Words of many texts at once: 64-bit word and window hashes by numpy, without a Python loop over words.

A word's hash is a polynomial of its bytes modulo 2**64, finished by a mixing step; a window's hash is a polynomial of
its words' hashes. Equal words have equal hashes wherever they stand. Two different words or windows collide with a
chance of about 2**-64; callers that must be exact verify what the hashes find.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F | 1
#: Bytes of one text that are hashed at a time.
PIECE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte classes: True where a byte belongs to a word.
ALNUM = np.ones(256, bool)  # digits, letters and every byte of a non-ASCII character
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False
SPACED = np.ones(256, bool)  # all but ASCII white space
SPACED[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _pow2(n: int) -> int:
    """At least a whole piece, so that one table serves all but longer words."""
    return 1 << max(PIECE.bit_length() - 1, int(n - 1).bit_length())


@dataclass
class Words:
    """hashes by word in text order; ``first[i]:first[i+1]`` are the words of text i; byte ranges in the joined bytes."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = True) -> Words:
    """Words of the texts whose joined UTF-8 bytes are ``raw``; A-Z count as a-z if ``fold``."""
    inside = member[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text's end ends its last word
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    begins = inside & (~before | edge[:-1])
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
    stops = inside & (~after | edge[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of whole words, so that memory follows PIECE and not the longest text
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        piece = raw[base : ends[to - 1]]
        piece = (_LOWER[piece] if fold else piece).astype(np.uint64) + np.uint64(1)
        up, down = _powers(_BASE, _pow2(len(piece)))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return Words(mix(hashes), np.searchsorted(starts, offsets), starts, ends)


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``size`` consecutive words of one text, and the index of each window's first word.

    A text of fewer words, but not none, has one window of all its words.
    """
    n = len(words.hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    factor = 1
    for k in range(size):
        total += words.hashes[k : k + len(total)] * np.uint64(factor)
        factor = factor * _WINDOW_BASE % (1 << 64)
    counts = np.diff(words.first)
    lasts = np.repeat(words.first[1:], counts)
    heads = np.flatnonzero(np.arange(n) + size <= lasts)
    out = [mix(total[heads] + np.uint64(size))]
    at = [heads]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for k in np.unique(counts[short]):
        first = words.first[short[counts[short] == k]]
        value, factor = np.zeros(len(first), np.uint64), 1
        for j in range(k):
            value += words.hashes[first + j] * np.uint64(factor)
            factor = factor * _WINDOW_BASE % (1 << 64)
        out.append(mix(value + np.uint64(k)))
        at.append(first)
    hashes, at = np.concatenate(out), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order]
