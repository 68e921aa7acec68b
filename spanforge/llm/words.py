"""Words, hashes and common subsequences, shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_NOT_WORD = re.compile(r"[^\w\s]+|_+")
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")


def words_of(text: str) -> list[str]:
    """Words without regard to case, punctuation, white space and invisible characters.

    Punctuation is deleted, not replaced: ``a-b.`` and ``ab`` are the same word.
    """
    return _NOT_WORD.sub("", _INVISIBLE.sub("", text.lower()) if not text.isascii() else text.lower()).split()


class Hasher:
    """Stable 32-bit hashes of words with a bounded cache."""

    def __init__(self, bound: int = 1_000_000):
        self._seen: dict[str, int] = {}
        self._bound = bound

    def __call__(self, words: list[str]) -> list[int]:
        seen = self._seen
        if len(seen) > self._bound:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh32_intdigest(w) - 2**31
            out.append(h)
        return out


#: odd multipliers of the positions in a shingle
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_hashes(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` (at most five) consecutive word hashes; element i starts at word i."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    w = ids.astype(np.int64).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ (w[j : j + n] * _MULT[j])) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, 64 and more positions of ``a`` at a time (bit-parallel)."""
    if not a or not b:
        return 0
    at: dict[int, int] = {}
    bit = 1
    for x in a:
        at[x] = at.get(x, 0) | bit
        bit <<= 1
    full = bit - 1
    v = full
    get = at.get
    for x in b:
        m = get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
