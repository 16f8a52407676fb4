"""Vectorised hashes of words and word shingles over many texts at once.

Words are runs of bytes other than space and tab to carriage return (0x09-0x0D), with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD)]))
    return _powers


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts in data (text i: bytes at[i] to at[i + 1]), and its text's number."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    edge = np.zeros(len(data), bool)  # where a text begins
    edge[at[:-1][at[:-1] < len(data)]] = True
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(inside)
    first = np.cumsum(begins)[place] - 1  # each byte's word
    offset = place - starts[first]
    terms = (_LOWER[data[place]].astype(np.uint64) + np.uint64(1)) * _power_table(int(offset.max()) + 1)[offset]
    heads = np.flatnonzero(offset == 0)
    sums = np.add.reduceat(terms, heads)
    return mix(sums), np.searchsorted(at, starts, "right") - 1


def shingle_hashes(words: np.ndarray, row: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of k words of a text, and its text's number; a text of fewer words (one at least) has its whole sequence as one."""
    if not len(words):
        return words, row
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : i + len(h)]
    whole = row[: len(h)] == row[k - 1 :] if len(h) else np.zeros(0, bool)
    out, of = mix(h[whole]), row[: len(h)][whole]
    texts, begin, count = np.unique(row, return_index=True, return_counts=True)
    short = np.flatnonzero(count < k)
    if len(short):
        more = []
        for b, c in zip(begin[short], count[short]):
            s = np.uint64(c)
            for w in words[b : b + c]:
                s = np.uint64((int(s) * int(_STEP) + int(w)) & (1 << 64) - 1)
            more.append(s)
        out = np.concatenate([out, mix(np.array(more, np.uint64) + np.uint64(1))])
        of = np.concatenate([of, texts[short]])
    return out, of


def distinct_shingles(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles ascending (as signed integers), all texts one after the other, and where each text's begin (with the end last)."""
    h, of = shingle_hashes(*word_hashes(data, at), k)
    h = h.view(np.int64)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(at)), "left")
