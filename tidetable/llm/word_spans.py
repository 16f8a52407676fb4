"""Words of a byte class over many texts at once: a hash of each, its text and its place."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .word_hash import mix

_ODD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes are in one of the ranges (both ends inclusive). Bytes from 0x80 on are parts of longer characters."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


@dataclass(frozen=True)
class Words:
    """hash: 64 bits of each word with A-Z in lower case; row: its text; start, end: its bytes in the data."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)


def find_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes in the class `inside` of the texts in data (text i: bytes at[i] to at[i + 1]).

    Words are told apart by their hashes: that two different words of a text collection of n distinct ones share one has a
    chance of n * n / 2^65.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(none.view(np.uint64), none, none, none)
    member = np.empty(len(data) + 1, bool)
    member[-1] = False
    np.take(inside, data, out=member[:-1])
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[at] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(none.view(np.uint64), none, none, none)
    ends = np.flatnonzero(member[:-1] & (~member[1:] | edge[1:])) + 1
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.flatnonzero(member)
    offset = np.arange(len(place)) - np.repeat(first[:-1], size)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), _ODD)]))
    terms = (LOWER[data[place]].astype(np.uint64) + np.uint64(1)) * powers[offset]
    return Words(mix(np.add.reduceat(terms, first[:-1])), np.searchsorted(at, starts, "right") - 1, starts, ends)
