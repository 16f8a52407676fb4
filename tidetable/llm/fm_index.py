"""An FM-index over a shard of texts: suffixes of words, a wavelet matrix of the Burrows-Wheeler transform, sampled positions.

The shard is the sequence of its texts' words with a separator before, between and after them. Separators are all
different in the order of suffixes (by place), so no common prefix passes the end of a text.
"""

from __future__ import annotations

import numpy as np

#: Every so many places of the sequence have their position stored.
SAMPLE = 16
#: Sequence length at most: three places of the sequence fit in a sort key of 63 bits.
MOST = 1 << 21


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; symbol 0 is a separator. Prefix doubling: only groups that are still tied are sorted again."""
    n = len(symbols)
    if n > MOST:
        raise ValueError("the shard is too long")
    bits = np.int64(max(n, int(symbols.max(initial=0)) + 1).bit_length())
    mask = (np.int64(1) << bits) - 1
    key = np.sort(symbols.astype(np.int64) << bits | np.arange(n))
    order, symbol = key & mask, key >> bits
    new = symbol == 0
    new[:1] = True
    new[1:] |= symbol[1:] != symbol[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(slots):
        start = order[slots]
        key = np.sort(rank[start] << 2 * bits | rank[start + step] << bits | start)
        start, pair = key & mask, key >> bits
        order[slots] = start  # a group's rank is its first slot, so each group stays in its own slots
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[start] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class BitRank:
    """A bit vector with the number of ones before each place: words of 64 bits and a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """rank of any symbol and access to any place in one pass over the symbols' bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for level in range(max(symbols - 1, 1).bit_length() - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            self.levels.append((level, BitRank(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for level, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << level
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.begin[symbol]


class FmIndex:
    """The index of texts whose words are given as hashes, with the text (ascending) of each."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        place = np.arange(len(words)) + np.cumsum(new)  # one separator before each text
        n = len(words) + int(new.sum()) + 1
        sequence = np.zeros(n, np.int64)
        sequence[place] = symbol + 1
        self.word_at = np.zeros(n, np.int64)
        self.word_at[place] = np.arange(len(words))
        order = suffix_array(sequence)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=len(self.vocabulary) + 1))])
        self.transform = WaveletMatrix(sequence[order - 1], len(self.vocabulary) + 1)
        # a text's first word is sampled, so a walk to the left never meets a separator
        sampled = (order % SAMPLE == 0) | (sequence[order - 1] == 0)
        self.sampled, self.positions = BitRank(sampled), order[sampled]
        self.size = n

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word; 0 where no text has it."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def search(self, reversed_phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the rows (from, to) of suffixes that begin with each; from = to where there is none.

        reversed_phrases: a row of symbols each, last word first, filled up with -1; 0 is a word that no text has.
        """
        low, high = np.zeros(len(reversed_phrases), np.int64), np.full(len(reversed_phrases), self.size)
        high[(reversed_phrases == 0).any(1)] = 0
        for column in reversed_phrases.T:
            live = np.flatnonzero((low < high) & (column >= 0))
            if not len(live):
                continue
            symbol = column[live]
            ranks = self.transform.rank(np.tile(symbol, 2), np.concatenate([low[live], high[live]])) + np.tile(self.before[symbol], 2)
            low[live], high[live] = ranks[: len(live)], ranks[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The number (among all words given) of the word at which each row's suffix starts: walks left to a sampled position."""
        out, walking, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(walking):
            here = self.sampled.get(at)
            out[walking[here]] = self.positions[self.sampled.ones(at[here])] + steps
            walking, at = walking[~here], at[~here]
            symbol, rank = self.transform.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return self.word_at[out]
