"""A compressed full-text index over integer words: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet matrix of integers 0 <= x < 2**bits: one bit vector for each bit, packed, with counts every 64 bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.zeros: list[int] = []
        self.packed: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        v = values.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = ((v >> np.uint32(b)) & np.uint32(1)).astype(bool)
            room = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            room[: self.n] = bit
            packed = np.packbits(room, bitorder="little").view("<u8")
            self.packed.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])
        symbols = np.arange(1 << bits if bits < 24 else 0, dtype=np.int64)
        self.start = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.packed[level][word] & below)
            one = (c >> (self.bits - 1 - level)) & 1
            i = np.where(one == 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i, for arrays of both."""
        return self._down(c, i) - self.start[c]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text, ordered by the depth symbols from each on, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth and rank.max(initial=0) < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] if width < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(step)
        width *= 2
    return order


class FMIndex:
    """Over texts of words (64-bit hashes), each with a weight: how many equal texts it stands for."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        names, coded = np.unique(words, return_inverse=True)
        sizes = np.diff(offsets)
        n = len(words) + len(sizes)
        text = np.zeros(n, np.int64)  # 0 ends each text
        at = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text[at] = coded.ravel() + 1
        self.text, self.starts, self.sizes = text, offsets[:-1] + np.arange(len(sizes)), sizes
        order = suffix_order(text, int(sizes.max(initial=0)) + 1)
        self.wavelet = Wavelet(text[order - 1], max(1, int(len(names)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(names) + 1))])
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def matching_statistics(self, which: np.ndarray, least: int, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, length) for each end from least on in the texts which: the longest run of words ending there
        that occurs at least times times in the index, by backward search of all ends at once."""
        ends_of = np.maximum(self.sizes[which] - least + 1, 0)
        text = np.repeat(which, ends_of)
        end = least + np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(ends_of)[:-1]]), ends_of) if len(text) else np.zeros(0, np.int64)
        length = np.zeros(len(text), np.int64)
        live = np.arange(len(text))
        lo, hi = np.zeros(len(text), np.int64), np.full(len(text), len(self.text), np.int64)
        place = self.starts[text] + end
        while len(live):
            inside = length[live] < end[live]
            live, lo, hi = live[inside], lo[inside], hi[inside]
            c = self.text[place[live] - 1 - length[live]]
            both = self.first[np.concatenate([c, c])] + self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = both[: len(c)], both[len(c) :]
            again = self.weight[hi] - self.weight[lo] >= times
            live, lo, hi = live[again], lo[again], hi[again]
            length[live] += 1
        return text, end, length
