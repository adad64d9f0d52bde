"""Byte-pair merging over ragged numpy arrays, for many sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.ranks[at] == NONE
            first = np.unique(np.where(free, at, -1), return_index=True)[1]
            won = todo[first][free[first]]
            self.keys[slot[won]], self.ranks[slot[won]], self.merged[slot[won]] = keys[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no such pair) and merged symbol of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        out = self.merged[slot]
        open_ = np.flatnonzero((rank == NONE) & (self.ranks[slot] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            rank[open_[hit]], out[open_[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NONE)]
        return rank, out


def _pair_up(index: np.ndarray) -> np.ndarray:
    """Of sorted positions, every second one of each run of neighbours, from its left."""
    if not len(index):
        return index
    begins = np.r_[True, np.diff(index) != 1]
    run = np.maximum.accumulate(np.where(begins, np.arange(len(index)), 0))
    return index[(np.arange(len(index)) - run) % 2 == 0]


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable, monotone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence until it holds no known pair; returns symbols and lengths, in order.

    Each round finds the lowest pair rank of every live sequence and merges there, in all
    sequences at once, then closes the gaps; sequences without a pair leave. With
    ``monotone`` (a merged symbol takes part only in later ranks) all occurrences of that
    pair merge in one round. Otherwise a sequence merges all of them only if no pair that
    these merges bring up, on the way or in the end, ranks as low; else its leftmost alone.
    """
    n_words = len(lengths)
    out_symbols: list[np.ndarray] = []
    out_words: list[np.ndarray] = []
    word = np.repeat(np.arange(n_words, dtype=np.int64), lengths)
    sym = symbols.astype(np.int32)
    rank = np.full(len(sym), NONE, np.int32)
    new = np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], new[inside] = table.find(sym[inside], sym[inside + 1])
    while len(sym):
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[begin, len(sym)])
        low = np.minimum.reduceat(rank, begin)
        done = low == NONE
        if done.any():
            gone = np.repeat(done, size)
            out_symbols.append(sym[gone])
            out_words.append(word[gone])
            keep = ~gone
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            low, size = low[~done], size[~done]
            if not len(sym):
                break
        lowest = np.repeat(low, size)
        hits = np.flatnonzero(rank == lowest)
        at = _pair_up(hits)
        if not monotone:
            at = _exact_hits(at, sym, word, new, lowest, table)
        sym[at] = new[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        sym, word = sym[keep], word[keep]
        rank, new = rank[keep], new[keep]
        touched = np.zeros(len(sym), bool)
        touched[moved] = True
        touched[moved[moved > 0] - 1] = True
        again = np.flatnonzero(touched)
        rank[again] = NONE
        again = again[again < len(sym) - 1]
        again = again[word[again] == word[again + 1]]
        rank[again], new[again] = table.find(sym[again], sym[again + 1])
    if not out_symbols:
        return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
    words = np.concatenate(out_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(out_symbols)[order], np.bincount(words, minlength=n_words)


def _exact_hits(at: np.ndarray, sym: np.ndarray, word: np.ndarray, new: np.ndarray, lowest: np.ndarray, table: PairTable) -> np.ndarray:
    """Of the merges `at`, those that going one by one from the left would make first, too."""
    made = new[at]
    bad = np.zeros(len(at), bool)
    has_left = at > 0
    has_left[has_left] &= word[at[has_left] - 1] == word[at[has_left]]
    left = np.zeros(len(at), np.int32)
    left[has_left] = sym[at[has_left] - 1]
    joined = np.r_[False, (at[1:] - at[:-1]) == 2] if len(at) else np.zeros(0, bool)
    joined &= has_left
    left[joined] = made[np.flatnonzero(joined) - 1]  # what stands there once the one before is made
    i = np.flatnonzero(has_left)
    bad[i] |= table.find(left[i], made[i])[0] <= lowest[at[i]]
    has_right = at + 2 < len(sym)
    has_right[has_right] &= word[at[has_right] + 2] == word[at[has_right]]
    i = np.flatnonzero(has_right)
    bad[i] |= table.find(made[i], sym[at[i] + 2])[0] <= lowest[at[i]]
    if not bad.any():
        return at
    words = word[at]
    first = np.r_[True, words[1:] != words[:-1]]
    return at[first | ~np.isin(words, words[bad])]
