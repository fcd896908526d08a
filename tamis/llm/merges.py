"""Byte-pair merging of many words at once, in numpy.

All words lie one after the other in one flat symbol array. A round looks up the rank of neighbouring pairs, takes the smallest
rank of each word (a segmented minimum), merges there and compacts the array; a word without a pair leaves. Only pairs next to
a merge are ranked anew.

A merge is made at all leftmost places of a word at once when whatever can be built from the merged symbol ranks after it;
else only the leftmost place is taken, since a new pair may then come first.
"""

from __future__ import annotations

import numpy as np

from tamis.llm.flat import gather

NO_RANK = np.iinfo(np.int32).max


class Lookup:
    """A fixed map of distinct 64-bit keys to 32-bit values, probed for whole arrays. Most look-ups end at the first probe."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask, self.shift, self.missing = np.int64((1 << bits) - 1), np.uint64(64 - bits), np.int32(missing)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, missing, np.int32)
        self.full = np.zeros(1 << bits, bool)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = np.flatnonzero(~self.full[at])
            spot, who = np.unique(at[free], return_index=True)
            chosen = left[free[who]]
            self.key[spot], self.value[spot], self.full[spot] = keys[chosen], values[chosen], True
            rest = np.ones(len(left), bool)
            rest[free[who]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        same = self.key[at] == keys
        out = np.where(same & self.full[at], self.value[at], self.missing)
        rest = np.flatnonzero(~same & self.full[at])
        while len(rest):
            at[rest] = spot = (at[rest] + 1) & self.mask
            same, full = self.key[spot] == keys[rest], self.full[spot]
            hit = same & full
            out[rest[hit]] = self.value[spot[hit]]
            rest = rest[~same & full]
        return out


class Merges:
    """Pairs (left << 32 | right) with their ranks; `by_rank` gives the symbol that a rank makes. Symbols >= size never merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, by_rank: np.ndarray, size: int):
        self.by_rank = by_rank
        least = np.full(size, NO_RANK, np.int64)
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(least, side, ranks)
        self.safe = least[by_rank] > np.arange(len(by_rank))
        self.ranks = Lookup(keys, ranks, NO_RANK)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the pair doesn't merge."""
        return self.ranks(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words (each of one symbol at least) until no pair is left: (symbols, lengths)."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # symbols, lengths, numbers of the words
        word = np.arange(len(lengths))
        starts = np.cumsum(lengths) - lengths
        # ranks[i] is of the pair (i, i + 1); the last symbol of a word has none
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), np.int32(NO_RANK))[:len(symbols)]
        ranks[starts + lengths - 1] = NO_RANK
        while len(lengths):
            least = np.minimum.reduceat(ranks, starts)
            over = least == NO_RANK
            if over.any():
                leaves = np.repeat(over, lengths)
                done.append((symbols[leaves], lengths[over], word[over]))
                symbols, ranks = symbols[~leaves], ranks[~leaves]
                lengths, word, least = lengths[~over], word[~over], least[~over]
                starts = np.cumsum(lengths) - lengths
                if not len(lengths):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            owner = np.searchsorted(starts, at, "right") - 1
            first = np.append(True, owner[1:] != owner[:-1])
            if len(at) > len(lengths):  # several places in a word: of overlapping ones every second, from the left
                head = first | np.append(True, at[1:] != at[:-1] + 1)
                run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                take = ((np.arange(len(at)) - run) % 2 == 0) & (first | self.safe[ranks[at]])
                at, owner = at[take], owner[take]
            symbols[at] = self.by_rank[ranks[at]]
            last = starts[owner] + lengths[owner] - 1 == at + 1
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            spot = at - np.arange(len(at))
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            starts = np.cumsum(lengths) - lengths
            begins = spot == starts[owner]
            ranks[spot[last]] = NO_RANK
            go, back = spot[~last], spot[~begins] - 1
            new = self.rank(np.concatenate((symbols[go], symbols[back])), np.concatenate((symbols[go + 1], symbols[back + 1])))
            ranks[go], ranks[back] = new[:len(go)], new[len(go):]
        if not done:
            return symbols[:0], lengths[:0]
        number = np.concatenate([d[2] for d in done])
        flat, lengths = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(number)
        return gather(flat, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]
