"""Exact joins of sets by their Jaccard in numpy: what one task does with its tile, and a lookup among few sets that goes to all rows.

A set is a sorted array of the ranks of its tokens, rarest first. Of what shares a token of both prefixes, three bounds leave
little to be compared in full: the tokens left after the shared one, the sizes, and the bits in which hashes of all tokens differ.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

#: Rows of candidates that are formed at once, and those whose bits are compared at once: what fits caches.
MOST, BITS = 1_000_000, 1 << 14
EPS = 1e-9


class Sets:
    """Sets by their rows: id, n (size), and token ranks in one array, row after row."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, tokens: np.ndarray):
        self.id, self.n, self.tokens = ids, n.astype(np.int64), tokens
        self.at = np.r_[0, np.cumsum(self.n)]
        self._members: dict[int, frozenset] = {}

    def members(self, row: int) -> frozenset:
        if row not in self._members:
            self._members[row] = frozenset(self.tokens[self.at[row] : self.at[row + 1]].tolist())
        return self._members[row]

    def by_size(self) -> Sets:
        order = np.argsort(self.n, kind="stable")
        n = self.n[order]
        return Sets(self.id[order], n, self.tokens[np.repeat(self.at[order], n) + ramp(n)])

    def prefix(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, place and token of the tokens by which each set has to be looked up, if it shares at least that share of its own."""
        most = np.minimum(self.n, self.n - np.ceil(self.n * share - EPS).astype(np.int64) + 1)
        row, place = np.repeat(np.arange(len(self.n)), most), ramp(most)
        return row, place, self.tokens[self.at[row] + place]

    def bits(self, words: int) -> np.ndarray:
        """words * 64 bits a set, of which its tokens' hashes set one each."""
        h = (self.tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58 - int(math.log2(words)))
        out = np.zeros((len(self.n), words), np.uint64)
        np.bitwise_or.at(out, (np.repeat(np.arange(len(self.n)), self.n), (h >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
        return out


def ramp(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits rows i of a and j of b differ (words of 64 bits, eight or a multiple of it)."""
    out, low = np.zeros(len(i), np.uint64), np.uint64(0x00FF00FF00FF00FF)
    for at in range(0, len(i), BITS):
        part = slice(at, at + BITS)
        # counts of eight words are bytes of one: added in pairs, then all four by a product
        n = np.bitwise_count(a[i[part]] ^ b[j[part]]).view(np.uint64)
        n = (n & low) + (n >> np.uint64(8) & low)
        n = n * np.uint64(0x0001000100010001) >> np.uint64(48)
        for column in n.T:
            out[part] += column
    return out.astype(np.int64)


def pairs(a: Sets, b: Sets | None, t: float, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of a and of b and score of all pairs with a Jaccard of t or more; without b each pair within a once.

    ordered: no set of a is larger than one of b, so that fewer tokens of a do.
    """
    same = b is None
    if same:
        a = b = a.by_size()
    if not len(a.n) or not len(b.n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row_a, place_a, token_a = a.prefix(2 * t / (1 + t) if same or ordered else t)
    by_token = np.argsort(token_a, kind="stable")
    row_a, place_a, token_a = row_a[by_token], place_a[by_token], token_a[by_token]
    known, start, held = np.unique(token_a, return_index=True, return_counts=True)
    n_a, rest_a = a.n[row_a], a.n[row_a] - place_a
    row_b, place_b, token_b = b.prefix(t)
    at = np.minimum(np.searchsorted(known, token_b), len(known) - 1)
    found = np.flatnonzero(known[at] == token_b)
    row_b, at, rest_b = row_b[found], at[found], (b.n[row_b] - place_b)[found]
    many = held[at]
    words = 1 << max(3, min(5, math.ceil(math.log2(max(a.n.max(), b.n.max()) / 8))))
    bits_a = a.bits(words)
    bits_b = bits_a if same else b.bits(words)
    total, out, begin = np.cumsum(many), ([], [], []), 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - many[begin] + MOST, "right")))
        k = many[begin:end]
        post, i_b, rest = np.repeat(start[at[begin:end]], k) + ramp(k), np.repeat(row_b[begin:end], k), np.repeat(rest_b[begin:end], k)
        begin = end
        if same:
            kept = np.flatnonzero(row_a[post] < i_b)
            post, i_b, rest = post[kept], i_b[kept], rest[kept]
        # both share at least t / (1 + t) of their sizes' sum; of a pair's shared tokens the first has all others after it
        kept = np.flatnonzero(np.minimum(rest_a[post], rest) * (1 + t) >= t * (n_a[post] + b.n[i_b]) - EPS)
        i_a, i_b = row_a[post[kept]], i_b[kept]
        kept = np.flatnonzero(apart(bits_a, bits_b, i_a, i_b) * (1 + t) <= (1 - t) * (a.n[i_a] + b.n[i_b]) + EPS)
        for i, j in sorted(set(zip(i_a[kept].tolist(), i_b[kept].tolist()))):
            x, y = a.members(i), b.members(j)
            both = len(x & y)
            score = both / (len(x) + len(y) - both)
            if score >= t:
                for column, value in zip(out, (i, j, score)):
                    column.append(value)
    # a pair whose tokens were met in two rounds was found twice
    i, j, score = np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], float)
    _, once = np.unique(j * len(a.n) + i, return_index=True)
    return a.id[i[once]], b.id[j[once]], score[once]


class Lookup:
    """Sets of strings, asked whether one of them has a Jaccard of t or more with a set."""

    def __init__(self, sets: list[list[str]], t: float):
        self.t, self.sets = t, [frozenset(s) for s in sets if s]
        df = Counter(w for s in self.sets for w in s)
        self.rank = {w: i for i, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
        self.by: dict[str, list[int]] = {}
        for i, s in enumerate(self.sets):
            for w in sorted(s, key=self.rank.__getitem__)[: self.prefix(len(s))]:
                self.by.setdefault(w, []).append(i)

    def prefix(self, n: int) -> int:
        return n - math.ceil(n * self.t - EPS) + 1

    def holds(self, words: set[str]) -> bool:
        """Words that no set has are the rarest and come first, so most sets are settled by their number alone."""
        n, rank = len(words), self.rank
        known = [w for w in words if w in rank]
        most = self.prefix(n) - (n - len(known)) if known else 0
        if most <= 0:
            return False
        seen = set()
        for w in sorted(known, key=rank.__getitem__)[:most]:
            for i in self.by.get(w, ()):
                if i not in seen:
                    seen.add(i)
                    both = len(words & self.sets[i])
                    if both / (n + len(self.sets[i]) - both) >= self.t:
                        return True
        return False
