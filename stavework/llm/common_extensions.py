"""Longest common extensions of any two places of a number array, from a sorted difference cover.

Places whose remainder modulo `MODULUS` is in `COVER` are samples; for any two places there is a shift under MODULUS after which both
are samples. Only the suffixes at samples are sorted (by prefix doubling in steps of MODULUS), and the common prefixes of neighbours in
that order are kept in a sparse table of minima. An extension compares the few numbers before both places meet samples, then takes
one range minimum.
"""

from __future__ import annotations

import numpy as np

#: Every difference modulo 13 is one of two members of the cover.
MODULUS, COVER = 13, (0, 1, 3, 9)


def _shifts() -> np.ndarray:
    """For two remainders, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    return np.array([[next(s for s in range(MODULUS) if inside[a + s] and inside[b + s]) for b in range(MODULUS)] for a in range(MODULUS)])


_SHIFTS = _shifts()


def _dense(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Ranks 1, 2, ... of rows by keys (first key most significant); equal rows share one."""
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(changed)
    return out


class Extensions:
    """values: numbers from 1. No two equal suffixes may run to the end, so the last number must be unlike all others."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values = np.concatenate([values, np.zeros(2 * MODULUS, values.dtype)]).astype(np.int64)
        chains = [np.arange(c, n, MODULUS) for c in COVER]
        at = np.concatenate(chains)
        until = np.repeat(np.cumsum([len(c) for c in chains]), [len(c) for c in chains])
        self.index = np.full(n + MODULUS, -1, np.int32)
        self.index[at] = np.arange(len(at))
        bits = max(int(self.values.max(initial=1)).bit_length(), 1)
        width = max(62 // bits, 1)
        keys = []
        for a in range(0, MODULUS, width):
            key = np.zeros(len(at), np.int64)
            for t in range(a, min(a + width, MODULUS)):
                key = key << bits | self.values[at + t]
            keys.append(key)
        levels = [_dense(tuple(keys))]
        here = np.arange(len(at))
        while len(at) and levels[-1].max() < len(at):
            ahead = here + (1 << len(levels) - 1)
            inside = ahead < until
            following = np.zeros(len(at), np.int64)
            following[inside] = levels[-1][ahead[inside]]
            levels.append(_dense((levels[-1], following)))
        self.rank = (levels[-1] - 1).astype(np.int32)
        order = np.empty(len(at), np.int64)
        order[self.rank] = here
        self.minima = [self._neighbours(order, at, until, levels).astype(np.int32)]
        while (step := 1 << len(self.minima) - 1) * 2 <= len(self.minima[0]):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-step], low[step:]))

    def _neighbours(self, order: np.ndarray, at: np.ndarray, until: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of neighbours in the order of samples."""
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(len(order) - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            able = (a < until[order[:-1]]) & (b < until[order[1:]])
            same = np.zeros(len(a), bool)
            same[able] = levels[k][a[able]] == levels[k][b[able]]
            a[same] += 1 << k
            b[same] += 1 << k
            common[same] += MODULUS << k
        x, y = at[order[:-1]] + common, at[order[1:]] + common
        alive = np.ones(len(x), bool)
        for t in range(MODULUS):
            alive &= self.values[np.minimum(x + t, len(self.values) - 1)] == self.values[np.minimum(y + t, len(self.values) - 1)]
            common[alive] += 1
        return common

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on, for each pair of unlike places."""
        shift = _SHIFTS[i % MODULUS, j % MODULUS]
        out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(MODULUS):
            alive = alive[shift[alive] >= t]
            if not len(alive):
                break
            ready = shift[alive] == t
            self._from_samples(out, i, j, alive[ready], t)
            alive = alive[~ready]
            alive = alive[self.values[i[alive] + t] == self.values[j[alive] + t]]
            out[alive] += 1
        return out

    def _from_samples(self, out: np.ndarray, i: np.ndarray, j: np.ndarray, which: np.ndarray, t: int) -> None:
        if len(which):
            a, b = self.rank[self.index[i[which] + t]], self.rank[self.index[j[which] + t]]
            low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
            level = np.frexp(high - low)[1] - 1
            for k in np.unique(level):
                own = level == k
                out[which[own]] += np.minimum(self.minima[k][low[own]], self.minima[k][high[own] - (1 << k)])
