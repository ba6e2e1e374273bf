"""Character n-gram model with modified Kneser-Ney smoothing, in sorted arrays of hashed n-grams.

N-grams are of code points as they are, so what a corpus gives grows with it. Spark counts them by their exact code
points; a model holds 64-bit hashes of them (two of 2**32 n-grams in one model meet with a chance of about a half, and
then only share a probability).
"""

from __future__ import annotations

import numpy as np

ORDER, BITS = 5, 21
LOW = (1 << BITS) - 1
NARROW = 12  # code points below 2**NARROW: five fit in 60 bits
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, each after ORDER - 1 boundary zeros, and where each text begins."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    starts = np.cumsum([ORDER - 1, *(len(p) + ORDER - 1 for p in parts)])[:-1]
    out = np.zeros(sum(map(len, parts)) + (ORDER - 1) * len(parts), np.int64)
    for at, p in zip(starts.tolist(), parts, strict=True):
        out[at : at + len(p)] = p
    return out, starts


def inside(starts: np.ndarray, size: int) -> np.ndarray:
    """The places that belong to texts and not to the boundaries between them."""
    out = np.ones(size, bool)
    for k in range(1, ORDER):
        out[starts - k] = False
    return np.flatnonzero(out)


class Counts:
    """Counted n-grams: narrow ones as codes of 60 bits, others as pairs (first two code points, last three)."""

    def __init__(self):
        self.codes, self.pairs, self.n = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), [np.zeros(0, np.int64)] * 2

    def add(self, texts: list[str]) -> None:
        c, starts = code_points(texts)
        at = inside(starts, len(c))
        code, wide = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        is_wide = c >> NARROW > 0
        any_wide = bool(is_wide.any())
        for k in range(ORDER - 1, -1, -1):
            code <<= NARROW
            code |= c[at - k] & ((1 << NARROW) - 1)
            if any_wide:
                wide |= is_wide[at - k]
        self.codes, self.n[0] = _merged(self.codes, self.n[0], *np.unique(code[~wide] if any_wide else code, return_counts=True))
        if any_wide:
            at = at[wide]
            pairs = np.stack([c[at - 4] << BITS | c[at - 3], c[at - 2] << 2 * BITS | c[at - 1] << BITS | c[at]], 1)
            self.pairs, self.n[1] = _merged(self.pairs, self.n[1], *_distinct(pairs, np.ones(len(pairs), np.int64)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hi (the first two code points), lo (the last three) and n."""
        c = [self.codes >> NARROW * k & ((1 << NARROW) - 1) for k in range(ORDER - 1, -1, -1)]
        hi, lo = c[0] << BITS | c[1], c[2] << 2 * BITS | c[3] << BITS | c[4]
        return np.concatenate([hi, self.pairs[:, 0]]), np.concatenate([lo, self.pairs[:, 1]]), np.concatenate(self.n)


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (b, m) if not len(a) else _distinct(np.concatenate([a, b]), np.concatenate([n, m]))


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.lexsort((keys[:, 1], keys[:, 0])) if keys.ndim == 2 else np.argsort(keys)
    keys = keys[order]
    turns = (keys[1:] != keys[:-1]).any(1) if keys.ndim == 2 else keys[1:] != keys[:-1]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), turns]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+ at [1], [2], [3], from how many n-grams have the counts 1 to 4."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out[1:] = [min(max(d, 0.05), k) for k, d in zip((1, 2, 3), found, strict=True)]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX
    return h ^ h >> np.uint64(29)


class Table:
    """Values by sorted hashes, found by an index of the hashes' first bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        bits = max(1, len(hashes).bit_length())  # no larger than the hashes: each worker holds one
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 where there is none."""
        first = (q >> self.shift).astype(np.int64)
        at, end = self.index[first], self.index[first + 1]
        out = np.full(len(q), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, own = at[open_], end[open_], q[open_]
        while len(open_):
            hit = self.hashes[at] == own
            out[open_[hit]] = at[hit]
            left = ~hit & (at + 1 < end)
            open_, at, end, own = open_[left], at[left] + 1, end[left], own[left]
        return out


class Model:
    """Probabilities of n-grams by their hashes, and the weights of contexts for backing off.

    grams[o]: code points (n x o) and counts of the n-grams of order o: of order ORDER how often they stand in the texts,
    of the others how many different code points stand before them. d[o]: their discounts. A model of a block holds the
    n-grams of orders 3 and more whose two code points before the last fall in that block.
    """

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], d: dict[int, np.ndarray]):
        self.tables: list[Table] = []
        self.contexts: list[Table | None] = [None]
        self.floor = 1.0
        for o in range(1, ORDER + 1):
            c, n = grams[o]
            taken = d[o][np.minimum(n, 3)]
            context, at = np.unique(hashes(c[:, :-1]), return_inverse=True)
            total = np.bincount(at, n, len(context))
            gamma = np.bincount(at, taken, len(context)) / np.maximum(total, 1)
            if o == 1:
                self.floor = (gamma[0] if len(gamma) else 1.0) / (len(n) + 1)
                p = (n - taken) / max(1, total.sum()) + self.floor
            else:
                place = self.tables[-1].find(hashes(c[:, 1:]))
                p = (n - taken) / total[at] + gamma[at] * 2.0 ** self.tables[-1].values[place]
                self.contexts.append(Table(context, np.log2(np.maximum(gamma, 1e-12))))
            self.tables.append(Table(hashes(c), np.log2(p)))

    def log2p(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the code points at places of c, each after the ORDER - 1 before it."""
        c = c.astype(np.uint64)
        rolled = [c]  # of the last o code points at each place
        for o in range(1, ORDER):
            h = rolled[-1].copy()
            h[o:] += c[:-o] * POWERS[o]
            rolled.append(h)
        out, left = np.zeros(len(at), np.float32), np.arange(len(at))
        for o in range(ORDER, 0, -1):
            own = at[left]
            place = self.tables[o - 1].find(mixed(rolled[o - 1][own] + SEEDS[o]))
            hit = place >= 0
            out[left[hit]] += self.tables[o - 1].values[place[hit]]
            left = left[~hit]
            if not len(left):
                break
            if o == 1:
                out[left] += np.float32(np.log2(self.floor))
            else:
                context = self.contexts[o - 1]
                place = context.find(mixed(rolled[o - 2][at[left] - 1] + SEEDS[o - 1]))
                out[left] += np.where(place >= 0, context.values[place], 0)
        return out


POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(ORDER, BASE)])).astype(np.uint64)
SEEDS = np.arange(ORDER + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)


def hashes(c: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(len(c), np.uint64)
    for k in range(c.shape[1]):
        h = h * BASE + c[:, k].astype(np.uint64)
    return mixed(h + SEEDS[c.shape[1]])


def shorter(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their first code point, and how many different ones stood there."""
    if not len(c):
        return c[:, 1:], n
    order = np.lexsort(c[:, :0:-1].T)
    own = c[order, 1:]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
    return own[first], np.diff(np.append(first, len(own)))
