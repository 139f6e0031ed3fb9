"""PartEnum signatures of sets of 64-bit hashes, the rarer ones first.

Two sets of sizes a and b with similarity g or more differ in at most H = (a + b)(1 - g)/(1 + g)
elements. A *band* covers a range of a + b, and so bounds H by k. In a band the hashed domain is cut
into n1 parts of n2 cells each, and a part's signatures are what its subsets of n2 - k2 cells hold:
a part with k2 spoiled cells or fewer still has one whole subset, so a differing element has to be
spent k2 + 1 times on a part before it shares nothing. Each band has its own n1, n2 and k2: sets
that must be equal (k = 0) have one cell, all others parts of three cells with subsets of two.

Not all signatures need to be sent. With all of them in one global order, take a set's first ones,
up to where hiding every one of them from a similar set would cost more than k elements: one for a
part of which some are taken, k2 + 1 (or its filled cells, if fewer) for one of which all are. So
either of two similar sets takes one that the other has too, and both take the smallest that they
share. The order puts signatures that many sets have last, then those that hold an empty cell; so
common passages are not sent by sets that have enough besides. Which signatures count as common
changes the work and never the result.

A set whose signatures can all be hidden by k elements sends them all and goes on with another cut
of the domain (another seed), until it has enough; two similar sets meet at the first cut at which
one of them has.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, count

import numpy as np

from lagwise.llm.textbytes import U, mix

#: Ratio of the ends of a band; parts for each that must be hidden.
BAND, SPREAD = 2.5, 1.5
#: Cells of a part and spoiled ones that it stands, where sets may differ.
CELLS, SPOILED = 3, 1
_GOLD, _ODD, _FLIP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A5A5A5A5A5A5A5
_ALL = (1 << 64) - 1


class Bands:
    """Ends of the bands of a + b for a similarity."""

    def __init__(self, similarity: Fraction):
        self.g = similarity
        self.c = (1 - similarity) / (1 + similarity)
        end = max(1, int(1 / self.c) if self.c else 1 << 62)
        ends = [end]
        while ends[-1] < 1 << 40:
            ends.append(int(ends[-1] * BAND) + 1)
        self.ends = np.array(ends, np.int64)

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """(rows, k, n1, n2, k2): each set is in every band where it may have a partner, once."""
        p, q = self.g.numerator, self.g.denominator
        low, high = sizes + -(-sizes * p // q), sizes + sizes * q // p
        first, last = np.searchsorted(self.ends, low), np.searchsorted(self.ends, high)
        out = []
        for step in range(int((last - first).max(initial=-1)) + 1):
            rows = np.flatnonzero((first + step <= last) & (sizes > 0))
            end = self.ends[first[rows] + step]
            most = end * self.c.numerator // self.c.denominator
            k = np.minimum(end, high[rows]) * self.c.numerator // self.c.denominator
            for some, n2, k2 in ((most == 0, 1, 0), (most > 0, CELLS, SPOILED)):
                if some.any():
                    out.append((rows[some], k[some], np.ceil(SPREAD * (most[some] // (k2 + 1) + 1)).astype(np.int64) if n2 > 1 else np.ones(int(some.sum()), np.int64), n2, k2))
        return out


class Parts:
    """The filled parts of some rows under one cut: their rows, filled cells and signatures (0 where all cells are empty)."""

    def __init__(self, sets: np.ndarray, at: np.ndarray, rows: np.ndarray, n1: np.ndarray, n2: int, k2: int, seed: int):
        size = at[rows + 1] - at[rows]
        begin = np.concatenate(([0], np.cumsum(size)))
        x = sets[np.arange(begin[-1]) + np.repeat(at[rows] - begin[:-1], size)]
        row = np.repeat(np.arange(len(rows)), size)
        if seed:
            x = mix(x + U(seed * _GOLD & _ALL))
        cell = (((x >> U(32)) * np.repeat(n1 * n2, size).astype(U)) >> U(32)).astype(np.int64)
        if seed:
            order = np.lexsort((cell, row))
            x, row, cell = x[order], row[order], cell[order]
        heads = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])))) if len(x) else np.zeros(0, np.int64)
        held = np.add.reduceat(mix(x ^ U(_FLIP)), heads) if len(x) else x
        row, cell = row[heads], cell[heads]
        part, sub = cell // n2, cell % n2
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
        index = np.cumsum(new) - 1
        self.row, part = row[new], part[new]
        content = np.zeros((len(part), n2), U)
        content[index, sub] = held | U(1)
        self.filled = (content != 0).sum(1)
        own = mix(content + np.arange(1, n2 + 1, dtype=U) * U(_GOLD))
        self.name = mix(part.astype(U) * U(_ODD) + n1[self.row].astype(U) + U(seed << 48 & _ALL))
        sigs, half = [], []
        for s, cells in enumerate(combinations(range(n2), n2 - k2)):
            some = (content[:, cells] != 0).sum(1)
            sigs.append(np.where(some > 0, mix(own[:, cells].sum(1) + self.name + U(s * _GOLD & _ALL)) | U(1), U(0)))
            half.append(some < len(cells))
        self.sig = np.stack(sigs, 1)
        self.half = np.stack(half, 1)


class Signer:
    """common: ascending signatures that many sets have, and a level (1 to 255) for each."""

    def __init__(self, similarity: Fraction, common: tuple[np.ndarray, np.ndarray] | None):
        self.bands, self.common = Bands(similarity), common

    def ranks(self, parts: Parts) -> np.ndarray:
        """The global order in 40 bits: rare before common, full before half empty, then by part and value."""
        out = parts.half.astype(U) << U(31) | (parts.name >> U(39) << U(6))[:, None] | parts.sig >> U(58)
        if self.common is not None and len(self.common[0]):
            known, level = self.common
            i = np.minimum(np.searchsorted(known, parts.sig), len(known) - 1)
            out |= np.where(known[i] == parts.sig, level[i], 0).astype(U) << U(32)
        return out

    def first(self, parts: Parts, k: np.ndarray, k2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signatures to send, their rows, and which rows need another cut."""
        rank = np.where(parts.sig == 0, U(1 << 40), self.ranks(parts))
        order = np.argsort(rank, axis=1)
        rank, sig = np.take_along_axis(rank, order, 1), np.take_along_axis(parts.sig, order, 1)
        cost = np.zeros(rank.shape, np.int64)
        cost[:, 0] = 1
        n = (sig != 0).sum(1)
        cost[np.arange(len(n)), n - 1] += np.minimum(parts.filled, k2 + 1) - 1
        some = sig != 0
        row, rank, sig, cost = np.repeat(parts.row, n), rank[some], sig[some], cost[some]
        key = row.astype(U) << U(40) | rank
        order = np.argsort(key)
        key, row, sig = key[order], row[order], sig[order]
        heads = np.searchsorted(row, np.arange(len(k) + 1))
        spent = np.concatenate(([0], np.cumsum(cost[order])))
        enough = spent[1:] - spent[heads[:-1]][row] > k[row]
        last = heads[:-1] + np.bincount(row[~enough], minlength=len(k))
        again = last >= heads[1:]
        upto = np.where(again, U(_ALL), key[np.minimum(last, len(key) - 1)] if len(key) else U(0))
        keep = key <= upto[row]
        return sig[keep], row[keep], again

    def emit(self, sets: np.ndarray, at: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Signatures to send and the row of each; sets ascend in each row. every: all those of the first cut."""
        sigs, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for rows, k, n1, n2, k2 in self.bands.of(np.diff(at)):
            for seed in count():
                parts = Parts(sets, at, rows, n1, n2, k2, seed)
                if every:
                    some = parts.sig != 0
                    sig, row, again = parts.sig[some], np.repeat(parts.row, some.sum(1)), np.zeros(len(rows), bool)
                else:
                    sig, row, again = self.first(parts, k, k2)
                sigs.append(sig)
                owners.append(rows[row])
                rows, k, n1 = rows[again], k[again], n1[again]
                if not len(rows):
                    break
        return np.concatenate(sigs), np.concatenate(owners)
