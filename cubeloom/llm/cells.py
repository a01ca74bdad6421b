"""Joins within one cell of a metric space: sets under the Jaccard distance, and their sketches under Hamming's."""

from __future__ import annotations

import numpy as np

from cubeloom.llm.shingles import overlaps


def sketch(s: np.ndarray) -> bytes:
    """The parities of the set's hash counts in n to 2n buckets (64 at least), as bits. Two sets' sketches differ in no more
    bits than the sets differ in members."""
    buckets = 1 << max(6, len(s).bit_length())
    odd = np.bincount((s >> np.uint64(40) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Which sketches may belong to sets that are close. Those of different widths are compared at the smaller one, to
    which the wider are folded (parities of halves add)."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes], percent: int):
        self.n, self.percent = sizes.astype(np.int64), percent
        self.width = np.array([len(x) for x in raw])
        self.words = {w: np.frombuffer(b"".join(x for x in raw if len(x) == w), np.uint64).reshape(-1, w // 8) for w in np.unique(self.width)}
        self.row = np.zeros(len(raw), np.int64)
        for w in self.words:
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))

    def folded(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(at), width // 8), np.uint64)
        for w in np.unique(self.width[at]):
            mine = self.width[at] == w
            out[mine] = np.bitwise_xor.reduce(self.words[w][self.row[at[mine]]].reshape(mine.sum(), w // width, width // 8), axis=1)
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A matrix: whether the sets a[i] and b[j] may be close."""
        out = np.zeros((len(a), len(b)), bool)
        for wa in np.unique(self.width[a]):
            for wb in np.unique(self.width[b]):
                i, j = np.flatnonzero(self.width[a] == wa), np.flatnonzero(self.width[b] == wb)
                na, nb = self.n[a[i]], self.n[b[j]]
                if 100 * min(na.max(), nb.max()) < self.percent * max(na.min(), nb.min()):
                    continue
                w = min(wa, wb)
                x, y = self.folded(a[i], w), self.folded(b[j], w)
                step = max(1, 2_000_000 // max(1, y.size))
                for k in range(0, len(i), step):
                    m = na[k : k + step, None]
                    differ = np.bitwise_count(x[k : k + step, None] ^ y[None]).sum(-1, dtype=np.int64)
                    fit = (100 * np.minimum(m, nb) >= self.percent * np.maximum(m, nb)) & ((100 + self.percent) * differ <= (100 - self.percent) * (m + nb))
                    out[i[k : k + step, None], j] = fit
        return out

    def clusters(self, whole: int = 512) -> list[np.ndarray]:
        """Groups of two or more that may hold close pairs; none of these pairs is outside a group."""
        left, found = np.argsort(self.n, kind="stable"), []
        if len(left) <= whole:
            matrix = self.near(left, left)
            live = matrix.sum(1) > 1
            left, matrix = left[live], matrix[live][:, live]
            free = np.ones(len(left), bool)
            for k in range(len(left)):
                if free[k]:
                    mine, edge = np.zeros(len(left), bool), np.zeros(len(left), bool)
                    edge[k] = True
                    while edge.any():
                        mine |= edge
                        edge = matrix[edge].any(0) & ~mine
                    free &= ~mine
                    found.append(left[mine])
            return found
        while len(left):
            group, edge, left = [left[:1]], [left[:1]], left[1:]
            while edge and len(left):
                now = edge.pop()
                n = self.n[left]
                low, high = np.searchsorted(100 * n, self.percent * self.n[now].min()), np.searchsorted(self.percent * n, 100 * self.n[now].max(), side="right")
                hit = np.zeros(len(left), bool)
                hit[low:high] = self.near(now, left[low:high]).any(0)
                if hit.any():
                    group.append(left[hit])
                    edge += [left[hit][k : k + 64] for k in range(0, hit.sum(), 64)]
                    left = left[~hit]
            if len(group) > 1:
                found.append(np.concatenate(group))
        return found


class Groups:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = i = self.of[self.of[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.of[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.root(int(i)) for i in at], np.int64)


class Cell:
    """An exact join of sets (sorted hashes, none empty) by recursion over Voronoi regions.

    Pivots are drawn from the sets, each the farthest from those before. Every set goes to the region of its nearest pivot
    and, as it may be close to a set there, to each region whose pivot is no more than twice the reach farther (triangle
    inequality). Sets far from all pivots have a region of their own, which takes those within reach of that border.
    Regions recur; where they no longer part the sets, and in small ones, sets are compared directly: only such as are
    not linked already, and by what they have apart from a pivot's set, as differences keep their size.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, small: int = 24, pivots: int = 6):
        self.sets, self.percent, self.small, self.pivots = sets, percent, small, pivots
        self.n = np.array([len(s) for s in sets], np.int64)
        self.groups = Groups(len(sets))

    def shares(self, pivot: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intersections and unions of a pivot with the sets ``at``, linked where they are close."""
        flat = np.concatenate([self.sets[i] for i in at])
        inter = overlaps(self.sets[pivot], flat, np.concatenate([[0], np.cumsum(self.n[at])]))
        union = self.n[pivot] + self.n[at] - inter
        for i in at[100 * inter >= self.percent * union]:
            self.groups.join(pivot, int(i))
        return inter, union

    def solve(self) -> np.ndarray:
        """The group of each set: the number of a set in it."""
        reach = 1 - self.percent / 100 + 1e-9
        stack = [np.arange(len(self.sets))]
        while stack:
            at = stack.pop()
            if len(at) <= self.small:
                self._each(at)
                continue
            apart, p = [], int(at[0])
            for _ in range(self.pivots):
                inter, union = self.shares(p, at)
                apart.append(1 - inter / union)
                p = int(at[np.min(apart, axis=0).argmax()])
            apart = np.array(apart)
            nearest, border = apart.min(0), 1 - 2 * reach
            parts = [at[(a <= nearest + 2 * reach) & (nearest <= border)] for a in apart] + [at[nearest > border - reach]]
            parts = [x for x in parts if len(x) > 1]
            if any(10 * len(x) > 8 * len(at) for x in parts) or sum(map(len, parts)) > 2 * len(at):
                self._differences(at, int(at[0]), 1 - apart[0])
            else:
                stack += parts
        return self.groups.roots(np.arange(len(self.sets)))

    def _each(self, at: np.ndarray) -> None:
        for k in range(len(at) - 1):
            i, rest = int(at[k]), at[k + 1 :]
            low, high = np.minimum(self.n[i], self.n[rest]), np.maximum(self.n[i], self.n[rest])
            rest = rest[(100 * low >= self.percent * high) & (self.groups.roots(rest) != self.groups.root(i))]
            if len(rest):
                self.shares(i, rest)

    def _differences(self, at: np.ndarray, pivot: int, alike: np.ndarray) -> None:
        """Compares every set that is not in the largest group so far with all, by postings of differences."""
        roots = self.groups.roots(at)
        names, counts = np.unique(roots, return_counts=True)
        open_ones = np.flatnonzero(roots != names[counts.argmax()])
        if not len(open_ones):
            return
        base = self.sets[pivot] if np.median(alike) > 0.5 else self.sets[pivot][:0]
        parts = [np.setxor1d(self.sets[i], base, assume_unique=True) for i in at]
        size = np.array([len(x) for x in parts])
        _, term = np.unique(np.concatenate(parts), return_inverse=True)
        doc = np.repeat(np.arange(len(at)), size)
        starts = np.concatenate([[0], np.cumsum(size)])
        by = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by], np.arange(int(term.max(initial=-1)) + 2))
        doc = doc[by]
        n = self.n[at]
        for k in open_ones:
            t = term[starts[k] : starts[k + 1]]
            low, many = first[t], first[t + 1] - first[t]
            places = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(t) else np.zeros(0, np.int64)
            both = np.bincount(doc[places], minlength=len(at))
            differ = size[k] + size - 2 * both
            close = (n[k] + n - differ) * 100 >= self.percent * (n[k] + n + differ)
            for j in np.flatnonzero(close):
                self.groups.join(int(at[k]), int(at[j]))
