"""A trie over globally ordered n-gram sets, probed with one set at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def needed(a: int, b: np.ndarray | int, num: int, den: int):
    """Smallest overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -((-num * (a + b)) // (num + den))


class PrefixTrie:
    """Sets (sorted arrays, one global order) laid out depth first; neighbours share their common prefix.

    A depth-first walk of the trie visits the sets in lexicographic order, and ``shared[i]`` is the depth at which the
    path of set i leaves that of set i - 1. Each probe keeps the overlaps along the current path, so that a set goes on
    from the node where it branches off. A node whose overlap can't reach the need with what remains of the probe, and
    of the longest set below it, ends the walk of its whole subtree.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes() if not len(sets[i]) else sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.shared = np.zeros(len(sets), dtype=np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            self.shared[i] = at if n and differ[at] else n

    def probe(self, x: np.ndarray, num: int, den: int, skip: Callable[[int], bool] = lambda i: False) -> Iterator[tuple[int, int]]:
        """(index as given to the constructor, overlap) of each stored set with den * overlap >= num * union; ``skip(i)`` leaves set i out."""
        n = len(x)
        if not n:
            return
        need = needed(n, self.sizes, num, den)
        fits = (np.minimum(self.sizes, n) * den >= np.maximum(self.sizes, n) * num) & (self.sizes > 0)
        least = int(need[fits].min()) if fits.any() else 0
        sums = np.zeros(1, dtype=np.int64)  # overlaps along the path as far as it was walked
        dead = -1  # depth of a node known to be hopeless for all sets below it
        depth = 0  # how far the current path is shared with the one that was walked last
        for i in range(len(self.sets)):
            depth = min(depth, int(self.shared[i])) if i else 0
            if 0 <= dead <= depth:
                continue
            dead = -1
            if not fits[i] or skip(self.order[i]):
                continue
            s = self.sets[i]
            tail = s[depth:]
            at = np.searchsorted(x, tail)
            hit = x[np.minimum(at, n - 1)] == tail
            sums = np.concatenate((sums[: depth + 1], sums[depth] + np.cumsum(hit)))
            # what a node at each depth can still gain: the rest of the probe after its token
            left = n - np.minimum(at + hit, n)
            hopeless = sums[depth + 1 :] + left < least
            if hopeless.any():
                dead = depth + 1 + int(hopeless.argmax())
                sums = sums[: dead + 1]
                depth = dead
                continue
            depth = len(s)
            if sums[-1] >= need[i]:
                yield self.order[i], int(sums[-1])
