"""A small gradient-boosted regressor for support sets that fit on one machine.

Squared loss from the mean. A tree grows level by level; each node takes the best of the cuts that lie halfway between
neighbouring values of a feature (of a feature with more than ``BINS`` values, every so many), and of cuts that part its rows
alike the middle of their stretch. Leaves are RATE * sum(r) / (n + L2).

Targets are held as whole numbers, 2**30 for the largest, and so are leaf values and the terms of a split's gain. Sums of
whole numbers don't depend on their order, so a fit is the same to the last bit however the rows come, and SQL that states
the same steps gives the same trees. There is no random part. The settings are this library's own choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, RATE, DEPTH, MIN_LEAF, L2, BINS = 100, 0.1, 4, 2, 1.0, 64
ONE = float(1 << 30)


@dataclass
class Boosted:
    unit: float
    base: int
    #: (feature, cut) by node and (value) by leaf of each tree. Node k has the children 2 k and 2 k + 1; a node with feature -1
    #: leaves all its rows to the first.
    trees: list = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), float(self.base)), np.arange(len(x))
        for features, cuts, values in self.trees:
            out += values[_leaves(x, rows, features, cuts) - (1 << DEPTH)]
        return out * self.unit


def _leaves(x: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(DEPTH):
        j = features[node]
        node = 2 * node + ((x[rows, j] > cuts[node]) & (j >= 0))
    return node


def cuts_of(v: np.ndarray) -> np.ndarray:
    """Where a feature may be cut, ascending."""
    values = np.unique(v)
    n = min(len(values), BINS) - 1
    at = np.arange(1, n + 1) * len(values) // (n + 1)
    return (values[at - 1] + values[at]) / 2


def _term(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.floor(s * s / (n + L2) / ONE)


def unit_of(most: float) -> float:
    """What the whole numbers count, by the largest absolute target."""
    return float(most) / ONE or 1.0


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    unit = unit_of(np.abs(y).max())
    return fit_sums(x, np.floor(y / unit + 0.5), np.ones(len(x)), unit)


def fit_sums(x: np.ndarray, sums: np.ndarray, counts: np.ndarray, unit: float) -> Boosted:
    """A fit to rows that stand for ``counts`` equal ones each, whose targets in whole numbers of ``unit`` add up to ``sums``. The trees
    are those of the single rows: all that a tree asks of rows are such sums and counts."""
    n, d = x.shape
    model = Boosted(unit, int(np.floor(sums.sum() / counts.sum() + 0.5)))
    r = sums - counts * model.base
    cuts = [cuts_of(x[:, j]) for j in range(d)]
    place = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # cuts below the row's value
    # Rows between the same cuts go together through all trees.
    places, cell = np.unique(np.stack(place, 1).astype(np.uint8), axis=0, return_inverse=True)
    cell, n = cell.ravel(), len(places)
    r, counts, place = np.bincount(cell, r, n), np.bincount(cell, counts, n), places.T.astype(np.int64)
    for _ in range(TREES):
        node, features, at, after = np.ones(n, np.int64), np.full(1 << DEPTH, -1), np.zeros(1 << DEPTH), np.zeros(1 << DEPTH, np.int64)
        for level in range(DEPTH):
            first, size = 1 << level, 1 << level
            best = _term(np.bincount(node - first, r, size), np.bincount(node - first, counts, size))  # a node without a split, then its best so far
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, shape = (node - first) * (len(c) + 1) + place[j], (size, len(c) + 1)
                s, k = (np.bincount(key, w, size * shape[1]).reshape(shape) for w in (r, counts))
                # right of cut i are the rows with more than i cuts below them
                right_s, right_n = (np.cumsum(a[:, ::-1], 1)[:, ::-1][:, 1:] for a in (s, k))
                total_s, total_n = s.sum(1, keepdims=True), k.sum(1, keepdims=True)
                gain = _term(right_s, right_n) + _term(total_s - right_s, total_n - right_n)
                gain[(right_n < MIN_LEAF) | (total_n - right_n < MIN_LEAF)] = -1
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(size), top] > best).tolist():
                    alike = c[right_n[i] == right_n[i, top[i]]]
                    best[i], features[first + i], at[first + i], after[first + i] = gain[i, top[i]], j, (alike[0] + alike[-1]) / 2, top[i]
            j = features[node]
            node = 2 * node + ((places[np.arange(n), j] > after[node]) & (j >= 0))
        leaf = node - (1 << DEPTH)
        values = np.floor(RATE * np.bincount(leaf, r, 1 << DEPTH) / (np.bincount(leaf, counts, 1 << DEPTH) + L2) + 0.5)
        model.trees.append((features, at, values))
        r = r - counts * values[leaf]
    return model
