"""Binned features, trees on them, and the search for a split in summed gradient histograms.

A histogram of a node holds, for every bin of every numeric feature and then for every category, the sums of gradients, of second
derivatives and of rows. Bin 0 is a missing value; it goes to the side where it gains more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Feature numbers of leaves and of splits by category.
LEAF, CATEGORY = -1, -2
# fixed values: smoothing and extra penalty of category splits, and how many categories one side may take
CATEGORY_SMOOTH, CATEGORY_L2, CATEGORY_MOST = 10.0, 10.0, 32


@dataclass(frozen=True)
class Params:
    """How one boosted model grows.

    growth: `leaf` splits the leaf that gains most until there are `leaves`; `level` splits all nodes of a level down to `depth`;
    `symmetric` has one split for all nodes of a level. loss: `squared`, or `absolute`, whose leaves are medians of residuals.
    """

    growth: str = "leaf"
    loss: str = "squared"
    trees: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 6
    least_rows: int = 1
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    category: bool = False
    bins: int = 255
    patience: int = 50


@dataclass
class Binning:
    """Upper edges of each feature's bins, and the number of categories."""

    names: list[str]
    edges: list[np.ndarray]
    categories: int = 0

    @property
    def width(self) -> int:
        """Bins of the widest feature, with the one for missing values."""
        return max((len(e) for e in self.edges), default=0) + 2

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(edges, x[:, f], "left") + 1)
        return out


@dataclass
class Split:
    gain: float
    feature: int  # index into all features, or CATEGORY
    bin: int  # rows with at most this bin go left
    missing_left: bool
    left_categories: list[int]
    left: tuple[float, float, float]  # sums of gradients, second derivatives and rows
    right: tuple[float, float, float]


@dataclass
class Tree:
    """Nodes by number; the root is 0. Values are without the learning rate."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    categories: list[list[int]] = field(default_factory=lambda: [[]])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, s: Split) -> tuple[int, int]:
        for _ in range(2):
            for values, new in ((self.feature, LEAF), (self.bin, 0), (self.missing_left, False), (self.categories, []), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                values.append(new)
        a = len(self.feature) - 2
        self.feature[node], self.bin[node], self.missing_left[node], self.categories[node] = s.feature, s.bin, s.missing_left, s.left_categories
        self.left[node], self.right[node], self.gain[node] = a, a + 1, s.gain
        return a, a + 1

    def leaves(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, limit, missing_left = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] != LEAF]
            at = node[rows]
            numeric = feature[at] >= 0
            b = bins[rows, np.where(numeric, feature[at], 0)]
            go = np.where(b == 0, missing_left[at], b <= limit[at])
            for n in np.unique(at[~numeric]):
                here = at == n
                go[here] = np.isin(category[rows[here]], self.categories[n])
            node[rows] = np.where(go, left[at], right[at])
        return node

    def values(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins, category)]


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g, h, p: Params, more_l2: float = 0.0):
    """How much a node with these sums lowers the loss, twice."""
    h = h + p.l2 + more_l2
    return np.divide(shrunk(g, p.l1) ** 2, h, out=np.zeros(np.broadcast(g, h).shape), where=h > 0)


def weight(g: float, h: float, p: Params) -> float:
    """The second-order value of a leaf."""
    h = h + p.l2
    return float(-shrunk(np.float64(g), p.l1) / h) if h > 0 else 0.0


def histogram(slot: np.ndarray, slots: int, bins: np.ndarray, category: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, categories: int) -> np.ndarray:
    """slots x 3 x (features * width + categories) sums of the rows, each in the node `slot`."""
    n, features = bins.shape
    numeric = features * width
    out = np.zeros((slots, 3, numeric + categories))
    flat = ((slot[:, None] * numeric) + np.arange(features) * width + bins).ravel()
    for j, x in enumerate((g, h, None)):
        sums = np.bincount(flat, None if x is None else np.repeat(x, features), slots * numeric)
        out[:, j, :numeric] = sums.reshape(slots, numeric)
        if categories:
            sums = np.bincount(slot * categories + category, x, slots * categories)
            out[:, j, numeric:] = sums.reshape(slots, categories)
    return out


def totals(h: np.ndarray, width: int) -> np.ndarray:
    """Sums of a node's histogram: those of its first feature."""
    return h[:, :width].sum(axis=1)


def _sides(hist: np.ndarray, features: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right sums, 3 x 2 x features x (width - 2): missing values right, then left."""
    x = hist[:, : features * width].reshape(3, features, width)
    below, missing = np.cumsum(x[:, :, 1:-1], axis=2), x[:, :, :1]
    left = np.stack([below, below + missing], axis=1)
    return left, x.sum(axis=2)[:, None, :, None] - left


def _allowed(left: np.ndarray, right: np.ndarray, p: Params) -> np.ndarray:
    return (np.minimum(left[2], right[2]) >= max(p.least_rows, 1)) & (np.minimum(left[1], right[1]) >= p.least_hessian)


def best_split(hist: np.ndarray, columns: Sequence[int], width: int, p: Params) -> Split | None:
    """The split of one node that gains most; of equal ones the first by feature and bin."""
    whole = totals(hist, width)
    before = score(whole[0], whole[1], p)
    left, right = _sides(hist, len(columns), width)
    gain = np.where(_allowed(left, right, p), score(left[0], left[1], p) + score(right[0], right[1], p) - before, -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    found = None
    if gain[at] > 1e-12:
        found = Split(float(gain[at]), int(columns[at[1]]), int(at[2]) + 1, bool(at[0]), [], tuple(left[(slice(None), *at)]), tuple(right[(slice(None), *at)]))
    by_category = _category_split(hist[:, len(columns) * width :], whole, float(before), p)
    return by_category if by_category and (found is None or by_category.gain > found.gain) else found


def _category_split(x: np.ndarray, whole: np.ndarray, before: float, p: Params) -> Split | None:
    """Categories in the order of their mean gradients: the best cut of that order, with few categories on one side."""
    there = np.flatnonzero(x[2] > 0)
    if len(there) < 2:
        return None
    order = there[np.argsort(x[0, there] / (x[1, there] + CATEGORY_SMOOTH), kind="stable")]
    best = None
    for side in (order, order[::-1]):
        few = side[: min(CATEGORY_MOST, len(side) - 1)]
        left = np.cumsum(x[:, few], axis=1)
        right = whole[:, None] - left
        gain = np.where(_allowed(left, right, p), score(left[0], left[1], p, CATEGORY_L2) + score(right[0], right[1], p, CATEGORY_L2) - before, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > max(1e-12, best.gain if best else 0.0):
            best = Split(float(gain[k]), CATEGORY, 0, False, sorted(int(c) for c in few[: k + 1]), tuple(left[:, k]), tuple(right[:, k]))
    return best


def best_shared_split(hists: np.ndarray, columns: Sequence[int], width: int, p: Params) -> list[Split] | None:
    """One split for all nodes of a level: its gain summed over the nodes; each node's own sums."""
    sides = [_sides(h, len(columns), width) for h in hists]
    gain = 0.0
    for h, (left, right) in zip(hists, sides, strict=True):
        whole = totals(h, width)
        gain = gain + score(left[0], left[1], p) + score(right[0], right[1], p) - score(whole[0], whole[1], p)
    rows = np.array([np.minimum(left[2], right[2]) > 0 for left, right in sides]).any(axis=0)  # it divides some node
    gain = np.where(rows, gain, -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[at] > 1e-12:
        return None
    pick = (slice(None), *at)
    return [Split(float(gain[at]), int(columns[at[1]]), int(at[2]) + 1, bool(at[0]), [], tuple(left[pick]), tuple(right[pick])) for left, right in sides]
