"""Regression trees on binned columns: histograms, splits and evaluation in NumPy.

A row is a byte per column, its bin; ``edges[column, bin]`` is the upper end of a bin.  A level of a tree is grown from
the sums of weight and weighted target per node, column and bin.  Sums of parts of the rows add up, so the same
functions serve rows of one task and of many.  Everything drawn (rows, columns, cut points) is a hash of seed, tree and
row, column or node, so it does not depend on how rows are dealt.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# Ship what this module holds with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Cells (node, column, bin) and rows that are worked on at once.
CELLS, ROWS = 1 << 18, 1 << 15


@dataclass(frozen=True)
class Spec:
    """What is grown.  ``combine``: the trees are added up, each fitted to what those before leave (``sum``), averaged
    (``mean``), or reweight the rows and vote by weighted median (``median``, AdaBoost.R2)."""

    combine: str
    rounds: int
    depth: int
    rate: float = 1.0
    min_rows: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    bootstrap: bool = False
    random_cuts: bool = False
    seed: int = 42


def draws(seed: int, *keys) -> np.ndarray:
    """Numbers in [0, 1) by hashes of keys (whole numbers or arrays of them)."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed)
        for key in keys:
            x = (x ^ np.asarray(key).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


#: Chances of at most 0, 1, 2, ... draws of a row in a bootstrap of a large sample.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def row_weights(spec: Spec, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often each row takes part in a tree."""
    if spec.bootstrap:
        return np.searchsorted(POISSON, draws(spec.seed, 1, tree, ids), side="right").astype(float)
    if spec.row_share < 1:
        return (draws(spec.seed, 1, tree, ids) < spec.row_share).astype(float)
    return np.ones(len(ids))


def columns(spec: Spec, tree: int, many: int) -> np.ndarray:
    """The columns offered to a tree."""
    if spec.column_share >= 1:
        return np.arange(many)
    order = np.argsort(draws(spec.seed, 2, tree, np.arange(many)), kind="stable")
    return np.sort(order[: max(1, int(np.ceil(spec.column_share * many)))])


def sums(bins: np.ndarray, slot: np.ndarray, weight: np.ndarray, target: np.ndarray, taken: np.ndarray, slots: int):
    """(weights, weighted targets), each slots x columns x bins, of rows in the histogram ``slot``."""
    size = len(taken) * BINS
    out = np.zeros((2, slots * size))
    step = np.arange(len(taken)) * BINS
    whole = len(taken) == bins.shape[1]
    plain = bool(len(weight)) and weight.min() == weight.max() == 1
    for a in range(0, len(slot), ROWS):
        part = bins[a : a + ROWS] if whole else bins[a : a + ROWS, taken]
        at = (part + (slot[a : a + ROWS, None] * size + step)).ravel()
        w, t = weight[a : a + ROWS], (weight * target)[a : a + ROWS] if not plain else target[a : a + ROWS]
        out[0] += np.bincount(at, None if plain else np.repeat(w, len(taken)), slots * size)
        out[1] += np.bincount(at, np.repeat(t, len(taken)), slots * size)
    return out.reshape(2, slots, len(taken), BINS)


@dataclass
class Splits:
    """Per node: the best column and bin (rows up to it go left), and the left side's weight and target."""

    found: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    weight: np.ndarray
    total: np.ndarray


def best_splits(h: np.ndarray, spec: Spec, tree: int, nodes: np.ndarray, taken: np.ndarray, edges: np.ndarray) -> Splits:
    """The split of each node that lessens the squared error most; ties to the first column and bin."""
    parts = []
    step = max(1, CELLS // (len(taken) * BINS))
    for a in range(0, len(nodes), step):
        parts.append(_best(h[:, a : a + step], spec, tree, nodes[a : a + step], taken, edges))
    return Splits(*(np.concatenate(x) for x in zip(*parts)))


def _best(h, spec, tree, nodes, taken, edges):
    weight, total = h[:, :, 0].sum(axis=2)
    left_w, left_t = np.cumsum(h, axis=3)
    place = None
    if spec.random_cuts:
        # One cut per node and column, drawn between the least and the largest value there.
        there = h[0] > 0
        low, high = there.argmax(axis=2), BINS - 1 - there[:, :, ::-1].argmax(axis=2)
        ends = edges[taken]
        at = np.arange(len(taken))
        u = draws(spec.seed, 3, tree, nodes[:, None], taken[None, :])
        value = ends[at, low] + u * (ends[at, high] - ends[at, low])
        place = np.clip((ends[None] <= value[:, :, None]).sum(axis=2) - 1, low, np.maximum(high - 1, low))[:, :, None]
        left_w, left_t = (np.take_along_axis(x, place, 2) for x in (left_w, left_t))
    else:
        left_w, left_t = left_w[:, :, :-1], left_t[:, :, :-1]
    w, t = weight[:, None, None], total[:, None, None]
    right_w = w - left_w
    least = max(spec.min_rows, 1e-12)
    fits = (left_w >= least) & (right_w >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_t * left_t / left_w + (t - left_t) ** 2 / right_w, -np.inf).reshape(len(nodes), -1)
    # The first of equals, whatever the order in which their sums were added up.
    top = gain.max(axis=1, keepdims=True)
    best = (gain >= top - 1e-10 * np.where(np.isfinite(top), np.abs(top), 0)).argmax(axis=1)
    row, wide = np.arange(len(nodes)), left_w.shape[2]
    before = total * total / np.maximum(weight, 1e-300)
    found = gain[row, best] > before + 1e-12 * np.abs(before) + 1e-12
    column, bin_ = best // wide, best % wide
    cut = bin_ if place is None else place[row, column, 0]
    return found, taken[column], cut, left_w[row, column, bin_], left_t[row, column, bin_]


class Tree:
    """Nodes in arrays; a column of -1 is a leaf, the right child follows the left one."""

    def __init__(self, column, cut, left, value) -> None:
        self.column, self.cut, self.left, self.value = column, cut, left, value

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int32)
        if self.column[0] < 0:
            return node
        at = np.arange(len(bins))
        while len(at):
            here = node[at]
            node[at] = self.left[here] + (bins[at, self.column[here]] > self.cut[here])
            at = at[self.column[node[at]] >= 0]
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


class Growth:
    """A tree that grows level by level; its splits come from the histograms of the active nodes."""

    def __init__(self, spec: Spec, number: int, weight: float, total: float) -> None:
        self.spec, self.number, self.level = spec, number, 0
        self.column, self.cut, self.left = (np.full(1, v, np.int32) for v in (-1, 0, -1))
        self.weight, self.total = np.array([weight]), np.array([total])
        self.active = np.zeros(1 if spec.depth and weight >= 2 * spec.min_rows and weight > 0 else 0, np.int32)

    def advance(self, s: Splits):
        """Split the active nodes.  Returns, for those with a child that may split again, their positions, their
        children of less and of more weight, and which of these are active next.  Only the lesser children's
        histograms are summed up; the others are what is left of their parents'."""
        ok = np.flatnonzero(s.found)
        parents, first = self.active[ok], len(self.column)
        left = (first + 2 * np.arange(len(ok))).astype(np.int32)
        self.column[parents], self.cut[parents], self.left[parents] = s.column[ok], s.cut[ok], left
        sides = []
        for mine, part in ((self.weight, s.weight[ok]), (self.total, s.total[ok])):
            sides.append(np.stack((part, mine[parents] - part), axis=1))
        self.weight, self.total = (np.concatenate((x, y.ravel())) for x, y in zip((self.weight, self.total), sides))
        more = np.full(2 * len(ok), -1, np.int32)
        self.column, self.cut, self.left = (np.concatenate((x, more)) for x in (self.column, self.cut, self.left))
        self.level += 1
        least = 2 * self.spec.min_rows if self.level < self.spec.depth else np.inf
        small_right = (sides[0][:, 1] < sides[0][:, 0]).astype(np.int32)
        small, large = left + small_right, left + 1 - small_right
        keep = [self.weight[x] >= least for x in (small, large)]
        pair = keep[0] | keep[1]
        small, large, keep = small[pair], large[pair], [k[pair] for k in keep]
        self.active = np.concatenate((small[keep[0]], large[keep[1]]))
        return ok[pair], small, large, keep

    def tree(self) -> Tree:
        value = self.total / np.maximum(self.weight, 1e-300)
        return Tree(self.column.astype(np.int16), self.cut.astype(np.uint8), self.left, value)


def children(before: np.ndarray, parents: np.ndarray, lesser: np.ndarray, keep) -> np.ndarray:
    """Histograms of the next active nodes from those of the level before and of the lesser children."""
    rest = before[:, parents[keep[1]]]
    rest -= lesser[:, keep[1]]
    return np.concatenate((lesser[:, keep[0]], rest), axis=1)


def grow(bins, weight, target, spec: Spec, number: int, edges: np.ndarray) -> Tree:
    """One tree on rows of one task."""
    taken = columns(spec, number, bins.shape[1])
    rows = np.flatnonzero(weight > 0)
    if len(rows) < len(bins):
        bins, weight, target = bins[rows], weight[rows], target[rows]
    g = Growth(spec, number, float(weight.sum()), float((weight * target).sum()))
    node, at = np.zeros(len(bins), np.int32), np.arange(len(bins))
    h = sums(bins, node, weight, target, taken, 1) if len(g.active) else None
    while len(g.active):
        parents, small, large, keep = g.advance(best_splits(h, spec, number, g.active, taken, edges))
        if not len(g.active):
            break
        # Only rows of nodes that were split go on.
        at = at[g.column[node[at]] >= 0]
        here = node[at]
        node[at] = g.left[here] + (bins[at, g.column[here]] > g.cut[here])
        slot = np.full(len(g.column), -1)
        slot[small] = np.arange(len(small))
        inside = slot[node[at]]
        mine = at[inside >= 0]
        lesser = sums(bins[mine], inside[inside >= 0], weight[mine], target[mine], taken, len(small))
        h = children(h, parents, lesser, keep)
    return g.tree()


class Ensemble:
    """Trees and how their values become a forecast."""

    def __init__(self, spec: Spec, start: float, trees: list[Tree], votes: list[float]) -> None:
        self.spec, self.start, self.trees, self.votes = spec, start, trees, votes

    def predict(self, bins: np.ndarray) -> np.ndarray:
        if self.spec.combine == "median":
            values = np.stack([t.predict(bins) for t in self.trees], axis=1)
            order = np.argsort(values, axis=1, kind="stable")
            run = np.cumsum(np.asarray(self.votes)[order], axis=1)
            place = (run >= run[:, -1:] / 2).argmax(axis=1)
            return self.start + np.take_along_axis(values, order, 1)[np.arange(len(bins)), place]
        out = np.zeros(len(bins))
        for t in self.trees:
            out += t.predict(bins)
        return self.start + out * (self.spec.rate if self.spec.combine == "sum" else 1 / max(len(self.trees), 1))


def reweighted(weight: np.ndarray, error: np.ndarray, worst: float, beta: float, rate: float) -> np.ndarray:
    return weight * beta ** ((1 - error / worst) * rate)


def vote(spec: Spec, worst: float, mean: float, first: bool) -> tuple[float, float] | None:
    """(beta, vote) of a tree by its largest and mean error; None ends the rounds."""
    loss = mean / worst if worst > 0 else 0.0
    if loss <= 0 or loss >= 0.5:
        return (1.0, 1.0) if first else None
    beta = loss / (1 - loss)
    return beta, float(np.log(1 / beta) * spec.rate)


def train(bins, y, ids, edges, spec: Spec, first: int = 0, last: int | None = None) -> Ensemble:
    """Trees ``first`` to ``last`` (only averaged ones can be grown apart) on the rows of one task."""
    last = spec.rounds if last is None else last
    start = float(y.mean()) if len(y) else 0.0
    trees: list[Tree] = []
    votes: list[float] = []
    if spec.combine == "mean":
        for r in range(first, last):
            trees.append(grow(bins, row_weights(spec, r, ids), y - start, spec, r, edges))
    elif spec.combine == "sum":
        left = y - start
        for r in range(first, last):
            trees.append(grow(bins, row_weights(spec, r, ids), left, spec, r, edges))
            left = left - spec.rate * trees[-1].predict(bins)
    else:
        weight, start = np.ones(len(y)), 0.0
        for r in range(first, last):
            tree = grow(bins, weight / weight.mean(), y, spec, r, edges)
            error = np.abs(y - tree.predict(bins))
            worst = float(error.max(initial=0))
            got = vote(spec, worst, float((error * weight).sum() / weight.sum()), not trees)
            if got is None:
                break
            trees.append(tree)
            votes.append(got[1])
            if got[0] == 1.0:
                break
            weight = reweighted(weight, error, worst, got[0], spec.rate)
    return Ensemble(spec, start, trees, votes)
