"""Arrays of one tree: bootstrap counts, growth on binned rows, and the way of rows through the nodes.

A row is one byte per feature: the number of the feature's cuts below its value. Nodes are arrays: `feature` (-1 at
leaves), `cut` (rows with a larger byte go right), `left` (the right child follows it) and `share` (of class 1).
"""

from __future__ import annotations

import math

import numpy as np

BINS = 256
SORTED_AT_ONCE = 60_000
#: Rows from which a node's rows are counted by byte; below, sorting them is faster.
COUNTED_ROWS = 128
COUNTED_AT_ONCE = 32_000
#: Distribution function of the Poisson law with mean 1; counts end at 15.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(15)])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def bootstrap(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree takes each row, by the row's 64-bit key."""
    z = keys.view(np.uint64) + np.array([tree + 1], np.uint64) * _MIX[0]
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    uniform = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.uint8)


def feature_order(seed: int, tree: int, node: int, nodes: int, features: int) -> np.ndarray:
    """A random order of the features for each of some nodes."""
    return np.random.default_rng([seed, tree, node]).random((nodes, features)).argsort(axis=1)


def purity(c0, c1, weights: tuple[float, float]):
    """Weighted sum of squares of a side; the larger over both sides, the smaller the Gini impurity."""
    a, b = weights[0] * c0, weights[1] * c1
    return (a * a + b * b) / (a + b)


def _best_cuts(group, byte, count, y, totals, weights):
    """Per group that has rows of differing bytes: group, purity and cut of the best split."""
    wide = np.uint32 if len(totals[0]) < 1 << 19 else np.uint64
    key = np.sort((((group.astype(wide) << 8) | byte) << 5) | (count << 1) | y)
    at, low, n = key >> 13, ((key >> 5) & 255).astype(np.int64), ((key >> 1) & 15).astype(np.int64)
    ones, both = np.cumsum(n * (key & 1).astype(np.int64)), np.cumsum(n)
    edge = np.flatnonzero(((key[1:] >> 5) != (key[:-1] >> 5)) & (at[1:] == at[:-1]))
    if not edge.size:
        return (np.empty(0, np.int64),) * 3
    first = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
    before = np.zeros((2, len(totals[0])), np.int64)
    before[:, at[first].astype(np.int64)] = np.where(first > 0, ones[first - 1], 0), np.where(first > 0, both[first - 1], 0)
    of = at[edge].astype(np.int64)
    l1 = ones[edge] - before[0, of]
    l0 = both[edge] - before[1, of] - l1
    value = purity(l0, l1, weights) + purity(totals[0][of] - l0, totals[1][of] - l1, weights)
    start = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1]
    top = np.maximum.reduceat(value, start)
    hit = np.flatnonzero(value == np.repeat(top, np.diff(np.r_[start, len(of)])))
    hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
    return of[start], top, (low[edge[hit]] + low[edge[hit] + 1] - 1) // 2


def _best_counted(cells, times, nodes: int, weights):
    """Purity and cut of the best split of each node by its rows' counts; `cells` are node, class and byte in one number.

    The purity is -1 where all rows have one byte.
    """
    below = np.bincount(cells, times, nodes * 2 * BINS).reshape(nodes, 2, BINS).cumsum(axis=2)
    l0, l1 = below[:, 0], below[:, 1]
    with np.errstate(invalid="ignore"):
        value = purity(l0, l1, weights) + purity(l0[:, -1:] - l0, l1[:, -1:] - l1, weights)
    both = l0 + l1
    value[(both == 0) | (both == both[:, -1:])] = -1.0
    low, every = value.argmax(axis=1), np.arange(nodes)
    following = (both > both[every, low][:, None]).argmax(axis=1)
    return value[every, low], (low + following - 1) // 2


class _Level:
    """The best split found so far of each node of a level; rows come in the order of their nodes."""

    def __init__(self, columns, member, node, times, ones, totals, order, weights):
        self.columns, self.member, self.node, self.times, self.ones = columns, member, node, times, ones
        self.totals, self.order, self.weights = totals, order, weights
        width = len(totals[0])
        self.best, self.feature = np.full(width, -1.0), np.full(width, -1, np.int16)
        self.cut = np.zeros(width, np.uint8)

    def keep(self, nodes, value, place, cut) -> None:
        better = value > self.best[nodes]
        nodes = nodes[better]
        self.best[nodes], self.cut[nodes] = value[better], cut[better]
        self.feature[nodes] = self.order[nodes, place[better]]

    def count(self, wanted, places) -> None:
        """One feature after the other, by counts per byte, of as many nodes at once as have `COUNTED_AT_ONCE` rows."""
        some, nodes = np.flatnonzero(wanted[self.node]), np.flatnonzero(wanted)
        ends = np.searchsorted(self.node[some], nodes, side="right")
        flat, block = self.columns.ravel(), (ends - 1) // COUNTED_AT_ONCE
        stops = [*np.flatnonzero(np.diff(block)) + 1, len(nodes)]
        for first, stop in zip([0, *stops], stops):
            begin = ends[first - 1] if first else 0
            rows, sizes = some[begin : ends[stop - 1]], np.diff(ends[first:stop], prepend=begin)
            member, times = self.member[rows], self.times[rows].astype(float)
            base = np.repeat(np.arange(0, 2 * (stop - first), 2), sizes)
            base += self.ones[rows]
            base *= BINS
            for place in places:
                cells = np.repeat(self.order[nodes[first:stop], place] * self.columns.shape[1], sizes)
                cells += member
                cells = flat.take(cells, mode="clip") + base
                value, cut = _best_counted(cells, times, stop - first, self.weights)
                self.keep(nodes[first:stop], value, np.full(stop - first, place), cut)

    def sort(self, wanted, places) -> None:
        """Several features at once, as long as the rows of all wanted nodes are few, by sorting bytes."""
        some = np.flatnonzero(wanted[self.node])
        at, step = self.node[some], max(1, SORTED_AT_ONCE // max(some.size, 1))
        for place in range(places.start, places.stop, step):
            tried = min(step, places.stop - place)
            cells = self.order[at, place : place + tried] * self.columns.shape[1] + self.member[some][:, None]
            byte = self.columns.ravel().take(cells.ravel(), mode="clip").astype(np.uint32)
            group = (at[:, None] * tried + np.arange(tried)).ravel()
            group, value, cut = _best_cuts(group, byte, np.repeat(self.times[some], tried), np.repeat(self.ones[some], tried),
                                           [np.repeat(t, tried) for t in self.totals], self.weights)
            best_first = np.lexsort((group, -value, group // tried))
            found = group[best_first] // tried
            best_first = best_first[np.r_[True, found[1:] != found[:-1]][: len(found)]]
            self.keep(group[best_first] // tried, value[best_first], place + group[best_first] % tried, cut[best_first])


def grow(rows, y, count, weights, depth: int, tried: int, seed: int, tree: int, root: int):
    """All nodes below `root`, level by level, until leaves are pure, rows equal or `depth` reached.

    A node takes the best cut of `tried` random features; if none of them parts its rows, of the next that does. Nodes of
    `COUNTED_ROWS` rows count them by byte, smaller ones sort them; both find the same cut.
    """
    member, node, width, made = np.arange(len(rows)), np.zeros(len(rows), np.int64), 1, 1
    columns, features = np.ascontiguousarray(rows.T), rows.shape[1]
    ones, n, levels = y.astype(np.uint32), count.astype(np.uint32), []
    for level in range(depth + 1):
        start = np.searchsorted(node, np.arange(width))
        c1 = np.add.reduceat(n * ones, start).astype(float)
        c0 = np.add.reduceat(n, start).astype(float) - c1
        left, share = np.zeros(width, np.int32), (weights[1] * c1 / (weights[0] * c0 + weights[1] * c1)).astype(np.float32)
        mixed = (c0 > 0) & (c1 > 0)
        if level == depth or not mixed.any():
            levels.append((np.full(width, -1, np.int16), np.zeros(width, np.uint8), left, share))
            break
        order = feature_order(seed, tree, (root << 6) + level, width, features)
        found = _Level(columns, member, node, n, ones, (c0.astype(np.int64), c1.astype(np.int64)), order, weights)
        sizes = np.diff(np.r_[start, len(node)])
        large = sizes >= COUNTED_ROWS
        for split, of in ((found.count, mixed & large), (found.sort, mixed & ~large)):
            places = range(min(tried, features))
            while places and of.any():
                split(of, places)
                of = of & (found.feature < 0)
                places = range(places.stop, min(places.stop + 1, features))
        split = found.feature >= 0
        left[split] = made + 2 * np.arange(split.sum())
        levels.append((found.feature, found.cut, left, share))
        goes, sizes = np.flatnonzero(np.repeat(split, sizes)), sizes[split]
        member = member[goes]
        cells = np.repeat(found.feature[split] * np.int64(len(rows)), sizes)
        cells += member
        child = np.repeat(np.arange(0, 2 * len(sizes), 2), sizes)
        child += columns.ravel().take(cells, mode="clip") > np.repeat(found.cut[split], sizes)
        width = 2 * len(sizes)
        made += width
        if not width:
            break
        by_node = np.argsort(child.astype(np.uint16) if width <= 1 << 16 else child, kind="stable")
        node, member, goes = child[by_node], member[by_node], goes[by_node]
        n, ones = n[goes], ones[goes]
    return tuple(np.concatenate(part) for part in zip(*levels, strict=True))


def joined(splits: dict, leaves: dict, parts: dict):
    """One tree of the upper splits, the leaves (shares) above the grown parts, and these; all by the number of the node."""
    upper = sorted({1, *leaves, *parts, *(2 * node + side for node in splits for side in (0, 1))})
    size = len(upper) + sum(len(nodes[0]) - 1 for nodes in parts.values())
    feature, cut = np.full(size, -1, np.int16), np.zeros(size, np.uint8)
    left, share = np.zeros(size, np.int32), np.zeros(size, np.float32)
    place, made = {1: 0}, 1
    for node in upper:
        at = place[node]
        if node in splits:
            feature[at], cut[at] = splits[node]
            left[at], place[2 * node], place[2 * node + 1] = made, made, made + 1
            made += 2
        elif node in leaves:
            share[at] = leaves[node]
        else:
            below = slice(made, made + len(parts[node][0]) - 1)
            for out, values in zip((feature, cut, share), (parts[node][i] for i in (0, 1, 3)), strict=True):
                out[at], out[below] = values[0], values[1:]
            moved = np.where(parts[node][0] >= 0, parts[node][2] + np.int32(made - 1), 0)
            left[at], left[below] = moved[0], moved[1:]
            made = below.stop
    return feature, cut, left, share


def shares(rows: np.ndarray, nodes) -> np.ndarray:
    """The share of class 1 at each row's leaf."""
    feature, cut, left, share = nodes
    at, active = np.zeros(len(rows), np.int64), np.arange(len(rows) if feature[0] >= 0 else 0)
    while active.size:
        here = at[active]
        step = left[here] + (rows[active, feature[here]] > cut[here])
        at[active] = step
        active = active[feature[step] >= 0]
    return share[at]


def route(rows: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """Node of each row below the given upper splits; node i has the children 2i and 2i + 1, the root is 1."""
    at = np.ones(len(rows), np.int64)
    for node, (feature, cut) in sorted(splits.items()):
        here = np.flatnonzero(at == node)
        at[here] = 2 * node + (rows[here, feature] > cut)
    return at
