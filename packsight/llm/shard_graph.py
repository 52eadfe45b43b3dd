"""NN-descent and greedy graph search over the vectors of one shard, on numpy arrays.

Distances are squared and in single precision, from differences of components. Products of
differences to a common point only choose the pairs whose distances are then taken so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 256  # nodes of a block of a random-projection tree
PAIRS = 1 << 20  # offers that are held before they are merged
CELLS = 1 << 22  # flags of visited nodes that are held at once


def between(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of x[a] and y[b]."""
    d = np.empty(len(a), np.float32)
    for k in range(0, len(a), 8192):
        part = x[a[k : k + 8192]] - y[b[k : k + 8192]]
        d[k : k + 8192] = np.einsum("ij,ij->i", part, part)
    return d


def _ranked(owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first `most` rows of each owner (rows are sorted by owner), and their ranks."""
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
    rank = np.arange(len(owner)) - start
    at = np.flatnonzero(rank < most)
    return at, rank[at]


class Lists:
    """The `degree` nearest nodes known of each node; unused places hold -1 at an infinite distance."""

    def __init__(self, n: int, degree: int) -> None:
        self.n, self.degree = n, degree
        self.ids = np.full((n, degree), -1, np.int64)
        self.d = np.full((n, degree), np.inf, np.float32)
        self.fresh = np.zeros((n, degree), bool)

    def merge(self, owner: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        """Offer nodes to owners; an offer that enters a list is fresh."""
        keep = d < self.d[owner, -1]
        key, first = np.unique(owner[keep] * self.n + near[keep], return_index=True)
        d = d[keep][first]
        owner, near = np.divmod(key, self.n)
        order = np.lexsort((d, owner))
        # Of a sorted list's length from each owner, those already known included, all that can enter.
        at, rank = _ranked(owner[order], 2 * self.degree)
        owner, near, d = owner[order][at], near[order][at], d[order][at]
        rows, place = np.unique(owner, return_inverse=True)
        ids = np.full((len(rows), 3 * self.degree), -1, np.int64)
        far = np.full(ids.shape, np.inf, np.float32)
        fresh = np.zeros(ids.shape, bool)
        ids[:, : self.degree], far[:, : self.degree], fresh[:, : self.degree] = self.ids[rows], self.d[rows], self.fresh[rows]
        ids[place, self.degree + rank], far[place, self.degree + rank], fresh[place, self.degree + rank] = near, d, True
        order = np.argsort(ids, axis=1, kind="stable")  # of a node named twice, the entry that was there first stays
        ids, far, fresh = (np.take_along_axis(v, order, axis=1) for v in (ids, far, fresh))
        far[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        order = np.argsort(far, axis=1, kind="stable")[:, : self.degree]
        ids, far, fresh = (np.take_along_axis(v, order, axis=1) for v in (ids, far, fresh))
        gone = np.isinf(far)
        ids[gone], fresh[gone] = -1, False
        self.ids[rows], self.d[rows], self.fresh[rows] = ids, far, fresh

    def around(self, inward: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of each node and their freshness: all own ones, then the nearest `inward` that only name it."""
        owner, at = np.nonzero(self.ids >= 0)
        near, d, fresh = self.ids[owner, at], self.d[owner, at], self.fresh[owner, at]
        back, again = np.zeros(len(owner), bool), fresh.copy()
        for k in range(0, len(owner), 1 << 16):  # whether the other names the owner too, and whether either does afresh
            part = slice(k, k + (1 << 16))
            same = self.ids[near[part]] == owner[part, None]
            back[part] = same.any(axis=1)
            again[part] |= (same & self.fresh[near[part]]).any(axis=1)
        order = np.flatnonzero(~back)
        order = order[np.lexsort((owner[order], d[order], near[order]))]
        kept, rank = _ranked(near[order], inward)
        order = order[kept]
        width = self.degree + (int(rank.max()) + 1 if len(rank) else 0)
        ids, new = np.full((self.n, width), -1, np.int64), np.zeros((self.n, width), bool)
        ids[:, : self.degree] = self.ids
        new[owner, at] = again
        ids[near[order], self.degree + rank], new[near[order], self.degree + rank] = owner[order], fresh[order]
        return ids, new


def _blocks(x: np.ndarray, trees: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Nodes of the blocks that random projections put side by side, of LEAF to less than 2 * LEAF each."""
    n = len(x)
    bits = max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))
    for _ in range(trees):
        z = x @ rng.normal(size=(x.shape[1], bits + 1)).astype(np.float32)
        code = ((z[:, :bits] > np.median(z[:, :bits], axis=0)) * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(axis=1)
        order = np.lexsort((z[:, bits], code))
        ends = [*range(0, n - LEAF + 1, LEAF)] or [0]
        for a, z_ in zip(ends, [*ends[1:], n]):
            yield order[a:z_]


def descend(x: np.ndarray, degree: int, inward: int, trees: int, settled: float, seed: tuple[int, ...]) -> np.ndarray:
    """The neighbour graph of a shard's vectors: own neighbours and those that name a node, -1 in unused places.

    Each round offers every node's neighbours to each other, pairs of which neither is fresh aside, as
    they have met before. Rounds end when one replaces at most the share `settled` of all neighbours.
    """
    n = len(x)
    lists = Lists(n, degree)
    held: list[tuple[np.ndarray, ...]] = []

    def offer(owner: np.ndarray, near: np.ndarray, final: bool = False) -> None:
        if len(owner):
            held.append((owner, near, between(x, owner, x, near)))
        if held and (final or sum(len(h[0]) for h in held) >= PAIRS):
            lists.merge(*(np.concatenate(v) for v in zip(*held)))
            held.clear()

    none = np.zeros(0, np.int64)
    for block in _blocks(x, trees, np.random.default_rng(seed)):
        if len(block) > 1:
            y = x[block] - x[block].mean(axis=0)
            size = np.einsum("ij,ij->i", y, y)
            d = size[:, None] + size[None] - 2 * (y @ y.T)
            np.fill_diagonal(d, np.inf)
            most = min(degree, len(block) - 1)
            offer(np.repeat(block, most), block[np.argpartition(d, most - 1, axis=1)[:, :most]].ravel())
    offer(none, none, final=True)

    while lists.fresh.sum() > settled * (lists.ids >= 0).sum():
        around, fresh = lists.around(inward)
        lists.fresh[:] = False
        order = np.argsort(~fresh, axis=1, kind="stable")  # fresh ones first
        around, count = np.take_along_axis(around, order, axis=1), fresh.sum(axis=1)
        wide = (around >= 0).sum(axis=1)
        todo = np.lexsort((wide, count))
        todo = todo[count[todo] > 0]
        for k in range(0, len(todo), 256):
            centre = todo[k : k + 256]
            most = int(count[centre].max())
            ids = around[centre]
            ids = ids[:, (ids >= 0).any(axis=0)]
            y = x[ids] - x[centre][:, None]
            size = np.einsum("bij,bij->bi", y, y)
            d = (y[:, :most] * np.float32(-2)) @ y.transpose(0, 2, 1)
            d += size[:, None]
            d += size[:, :most, None] * np.float32(0.999999)  # rounding must not hide a pair
            worst = np.where(ids >= 0, lists.d[ids, -1], -np.inf)
            bound = np.maximum(worst[:, :most, None], worst[:, None])
            met = (d < bound) & (np.arange(most)[None, :, None] < count[centre][:, None, None]) & (np.arange(ids.shape[1])[None, None] > np.arange(most)[None, :, None]) & (ids >= 0)[:, None]
            b, i, j = np.nonzero(met)
            one, two = ids[b, i], ids[b, j]
            far = d[met]
            to_one, to_two = far < worst[b, i], far < worst[b, j]
            offer(np.concatenate([one[to_one], two[to_two]]), np.concatenate([two[to_one], one[to_two]]))
        offer(none, none, final=True)
    return lists.around(inward)[0]


def walk(x: np.ndarray, graph: np.ndarray, asked: np.ndarray, own: np.ndarray, entries: np.ndarray, beam: int, step: int, starts: int, k: int, blur: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, node and distance of the k nearest nodes found, and of all that rounding may have put behind them.

    Queries begin at the nearest `starts` of the entry nodes and at their own node (own, -1: none). Of the
    best `beam` nodes up to `step` not yet expanded are expanded at a time, until all are.
    """
    n, found = len(x), []
    points, some = x[entries], min(starts, len(entries))
    size = np.einsum("ij,ij->i", points, points)
    most = max(1, min(1024, CELLS // (n + 1)))
    for k0 in range(0, len(asked), most):
        q, mine = asked[k0 : k0 + most], own[k0 : k0 + most]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        flat, last = seen.reshape(-1), np.empty(seen.size, np.int32)
        hold = max(beam, k)
        d, ids, done = np.full((len(q), hold), np.inf, np.float32), np.full((len(q), hold), n), np.zeros((len(q), hold), bool)
        log = []

        def enter(rows: np.ndarray, nodes: np.ndarray) -> None:
            """Measure nodes that a query hasn't met, and keep the best of all."""
            at = rows * (n + 1) + nodes
            new = np.flatnonzero(~flat[at])
            at = at[new]
            last[at] = np.arange(len(at), dtype=np.int32)
            once = last[at] == np.arange(len(at), dtype=np.int32)
            new, at = new[once], at[once]
            if not len(at):
                return
            flat[at] = True
            rows, nodes = rows[new], nodes[new]
            far = between(q, rows, x, nodes)
            log.append((rows, nodes, far))
            near = far < d[rows, -1]
            rows, nodes, far = rows[near], nodes[near], far[near]
            if not len(rows):
                return
            order = np.lexsort((nodes, far, rows))
            some, rank = _ranked(rows[order], hold)
            order = order[some]
            rows, nodes, far = rows[order], nodes[order], far[order]
            which, place = np.unique(rows, return_inverse=True)
            wide = int(rank.max()) + 1
            d2, i2 = np.full((len(which), wide), np.inf, np.float32), np.full((len(which), wide), n)
            d2[place, rank], i2[place, rank] = far, nodes
            d2, i2, e2 = np.concatenate([d[which], d2], axis=1), np.concatenate([ids[which], i2], axis=1), np.concatenate([done[which], np.zeros(i2.shape, bool)], axis=1)
            order = np.argsort(d2, axis=1, kind="stable")[:, :hold]
            d[which], ids[which], done[which] = (np.take_along_axis(v, order, axis=1) for v in (d2, i2, e2))

        if some:
            first = size - 2 * (q @ points.T)
            enter(np.repeat(np.arange(len(q)), some), entries[np.argpartition(first, some - 1, axis=1)[:, :some]].ravel())
        enter(np.flatnonzero(mine >= 0), mine[mine >= 0])
        while True:
            open_ = ~done[:, :beam] & (ids[:, :beam] < n)
            open_ &= np.cumsum(open_, axis=1) <= step
            rows, at = np.nonzero(open_)
            if not len(rows):
                break
            done[rows, at] = True
            near = graph[ids[rows, at]]
            enter(np.repeat(rows, near.shape[1]), np.where(near < 0, n, near).ravel())
        rows, nodes, far = (np.concatenate(v) for v in zip(*log)) if log else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        limit = np.sqrt(d[:, k - 1].astype(np.float64)) * 1.0001 + blur
        good = np.sqrt(far.astype(np.float64)) <= limit[rows]
        found.append((rows[good] + k0, nodes[good], far[good]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def scan(x: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of all nodes of each query, and their distances."""
    k = min(k, len(x))
    at, d = np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k), np.float32)
    every = np.arange(len(x))
    for row in range(len(asked)):
        far = between(asked, np.full(len(x), row), x, every)
        at[row] = np.lexsort((every, far))[:k]
        d[row] = far[at[row]]
    return at, d
