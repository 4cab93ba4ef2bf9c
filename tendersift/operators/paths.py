"""Shortest paths of one graph from blocks of sources, as numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Elements of a block of steps (arcs x sources), so that it stays in the cache.
BLOCK = 1 << 17
#: Elements of an array of (node, source), and rows of (arc, source) on shortest paths that exist at once.
HELD, TIGHT = 1 << 23, 1 << 23
#: Components of together about so many nodes are kept as one graph.
PACKED = 1 << 10
#: Longer than any path that is kept as a 16-bit number; two of them still add up to one.
ENDLESS = (1 << 14) - 1


class Paths:
    """An undirected graph of nodes 0 to ``n`` - 1 with arcs of positive length. Paths longer than ``cutoff`` do not count.

    Nodes are kept in groups of about equal degree with a table of their neighbours, filled up by endless arcs; the arcs of a node that has
    more than a block holds are in several groups. Whole lengths are 16-bit numbers as long as all distances are far below what these hold.
    """

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, cutoff: float | None = None):
        self.n, self.cutoff = n, np.inf if cutoff is None else cutoff
        self.edges = src.astype(np.int32), dst.astype(np.int32), weight
        self.least, self.most = (float(weight.min()), float(weight.max())) if len(weight) else (1.0, 1.0)
        self.lanes = max(1, min(128, HELD // max(n, 1)))
        #: Most steps on shortest paths of one source so far.
        self.steps = 0
        self._keep(bool((weight == np.floor(weight)).all()) and self.most < ENDLESS // 2)

    def _keep(self, whole: bool) -> None:
        self.whole = whole
        self.kind, self.endless = (np.int16, ENDLESS) if whole else (np.float64, np.inf)
        # A step of at least ``least`` always ends in a later level.
        self.level = np.int16(self.least) if whole else self.least * (1 - 1e-9)
        src, dst, weight = self.edges
        self.groups = [*self._groups(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight]).astype(self.kind))]
        self.room = np.empty(max(BLOCK, self.lanes), self.kind)

    def _groups(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
        """(nodes, near, weight): row k of the tables ``near`` and ``weight`` has the nodes' k-th neighbours."""
        order = np.argsort(start, kind="stable")
        end, weight = end[order], weight[order]
        degree = np.bincount(start, minlength=self.n)
        first = np.cumsum(degree) - degree
        most = max(1, BLOCK // self.lanes)
        nodes = np.argsort(-degree, kind="stable").astype(np.int32)
        nodes = nodes[degree[nodes] > 0]
        at = 0
        while at < len(nodes):
            d = int(degree[nodes[at]])
            own = nodes[at:at + max(1, most // d)]
            at += len(own)
            for k in range(0, d, most):
                place = np.arange(k, min(k + most, d))[:, None]
                has = place < degree[own]
                index = np.where(has, first[own] + place, 0)
                yield own, np.where(has, end[index], own), np.where(has, weight[index], self.endless).astype(self.kind)[:, :, None]

    def _steps(self, far: np.ndarray, near: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(neighbour, node, source): lengths of the paths by way of the neighbours."""
        step = self.room[:near.size * far.shape[1]].reshape(*near.shape, far.shape[1])
        np.take(far, near, axis=0, out=step, mode="clip")
        step += weight
        return step

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """(node, source): lengths of the shortest paths, by sweeps over the nodes that have a changed neighbour."""
        far = np.full((self.n, len(sources)), self.endless, self.kind)
        far[sources, np.arange(len(sources))] = 0
        changed = np.zeros(self.n, bool)
        changed[sources] = True
        while changed.any():
            before, changed = changed, np.zeros(self.n, bool)
            for nodes, near, weight in self.groups:
                if before[near].any() or changed[near].any():
                    best, old = self._steps(far, near, weight).min(axis=0), far[nodes]
                    better = (best < old).any(axis=1)
                    if better.any():
                        far[nodes] = np.minimum(best, old)
                        changed[nodes[better]] = True
        if self.whole and far[far < ENDLESS].max() + self.most >= ENDLESS:
            self._keep(False)
            return self.distances(sources)
        # No step ends at -1.
        far[(far >= self.endless) | (far > self.cutoff)] = -1
        return far

    def _tight(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (node x source) of the starts and ends of the steps on shortest paths."""
        width = far.shape[1]
        known = np.where(far < 0, self.endless, far)
        starts, ends = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        lanes = np.arange(width, dtype=np.int32)
        for nodes, near, weight in self.groups:
            place = np.flatnonzero(self._steps(known, near, weight) == far[nodes]).astype(np.int32)
            row = place // width
            starts.append(near.ravel()[row] * np.int32(width) + (place - row * width))
            size = len(nodes) * width
            ends.append((nodes[:, None] * np.int32(width) + lanes).ravel()[place - place // size * size])
        starts = np.concatenate(starts)
        return starts, np.concatenate(ends)

    def _owed(self, far: np.ndarray, sources: np.ndarray) -> np.ndarray:
        """What the shortest paths from the sources owe to each node: with y(v) = sum over steps v -> w of 1 / paths(w) + y(w) it is paths(v) y(v)."""
        width = far.shape[1]
        starts, ends = self._tight(far)
        self.steps = max(self.steps, len(ends) // width)
        level = far.ravel()[ends] // self.level
        order = np.argsort(level, kind="stable")
        starts, level = starts[order], level[order]
        ends = ends[order]
        del order
        cuts = [0, *(np.flatnonzero(level[1:] != level[:-1]) + 1), len(level)]
        own = sources * width + np.arange(width)
        paths, y = np.zeros(self.n * width), np.zeros(self.n * width)
        paths[own] = 1
        for a, b in zip(cuts, cuts[1:]):
            np.add.at(paths, ends[a:b], paths[starts[a:b]])
        for a, b in reversed([*zip(cuts, cuts[1:])]):
            np.add.at(y, starts[a:b], 1 / paths[ends[a:b]] + y[ends[a:b]])
        y *= paths
        y[own] = 0
        return y.reshape(self.n, width).sum(axis=1)

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        """Sums of ``_owed`` over any number of sources, as many at once as the steps of those before allow."""
        total = np.zeros(self.n)
        for k in range(0, len(sources), self.lanes):
            block = sources[k:k + self.lanes]
            far, at = self.distances(block), 0
            while at < len(block):
                part = slice(at, at + (max(1, TIGHT // self.steps) if self.steps else 1))
                total += self._owed(np.ascontiguousarray(far[:, part]), block[part])
                at = part.stop
        return total


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n, dtype=np.int32)
    while True:
        a, b = label[src], label[dst]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]


@dataclass
class Parts:
    """A graph cut into parts of whole components. ``keys`` names the nodes in the order of the parts, ``nodes`` and ``edges`` hold the parts'
    ends in the tables, ``blocks`` are rows of (part, first source, end of the sources)."""

    keys: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    nodes: np.ndarray
    edges: np.ndarray
    sources: np.ndarray
    blocks: np.ndarray
    cutoff: float | None

    def dependencies(self, blocks: Iterator[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, sums) of what the shortest paths from the sources of the blocks owe to each node, one pair per part."""
        last, graph, total = -1, None, None
        for block in blocks:
            part, start, end = self.blocks[block]
            a, b = self.nodes[part:part + 2]
            if part != last:
                if total is not None:
                    yield self.keys[self.nodes[last]:self.nodes[last + 1]], total
                own = slice(*self.edges[part:part + 2])
                last, graph, total = part, Paths(b - a, self.src[own] - a, self.dst[own] - a, self.weight[own], self.cutoff), np.zeros(b - a)
            total += graph.dependencies(self.sources[start:end] - a)
        if total is not None:
            yield self.keys[self.nodes[last]:self.nodes[last + 1]], total


def parts(keys_src: np.ndarray, keys_dst: np.ndarray, weight: np.ndarray, sources: np.ndarray | None, cutoff: float | None = None) -> Parts:
    """The graph of the edges between named nodes; all of them are sources if none are named."""
    keys = np.unique(np.concatenate([keys_src, keys_dst]))
    src, dst = (np.searchsorted(keys, k).astype(np.int32) for k in (keys_src, keys_dst))
    label = components(len(keys), src, dst)
    order = np.argsort(label, kind="stable")
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    # The first node of a component says which part it is in.
    part = place[label] // PACKED
    starts = np.unique(part[order], return_index=True)[1]
    nodes = np.append(starts, len(keys))
    src, dst = place[src], place[dst]
    by = np.argsort(src, kind="stable")
    src, dst, weight = src[by], dst[by], weight[by]
    # Edges of a part start at its nodes, so they lie together.
    edges = np.searchsorted(src, nodes)
    chosen = np.arange(len(keys)) if sources is None else np.sort(place[np.flatnonzero(np.isin(keys, sources))])
    ends = np.searchsorted(chosen, nodes)
    blocks = [(p, k, min(k + 128, ends[p + 1])) for p in range(len(starts)) for k in range(ends[p], ends[p + 1], 128)]
    return Parts(keys[order], src, dst, weight, nodes, edges, chosen, np.array(blocks, np.int64).reshape(-1, 3), cutoff)
