"""Proximity-graph kernels that run inside one task over one shard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BuildParams:
    """degree R, list size L, occlusion factor alpha, candidate cap C, slack while building; saturate fills lists up to R with the nearest left out."""

    degree: int = 64
    list_size: int = 100
    alpha: float = 1.2
    candidates: int = 750
    slack: float = 1.3
    saturate: bool = False

    def __post_init__(self) -> None:
        if self.degree < 1 or self.list_size < 1 or self.alpha < 1 or self.candidates < 1 or self.slack < 1:
            raise ValueError("degree, list_size and candidates must be positive, alpha and slack at least 1")


def distances(vecs: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared L2 of some rows to one vector."""
    diff = vecs[rows] - q
    return np.einsum("ij,ij->i", diff, diff)


def medoid_of(vecs: np.ndarray) -> int:
    """The row nearest to the mean, the first on ties."""
    return int(distances(vecs, np.arange(len(vecs)), vecs.mean(0)).argmin())


class CandidateList:
    """The best ``size`` (distance, node) seen, in order, with a mark on those already expanded."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.nodes = np.zeros(0, np.int64)
        self.dist = np.zeros(0)
        self.done = np.zeros(0, bool)
        #: The distance of the last node that ``next`` gave.
        self.last = np.inf

    def add(self, nodes: np.ndarray, dist: np.ndarray) -> None:
        if len(self.nodes) == self.size:
            # Ties with the last may still win by the smaller node.
            near = dist <= self.dist[-1]
            if not near.any():
                return
            nodes, dist = nodes[near], dist[near]
        nodes, dist = np.concatenate((self.nodes, nodes)), np.concatenate((self.dist, dist))
        done = np.zeros(len(nodes), bool)
        done[: len(self.done)] = self.done
        order = np.lexsort((nodes, dist))[: self.size]
        self.nodes, self.dist, self.done = nodes[order], dist[order], done[order]

    def next(self, n: int = 1) -> np.ndarray:
        """Up to ``n`` nearest nodes not expanded yet, marked as expanded now."""
        open_ = np.flatnonzero(~self.done)[:n]
        self.done[open_] = True
        if len(open_):
            self.last = float(self.dist[open_[-1]])
        return self.nodes[open_]


def padded_seeds(nbrs: list[np.ndarray], starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The neighbours of the starts, padded with random nodes to ``size`` or to all there are."""
    own = np.array(list(dict.fromkeys(np.concatenate([nbrs[x] for x in starts.tolist()]).tolist()))[:size] if len(starts) else [], np.int64)
    others = np.setdiff1d(np.arange(len(nbrs)), own)
    return np.append(own, np.random.default_rng(seed).permutation(others)[: size - len(own)])


def greedy_search(
    vecs: np.ndarray, nbrs: list[np.ndarray], starts: np.ndarray, q: np.ndarray, size: int, norms: np.ndarray | None = None
) -> tuple[CandidateList, np.ndarray, np.ndarray, int]:
    """Best-first search: (list, expanded nodes in order, their distances, distances computed).

    With the squared ``norms`` of the rows, distances are norm - 2 x.q, which rank like squared L2.
    """

    def measure(rows: np.ndarray) -> np.ndarray:
        return distances(vecs, rows, q) if norms is None else norms[rows] - 2 * (vecs[rows] @ q)

    seen = np.zeros(len(vecs), bool)
    best = CandidateList(size)
    starts = np.unique(starts)
    seen[starts] = True
    best.add(starts, measure(starts))
    expanded, far, count = [], [], len(starts)
    while len(now := best.next()):
        node = int(now[0])
        expanded.append(node)
        far.append(best.last)
        new = nbrs[node][~seen[nbrs[node]]]
        if len(new):
            seen[new] = True
            count += len(new)
            best.add(new, measure(new))
    return best, np.array(expanded, np.int64), np.array(far), count


def robust_prune(vecs: np.ndarray, node: int, pool: np.ndarray, dist: np.ndarray, p: BuildParams, skip: np.ndarray | None = None) -> np.ndarray:
    """At most ``degree`` of the pool such that none is much nearer to a chosen one than to ``node``.

    Passes with a growing factor (1, then times 1.2 up to alpha) take the nearest candidate that no chosen one
    occludes by more than the factor. ``skip`` marks nodes that must not be chosen; they occlude nothing.
    """
    usable = pool != node
    if skip is not None:
        usable &= ~skip[pool]
    pool, first = np.unique(pool[usable], return_index=True)
    dist = dist[usable][first]
    order = np.lexsort((pool, dist))[: p.candidates]
    pool, dist = pool[order], dist[order]
    n = len(pool)
    factor, taken, later = np.zeros(n), np.zeros(n, bool), np.arange(n)
    chosen: list[int] = []
    near = vecs[pool]
    # Small pools: all pair distances by one product; large ones: a row for each chosen candidate.
    sq = np.einsum("ij,ij->i", near, near)
    grid = np.maximum(sq[:, None] + sq[None] - 2 * (near @ near.T), 0) if n <= 256 else None
    bound = 1.0
    while bound <= p.alpha * (1 + 1e-9) and len(chosen) < p.degree:
        start = 0
        while len(chosen) < p.degree:
            open_ = np.flatnonzero(~taken[start:] & (factor[start:] <= bound))
            if not len(open_):
                break
            i = start + int(open_[0])
            start = i + 1
            taken[i] = True
            chosen.append(i)
            between = grid[i] if grid is not None else np.maximum(sq + sq[i] - 2 * (near @ near[i]), 0)
            ratio = np.divide(dist, between, out=np.full(n, np.inf), where=between > 0)
            np.maximum(factor, ratio, out=factor, where=(later > i) & ~taken)
        bound *= 1.2
    return pool[chosen]


def saturate(chosen: np.ndarray, pool: np.ndarray, dist: np.ndarray, node: int, degree: int) -> np.ndarray:
    """Fill up to ``degree`` with the nearest of the pool that were left out."""
    order = np.lexsort((pool, dist))
    rest = [x for x in dict.fromkeys(pool[order].tolist()) if x != node and x not in set(chosen.tolist())]
    return np.append(chosen, np.array(rest[: max(0, degree - len(chosen))], np.int64))


def build_graph(vecs: np.ndarray, p: BuildParams, start: int | None = None) -> tuple[list[np.ndarray], int]:
    """(neighbours by row, entry row): rows are inserted in order, each by a search from ``start`` (the medoid if not given), pruning and back edges."""
    n = len(vecs)
    nbrs = [np.zeros(0, np.int64) for _ in range(n)]
    if not n:
        return nbrs, -1
    start = medoid_of(vecs) if start is None else start
    for i in range(n):
        insert_node(vecs, nbrs, i, start, p)
    for i in range(n):
        if len(nbrs[i]) > p.degree:
            nbrs[i] = robust_prune(vecs, i, nbrs[i], distances(vecs, nbrs[i], vecs[i]), p)
    return nbrs, start


def insert_node(vecs: np.ndarray, nbrs: list[np.ndarray], node: int, start: int, p: BuildParams) -> None:
    """Link one row into the graph: neighbours from the nodes its search expanded, and edges back to it."""
    if node == start:
        return
    _, pool, dist, _ = greedy_search(vecs, nbrs, np.array([start]), vecs[node], p.list_size)
    # The node's edges so far come from back links; they stay candidates.
    pool, dist = np.append(pool, nbrs[node]), np.append(dist, distances(vecs, nbrs[node], vecs[node]))
    own = robust_prune(vecs, node, pool, dist, p)
    if p.saturate and p.alpha > 1:
        own = saturate(own, pool, dist, node, p.degree)
    nbrs[node] = own
    most = int(p.degree * p.slack)
    for other in own.tolist():
        if node in nbrs[other]:
            continue
        nbrs[other] = np.append(nbrs[other], node)
        if len(nbrs[other]) > most:
            nbrs[other] = robust_prune(vecs, other, nbrs[other], distances(vecs, nbrs[other], vecs[other]), p)


@dataclass
class Stats:
    """What one query cost: pages read, distances by the guide, nodes expanded (whose full distances come with their pages), cache hits."""

    pages: int = 0
    comparisons: int = 0
    hops: int = 0
    cache_hits: int = 0


def beam_search(
    vecs: np.ndarray, nbrs: list[np.ndarray], guide: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, q: np.ndarray, size: int, beam: int, page_of: np.ndarray,
    cached: np.ndarray, reuse_pages: bool, page_limit: int | None = None,
) -> tuple[np.ndarray, np.ndarray, Stats]:
    """Page-based search: (nodes by full distance, distances, cost).

    ``guide`` gives the approximate distances of some rows to the query, which order the list, and is asked for rows when they are first met; a node's full
    vector is known once its page was read. Each round takes up to ``beam`` open nodes; nodes marked in ``cached``
    cost nothing, the others are read page by page. With ``reuse_pages`` every node of a page once read by this
    query is free later. Stops early, with fewer results, when ``page_limit`` pages were read.
    """
    s, best, seen = Stats(), CandidateList(size), np.zeros(len(vecs), bool)
    starts = np.unique(starts)
    seen[starts] = True
    best.add(starts, guide(starts))
    s.comparisons += len(starts)
    have: set[int] = set()
    expanded: list[int] = []
    while page_limit is None or s.pages < page_limit:
        now = best.next(beam)
        if not len(now):
            break
        free = cached[now] | (np.array([int(page_of[x]) in have for x in now]) if reuse_pages else np.zeros(len(now), bool))
        s.cache_hits += int(free.sum())
        read = np.unique(page_of[now[~free]])
        s.pages += len(read)
        if reuse_pages:
            have.update(read.tolist())
        for node in now.tolist():
            expanded.append(node)
            s.hops += 1
            new = nbrs[node][~seen[nbrs[node]]]
            if len(new):
                seen[new] = True
                s.comparisons += len(new)
                best.add(new, guide(new))
    nodes = np.array(expanded, np.int64)
    full = distances(vecs, nodes, q)
    order = np.lexsort((nodes, full))
    return nodes[order], full[order], s
