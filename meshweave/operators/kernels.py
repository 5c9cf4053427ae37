"""Graph algorithms on the edges of one bounded piece of a graph (a small graph, or one component).

Inputs are numpy arrays of endpoints already numbered 0..n-1 (``local_ids``); a slot is an edge's place in them.
"""

from __future__ import annotations

import heapq

import numpy as np


def local_ids(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct values of the columns, and each column as places in them."""
    ids, places = np.unique(np.concatenate(columns), return_inverse=True)
    return ids, np.split(places, np.cumsum([len(c) for c in columns])[:-1])


def adjacency(n: int, src: np.ndarray, dst: np.ndarray, both: bool) -> list[list[tuple[int, int]]]:
    """(neighbour, slot) lists in slot order; undirected loops appear once."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for slot, (a, b) in enumerate(zip(src.tolist(), dst.tolist())):
        out[a].append((b, slot))
        if both and a != b:
            out[b].append((a, slot))
    return out


class Rows:
    """Neighbours in one array, by node and then by slot; undirected loops appear once."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, both: bool):
        slot = np.arange(len(src))
        if both:
            back = np.flatnonzero(src != dst)
            src, dst, slot = np.concatenate([src, dst[back]]), np.concatenate([dst, src[back]]), np.concatenate([slot, back])
        order = np.lexsort((slot, src))
        self.to, self.slot = dst[order], slot[order]
        self.first = np.searchsorted(src[order], np.arange(n + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``nodes``, neighbour, slot) of all their neighbours, in order."""
        n = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(nodes)), n), self.to[at], self.slot[at]


def breadth_first(near: Rows, n: int, roots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(nodes of each level in the order of their visit, parents, slots to parents); -1 where there is none."""
    parent, by, seen = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
    seen[roots] = True
    out, level = [], roots
    while len(level):
        out.append(level)
        of, to, slot = near.of(level)
        new = ~seen[to]
        of, to, slot = of[new], to[new], slot[new]
        at = np.sort(np.unique(to, return_index=True)[1])
        parent[to[at]], by[to[at]] = level[of[at]], slot[at]
        level = to[at]
        seen[level] = True
    return out, parent, by


def block_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each slot a number that the edges of its block share; -1 for loops.

    Tarjan and Vishkin on a breadth-first forest: tree edges, named by their lower nodes, share a block where an edge
    outside the forest joins two subtrees, or leaves the subtree of the node above.
    """
    roots = np.unique(union_labels(n, src, dst))
    levels, parent, by = breadth_first(Rows(n, src, dst, True), n, roots)
    size, pre = np.ones(n, np.int64), np.zeros(n, np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    pre[roots] = np.cumsum(size[roots]) - size[roots]
    for level in levels[1:]:
        before = np.cumsum(size[level]) - size[level]
        start = np.flatnonzero(np.diff(parent[level], prepend=-1))  # the first child of each parent; siblings stand together
        before -= np.repeat(before[start], np.diff(start, append=len(level)))
        pre[level] = pre[parent[level]] + 1 + before
    off = np.ones(len(src), bool)
    off[by[by >= 0]] = False
    off &= src != dst
    a, b = src[off], dst[off]
    low, high = pre.copy(), pre.copy()
    for x, y in ((a, b), (b, a)):
        np.minimum.at(low, x, pre[y])
        np.maximum.at(high, x, pre[y])
    for level in reversed(levels[1:]):
        np.minimum.at(low, parent[level], low[level])
        np.maximum.at(high, parent[level], high[level])
    kids = np.flatnonzero((parent >= 0) & (parent[parent] >= 0))
    above = parent[kids]
    leaves = (low[kids] < pre[above]) | (high[kids] >= pre[above] + size[above])
    apart = np.minimum(pre[a] + size[a], pre[b] + size[b]) <= np.maximum(pre[a], pre[b])
    group = union_labels(n, np.concatenate([kids[leaves], a[apart]]), np.concatenate([above[leaves], b[apart]]))
    out = np.full(len(src), -1)
    tree = np.flatnonzero(by >= 0)
    out[by[tree]] = group[tree]
    out[off] = group[np.where(pre[a] > pre[b], a, b)]
    return out


def low_links(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(slots of bridges, blocks as lists of slots) of an undirected multigraph; loops belong to no block."""
    label = block_labels(n, src, dst)
    order = np.argsort(label, kind="stable")
    order = order[label[order] >= 0]
    blocks = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(x)]
    return [x[0] for x in blocks if len(x) == 1], blocks


def fundamental_cycles(n: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, list[int]]]:
    """(slot of the closing edge, nodes in cycle order) for each edge outside a breadth-first forest."""
    out: dict[int, list[int]] = {}
    for slot, _, node in sorted(zip(*(x.tolist() for x in cycle_rows(n, src, dst)))):
        out.setdefault(slot, []).append(node)
    return list(out.items())


def cycle_rows(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of the closing edge, position, node) of a cycle for each edge outside a breadth-first forest, in cycle order.

    Both ends of all these edges climb at once, the lower one first, until they meet.
    """
    levels, parent, by = breadth_first(Rows(n, src, dst, True), n, np.unique(union_labels(n, src, dst)))
    depth = np.zeros(n, np.int64)
    for k, level in enumerate(levels):
        depth[level] = k
    off = np.ones(len(src), bool)
    off[by[by >= 0]] = False
    slots = np.flatnonzero(off)
    a, b, left, right = src[slots].copy(), dst[slots].copy(), np.ones(len(slots), np.int64), np.ones(len(slots), np.int64)
    lefts, rights = [(np.arange(len(slots)), left - 1, a.copy())], [(np.arange(len(slots)), right - 1, b.copy())]
    active = np.flatnonzero(a != b)
    while len(active):
        up = depth[a[active]] >= depth[b[active]]
        for ends, length, told, who in ((a, left, lefts, active[up]), (b, right, rights, active[~up])):
            ends[who] = parent[ends[who]]
            told.append((who, length[who].copy(), ends[who]))
            length[who] += 1
        active = active[a[active] != b[active]]
    who, at, node = (np.concatenate(x) for x in zip(*lefts))
    who2, at2, node2 = (np.concatenate(x) for x in zip(*rights))
    keep = at2 < right[who2] - 1  # the meeting node is told on the left
    who2, at2, node2 = who2[keep], at2[keep], node2[keep]
    return slots[np.concatenate([who, who2])], np.concatenate([at, left[who2] + right[who2] - 2 - at2]), np.concatenate([node, node2])


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest member of each node's strongly connected component."""
    ahead, back = adjacency(n, src, dst, False), adjacency(n, dst, src, False)
    seen, finished = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        walk = [(root, iter(ahead[root]))]
        while walk:
            v, rest = walk[-1]
            for w, _ in rest:
                if not seen[w]:
                    seen[w] = True
                    walk.append((w, iter(ahead[w])))
                    break
            else:
                finished.append(v)
                walk.pop()
    label = np.full(n, -1, np.int64)
    for root in reversed(finished):
        if label[root] >= 0:
            continue
        members, stack = [], [root]
        label[root] = root
        while stack:
            v = stack.pop()
            members.append(v)
            for w, _ in back[v]:
                if label[w] < 0:
                    label[w] = root
                    stack.append(w)
        label[members] = min(members)
    return label


def union_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking and jumping on whole arrays."""
    label = np.arange(n)
    a, b = src, dst
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _heap(near: Rows, n: int, weight: np.ndarray, sources: np.ndarray, cutoff: float) -> np.ndarray:
    """Distances one node at a time."""
    d, done, heap = np.full(n, np.inf), np.zeros(n, bool), [(0.0, int(s)) for s in sources]
    d[sources] = 0.0
    while heap:
        _, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        span = slice(near.first[v], near.first[v + 1])
        new = d[v] + weight[near.slot[span]]
        for u, x in zip(near.to[span].tolist(), new.tolist()):
            if x < d[u] and x <= cutoff:
                d[u] = x
                heapq.heappush(heap, (x, u))
    return d


def distances(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, directed: bool, sources: list[int], cutoff: float | None, most: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, hops, predecessor) by node, by least (distance, hops, predecessor); unreached distances are inf, missing predecessors -1.

    All nodes that got nearer pass it on at once; once that has looked at ``most`` times all edges or taken a thousand
    rounds, the heap goes on instead.
    """
    near, cutoff = Rows(n, src, dst, not directed), np.inf if cutoff is None else cutoff
    starts = np.unique(np.array(sources, np.int64))
    d, hops, pred = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1)
    d[starts] = 0.0
    front, work, rounds = starts, 0, 0
    while len(front):
        of, to, slot = near.of(front)
        work, rounds = work + len(to), rounds + 1
        if work > most * (len(near.to) + 1) or rounds > 1000:
            d = _heap(near, n, weight, starts, cutoff)
            break
        new = d[front][of] + weight[slot]
        nearer = (new < d[to]) & (new <= cutoff)
        np.minimum.at(d, to[nearer], new[nearer])
        front = np.unique(to[nearer])
    # hops and predecessors along the edges that make up the distances
    own = np.repeat(np.arange(n), np.diff(near.first))
    tight = np.isfinite(d[own]) & (d[own] + weight[near.slot] == d[near.to])
    a, b = own[tight], near.to[tight]
    levels, _, _ = breadth_first(Rows(n, a, b, False), n, starts)
    for k, level in enumerate(levels):
        hops[level] = k
    last = hops[a] + 1 == hops[b]
    last &= ~np.isin(b, starts)
    least = np.full(n, n)
    np.minimum.at(least, b[last], a[last])
    pred[least < n] = least[least < n]
    return d, hops, pred


def visit_order(n: int, src: np.ndarray, dst: np.ndarray, directed: bool, source: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes in breadth-first order, their levels, their parents), neighbours by ascending slot."""
    found, parent, _ = breadth_first(Rows(n, src, dst, not directed), n, np.array([source]))
    nodes = np.concatenate(found)
    return nodes, np.repeat(np.arange(len(found)), [len(x) for x in found]), parent[nodes]


def levels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Longest number of edges that lead to each node; -1 for nodes on or behind a cycle."""
    level, waiting = np.zeros(n, np.int64), np.bincount(dst, minlength=n)
    done, now = np.zeros(n, bool), np.flatnonzero(waiting == 0)
    near = Rows(n, src, dst, False)
    while len(now):
        done[now] = True
        out = near.of(now)[2]
        np.maximum.at(level, dst[out], level[src[out]] + 1)
        np.subtract.at(waiting, dst[out], 1)
        now = np.unique(dst[out][waiting[dst[out]] == 0])
    return np.where(done, level, -1)


def lengths(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, level: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest length of a path to each node, the node before it or -1), from lengths at the start; ties go to smaller (level, node)."""
    dist, back = start.tolist(), [-1] * len(start)
    slots = np.lexsort((dst, src, level[src]))
    for a, b, w in zip(src[slots].tolist(), dst[slots].tolist(), weight[slots].tolist()):
        if dist[a] + w > dist[b]:
            dist[b], back[b] = dist[a] + w, a
    return np.array(dist, float), np.array(back, np.int64)


def longest(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, level: np.ndarray) -> tuple[float, list[int]]:
    """(length, nodes) of a longest path; lengths start at 0 at every node; ties go to smaller nodes."""
    if not n:
        return 0.0, []
    dist, back = lengths(src, dst, weight, level, np.zeros(n))
    top = float(dist.max())
    if top <= 0:
        return 0.0, [0]
    path = [int(dist.argmax())]
    while back[path[-1]] >= 0 and dist[path[-1]] > 0:
        path.append(int(back[path[-1]]))
    return top, path[::-1]


def blocks_between(n: int, m: int, nodes: np.ndarray, blocks: np.ndarray, source: int, targets: np.ndarray) -> np.ndarray:
    """Whether each of m blocks lies on the way from the source to a target; block k holds node i for each pair (i, k)."""
    by = [np.argsort(x, kind="stable") for x in (nodes, blocks)]
    first = [np.searchsorted(x[o], np.arange(k + 1)) for x, o, k in zip((nodes, blocks), by, (n, m))]
    above, out = np.full(n, -1), np.zeros(m, bool)  # the block by which a node was reached
    entry, seen = np.full(m, -1), np.zeros(n, bool)  # the node by which a block was entered
    seen[source] = True
    front = [source]
    while front:
        after = []
        for v in front:
            for k in blocks[by[0][first[0][v] : first[0][v + 1]]].tolist():
                if entry[k] >= 0:
                    continue
                entry[k] = v
                inside = nodes[by[1][first[1][k] : first[1][k + 1]]]
                new = inside[~seen[inside]]
                seen[new], above[new] = True, k
                after += new.tolist()
        front = after
    for v in targets.tolist():
        while v != source and seen[v] and not out[above[v]]:
            out[above[v]] = True
            v = entry[above[v]]
    return out
