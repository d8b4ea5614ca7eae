"""Kernels on the graph of one code object: components, reachability and dominators in memory that grows with nodes and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Targets that reachability looks at in one pass; a node has a bit for each of them.
BLOCK = 8192


def adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """(first, after): the successors of v are after[first[v]:first[v + 1]]."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()


def components(n: int, first: list[int], after: list[int]) -> list[int]:
    """The strongly connected component of each node; every component has a smaller number than those that reach it."""
    comp, low, seen = [-1] * n, [0] * n, [0] * n
    clock = count = 0
    open_: list[int] = []
    for start in range(n):
        if seen[start]:
            continue
        walk = [(start, -1)]
        while walk:
            v, i = walk.pop()
            if i < 0:
                clock += 1
                seen[v] = low[v] = clock
                open_.append(v)
                i = first[v]
            while i < first[v + 1]:
                w = after[i]
                i += 1
                if not seen[w]:
                    walk += [(v, i), (w, -1)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], seen[w])
            else:
                if low[v] == seen[v]:
                    while comp[v] < 0:
                        comp[open_.pop()] = count
                    count += 1
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
    return comp


class Condensed:
    """A graph of nodes 0 to n - 1 with its cycles drawn together."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, self.comp = n, np.array(components(n, *adjacency(n, src, dst)), np.int64)
        self.count = int(self.comp.max()) + 1 if n else 0
        a, b = self.comp[src], self.comp[dst]
        self.cyclic = np.zeros(self.count, bool)
        self.cyclic[a[a == b]] = True  # an edge within a component closes a cycle
        pairs = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        self.first, self.after = adjacency(self.count, pairs[:, 0], pairs[:, 1])

    def reached(self) -> Iterator[tuple[int, list[int]]]:
        """(low, bits) for each block of targets: bit i of bits[c] is set if component c reaches node low + i by an edge or more."""
        for low in range(0, self.n, BLOCK):
            own = [0] * self.count
            for i, c in enumerate(self.comp[low : low + BLOCK].tolist()):
                own[c] |= 1 << i
            bits = [0] * self.count
            for c in range(self.count):
                b = own[c] if self.cyclic[c] else 0
                for s in self.after[self.first[c] : self.first[c + 1]]:
                    b |= bits[s] | own[s]
                bits[c] = b
            yield low, bits


def labels_reached(after: dict, start: list[tuple], end: dict, most: int) -> tuple[list, list, list[int]]:
    """(sources, targets, steps) side by side: from the nodes of which source labels those of which target labels are reached by an edge or more, and by how few.

    after: the successors of a node; start: (label, node) pairs; end: the target labels of a node. All labels go together, a bit each.
    """
    labels = list({label: None for label, _ in start})
    bit, now = {label: 1 << i for i, label in enumerate(labels)}, {}
    for label, node in start:
        now[node] = now.get(node, 0) | bit[label]
    seen, hit, rows = {}, {}, ([], [], [])
    for steps in range(1, most + 1):
        new = {}
        for v, bits in now.items():
            for w in after.get(v, ()):
                new[w] = new.get(w, 0) | bits
        now = {w: b for w, bits in new.items() if (b := bits & ~seen.get(w, 0))}
        if not now:
            return rows
        for w, bits in now.items():
            seen[w] = seen.get(w, 0) | bits
            for target in end.get(w, ()):
                b = bits & ~hit.get(target, 0)
                hit[target] = hit.get(target, 0) | b
                while b:
                    low = b & -b
                    b ^= low
                    for column, x in zip(rows, (labels[low.bit_length() - 1], target, steps), strict=True):
                        column.append(x)
    raise RuntimeError(f"paths of more than {most} edges")


def dominators(n: int, root: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idom, enter, leave): each node's immediate dominator, -1 for the root and what it does not reach, and its interval in the tree.

    By semidominators: in the numbering of a depth-first search they are minima over predecessors, found with compressed paths;
    the immediate dominator is the nearest tree ancestor at or above the semidominator.
    """
    first, after = adjacency(n, src, dst)
    number, order, parent = [-1] * n, [], []
    walk = [(root, -1)]
    while walk:
        v, above = walk.pop()
        if number[v] >= 0:
            continue
        number[v] = len(order)
        order.append(v)
        parent.append(above)
        walk += [(w, number[v]) for w in reversed(after[first[v] : first[v + 1]]) if number[w] < 0]
    k = len(order)
    into, before = adjacency(n, dst, src)
    semi, label, up = list(range(k)), list(range(k)), parent[:]
    for w in range(k - 1, 0, -1):
        node = order[w]
        for p in before[into[node] : into[node + 1]]:
            v = number[p]
            if v < 0:
                continue
            if v > w:
                path, x = [], v
                while up[x] > w:
                    path.append(x)
                    x = up[x]
                for y in reversed(path):
                    if semi[label[up[y]]] < semi[label[y]]:
                        label[y] = label[up[y]]
                    up[y] = up[x]
                v = label[v]
            semi[w] = min(semi[w], semi[v])
    idom, size = parent[:], [1] * k
    for w in range(1, k):
        while idom[w] > semi[w]:
            idom[w] = idom[idom[w]]
    for w in range(k - 1, 0, -1):
        size[idom[w]] += size[w]
    at, free = [0] * k, [1] * k
    for w in range(1, k):
        at[w] = free[idom[w]]
        free[idom[w]] += size[w]
        free[w] = at[w] + 1
    out = np.full((3, n), -1, np.int64)
    place = np.array(order)
    out[0, place[1:]] = place[np.array(idom[1:], np.int64)]
    out[1, place], out[2, place] = at, np.add(at, size)
    return out[0], out[1], out[2]
