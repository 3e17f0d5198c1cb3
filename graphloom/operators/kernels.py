"""Graph algorithms within one task, on nodes numbered from 0. All are iterative.

``Component`` gives the order-exact cycles of one weakly connected component,
or of several: depth-first search never leaves such a component, so components
can be handled apart and their results merged by the order of the nodes that
the searches started from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(a: Iterable[int | None], b: Iterable[int | None]) -> tuple[list[int], tuple[np.ndarray, np.ndarray]]:
    """The distinct nodes in ascending order, and the pairs as their places; only pairs without a null."""
    names = sorted({x for x in (*a, *b) if x is not None})
    place = {x: i for i, x in enumerate(names)}
    pairs = np.array([(place[x], place[y]) for x, y in zip(a, b) if x is not None and y is not None], dtype=np.int64).reshape(-1, 2)
    return names, (pairs[:, 0], pairs[:, 1])


def numbered_names(rows: pa.Table) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
    """The distinct names of ``rows`` (src, dst), and the rows as their places."""
    src, dst = (rows.column(c).combine_chunks() for c in ("src", "dst"))
    names = pc.unique(pa.concat_arrays([src, dst]))
    s, d = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
    return names, (s, d)


def targets_of(n: int, sources: np.ndarray, targets: np.ndarray) -> list[list[int]]:
    """Each node's targets, in the order of the pairs."""
    order = np.argsort(sources, kind="stable")
    ends = np.cumsum(np.bincount(sources, minlength=n)).tolist()
    flat = targets[order].tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def last_of_paths(node: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``node``, which ascends, the last one stands that links ``node`` to ``to`` lead on to, and the number of steps. They close no ring."""
    at = np.searchsorted(node, to).clip(max=len(node) - 1)
    inside = node[at] == to
    at, dist = np.where(inside, at, np.arange(len(node))), inside.astype(np.int64)
    while not np.array_equal(after := at[at], at):
        dist += dist[at]
        at = after
    return at, dist


def search(out: Sequence[list[int]], starts: Iterable[int]) -> list[int]:
    """What one step or more lead to from ``starts``, in order of discovery."""
    seen: dict[int, None] = {}
    todo = list(starts)
    while todo:
        for to in out[todo.pop()]:
            if to not in seen:
                seen[to] = None
                todo.append(to)
    return list(seen)


def origins(out: Sequence[list[int]], starts: Sequence[int], times: int = 10) -> list[int]:
    """For each node the last one that all ways from ``starts`` to it share and that is a start or a place where such ways meet; -1 if none leads to it.

    Places where ways meet are taken up until there are no further ones. If
    ``times`` searches do not find all of them, each node is its own.
    """
    taken = list(starts)
    for _ in range(times):
        origin = [-1] * len(out)
        for x in taken:
            origin[x] = x
        todo = list(taken)
        while todo:
            at = todo.pop()
            for to in out[at]:
                if origin[to] < 0:
                    origin[to] = origin[at]
                    todo.append(to)
        more = {to for at, own in enumerate(origin) if own >= 0 for to in out[at] if origin[to] != own and origin[to] != to}
        if not more:
            return origin
        taken += more
    return [x if own >= 0 else -1 for x, own in enumerate(origin)]


def strong(out: Sequence[list[int]]) -> Iterator[tuple[int, list[int]]]:
    """(node the search started from, members with the last discovered first) of each strong component, in the order they are completed.

    Searches start from the nodes in ascending order and follow targets in theirs.
    """
    n = len(out)
    index, low = [-1] * n, [0] * n
    waiting = bytearray(n)
    stack: list[int] = []
    seen = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        calls = [(start, iter(out[start]))]
        index[start] = low[start] = seen
        seen += 1
        stack.append(start)
        waiting[start] = 1
        while calls:
            node, targets = calls[-1]
            for to in targets:
                if index[to] < 0:
                    index[to] = low[to] = seen
                    seen += 1
                    stack.append(to)
                    waiting[to] = 1
                    calls.append((to, iter(out[to])))
                    break
                if waiting[to] and index[to] < low[node]:
                    low[node] = index[to]
            else:
                calls.pop()
                if calls and low[node] < low[calls[-1][0]]:
                    low[calls[-1][0]] = low[node]
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        waiting[members[-1]] = 0
                    yield start, members


# kernels over (a, b) pairs of nodes, in which a pair without b stands for a node alone


def reached(a: list[int], b: list[int | None]) -> tuple[list[int]]:
    """What leads on from the nodes that stand alone."""
    names, (s, d) = numbered(a, b)
    place = {x: i for i, x in enumerate(names)}
    starts = {place[x] for x, y in zip(a, b) if y is None}
    return ([names[i] for i in search(targets_of(len(names), s, d), starts)],)


def weak_labels(a: list[int], b: list[int | None]) -> tuple[list[int], list[int]]:
    names, (s, d) = numbered(a, b)
    return names, [names[i] for i in least_labels(len(names), s, d).tolist()]


def least_labels(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The least node that pairs, taken in both directions, connect each node to."""
    label = np.arange(n)
    while True:
        after = label.copy()
        least = np.minimum(label[s], label[d])
        for at in (s, d, label[s], label[d]):
            np.minimum.at(after, at, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def strong_labels(a: list[int], b: list[int | None]) -> tuple[list[int], list[int]]:
    names, (s, d) = numbered(a, b)
    label = list(range(len(names)))
    for _, members in strong(targets_of(len(names), s, d)):
        least = min(members)
        for i in members:
            label[i] = least
    return names, [names[i] for i in label]


def ends_of_paths(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The nodes ``a``, each of which links to its ``b`` only and is linked to once at most, and the last node of each one's path; of a ring all but the least node, which is its last."""
    to = dict(zip(a, b))
    firsts = to.keys() - set(b)
    last: dict[int, int] = {}
    for first in (*sorted(firsts), *sorted(to.keys() - firsts)):
        if first in last:
            continue
        path, at = [first], to[first]
        while at in to and at != first:
            path.append(at)
            at = to[at]
        last.update(dict.fromkeys(path, at))
    return [x for x in a if x != last[x]], [last[x] for x in a if x != last[x]]


class Component:
    """Nodes in their order, each with its targets in theirs. Results hold names."""

    def __init__(self, nodes: Iterable[tuple[int, str]], edges: Iterable[tuple[int, int, int]]):
        """``nodes``: (place in the graph's order, name); ``edges``: (source's place, position, target's place)."""
        known = sorted(nodes)
        self.order = [o for o, _ in known]
        self.names = [x for _, x in known]
        self.place = place = {o: i for i, o in enumerate(self.order)}
        self.out: list[list[int]] = [[] for _ in known]
        for source, _, target in sorted(edges):
            self.out[place[source]].append(place[target])

    def named(self, numbers: Iterable[int]) -> list[str]:
        return [self.names[i] for i in numbers]

    def _closes(self, node: int, goal: int, allowed: set[int], path: set[int]) -> bool:
        """Whether ``goal`` can be reached from ``node`` through ``allowed`` nodes off the path."""
        seen, todo = {node}, [node]
        while todo:
            for to in self.out[todo.pop()]:
                if to == goal:
                    return True
                if to in allowed and to not in path and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return False

    def cycles_through(self, start: int, least: int = 0) -> Iterator[list[int]]:
        """Closed chains of the simple cycles through ``start`` and nodes from ``least`` on, in the order of target positions.

        A node from which a search found no way back is blocked until a node
        that it leads to is off the path again, so no dead end is searched
        twice between two cycles.
        """
        path, blocked, waiting = [start], {start}, {}
        todo, closed = [iter(self.out[start])], [False]
        while todo:
            node = path[-1]
            for to in todo[-1]:
                if to == start:
                    closed[-1] = True
                    yield [*path, start]
                elif to >= least and to not in blocked:
                    path.append(to)
                    blocked.add(to)
                    todo.append(iter(self.out[to]))
                    closed.append(False)
                    break
            else:
                todo.pop()
                path.pop()
                if closed.pop():
                    if closed:
                        closed[-1] = True
                    free = [node]
                    while free:
                        x = free.pop()
                        if x in blocked:
                            blocked.discard(x)
                            free += waiting.pop(x, ())
                else:
                    for to in self.out[node]:
                        if to >= least:
                            waiting.setdefault(to, set()).add(node)

    def first_cycle(self, start: int, members: set[int]) -> list[int]:
        """The closed chain from ``start`` that a search in target order closes first within ``members``, its strong component.

        The path so far can always be closed, so a sole way on needs no test:
        a ring takes linear time.
        """
        path, on = [start], {start}
        while True:
            ways = [to for to in self.out[path[-1]] if to == start or to in members and to not in on]
            to = next((x for x in ways[:-1] if x == start or self._closes(x, start, members, on)), ways[-1])
            if to == start:
                return [*path, start]
            path.append(to)
            on.add(to)
