"""Which edges of one epoch's graph dependence needs, without a row for each source and node.

The in-edges of a node stand in order; of all sources that reach the node, one chooses the first in-edge whose tail it reaches.  An edge is therefore needed if
a source reaches its tail and no tail before it.  Two tails of one strongly connected component have the same sources, and all edges after one from the node's
own component are reached before.  A component's sources are a set of at most ``MOST`` members, or one token that stands for its set.
"""

from __future__ import annotations

from array import array

import numpy as np

MOST = 32  # members of a set before a token stands for it
MARKED = 1 << 28  # bytes of tokens written out as bits at a time


def components(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, int]:
    """The strongly connected component of each node, and their number; a component has a higher number than those it reaches."""
    order = np.argsort(src, kind="stable")
    after, heads = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1))
    at, ends = heads[:-1].tolist(), heads[1:].tolist()
    place, low, of = [0] * n, [0] * n, [-1] * n
    seen = count = 0
    open_nodes: list[int] = []
    for root in range(n):
        if place[root]:
            continue
        seen += 1
        place[root] = low[root] = seen
        open_nodes.append(root)
        path = [root]
        while path:
            v = path[-1]
            i = at[v]
            if i < ends[v]:
                at[v] = i + 1
                w = after[i]
                if not place[w]:
                    seen += 1
                    place[w] = low[w] = seen
                    open_nodes.append(w)
                    path.append(w)
                elif of[w] < 0 and place[w] < low[v]:
                    low[v] = place[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == place[v]:
                while True:
                    w = open_nodes.pop()
                    of[w] = count
                    if w == v:
                        break
                count += 1
    return np.array(of, np.int64), count


class Sources:
    """The sources that reach each component: members below ``count`` are components that are sources themselves, those from ``count`` on are tokens."""

    def __init__(self, count: int, cause: np.ndarray, effect: np.ndarray, own: np.ndarray, backward: bool):
        pairs = np.unique(effect * count + cause)
        before, heads = (pairs % count).tolist(), np.searchsorted(pairs // count, np.arange(count + 1)).tolist()
        self.count, self.own = count, own.tolist()
        self.flat, self.start, self.stop = array("q"), array("q", bytes(8 * count)), array("q", bytes(8 * count))
        self.tokens: list[tuple] = []
        self.written: dict[int, bytes] = {}
        self.outside: dict[tuple, list[int]] = {}
        for c in range(count) if backward else range(count - 1, -1, -1):
            came = before[heads[c] : heads[c + 1]]
            if len(came) == 1 and not self.own[c]:
                self.start[c], self.stop[c] = self.start[came[0]], self.stop[came[0]]
                continue
            found = set()
            for p in came:
                found.update(self.flat[self.start[p] : self.stop[p]])
            if self.own[c]:
                found.add(c)
            if len(found) > MOST:
                self.tokens.append(tuple(found))
                found = (count + len(self.tokens) - 1,)
            self.start[c] = len(self.flat)
            self.flat.extend(found)
            self.stop[c] = len(self.flat)

    def of(self, c: int) -> array:
        return self.flat[self.start[c] : self.stop[c]]

    def bits(self, token: int) -> bytes:
        """The token's components, a bit for each component."""
        found = self.written.get(token)
        if found is None:
            if (len(self.written) + 1) * (self.count // 8 + 1) > MARKED:
                self.written.clear()
            marks = np.zeros(self.count, bool)
            done, waiting = {token}, [token]
            while waiting:
                members = np.array(self.tokens[waiting.pop() - self.count])
                marks[members[members < self.count]] = True
                further = [t for t in members[members >= self.count].tolist() if t not in done]
                done.update(further)
                waiting.extend(further)
            found = self.written[token] = np.packbits(marks, bitorder="little").tobytes()
        return found

    def rest(self, token: int, other: int) -> list[int]:
        """A token's first components that another has not; none if it has all."""
        key = token, other
        if key not in self.outside:
            a, b = (np.frombuffer(self.bits(t), np.uint8) for t in key)
            left = a & ~b
            some = np.flatnonzero(left)[:8]
            self.outside[key] = [8 * k + bit for k in some.tolist() for bit in range(8) if left[k] >> bit & 1]
        return self.outside[key]

    def covered(self, member: int, members: set, tokens: list[int]) -> bool:
        """Whether ``members``, whose tokens are ``tokens``, hold all of a member."""
        if member in members:
            return True
        if member < self.count:
            return any(self.bits(t)[member >> 3] >> (member & 7) & 1 for t in tokens)
        for t in tokens:
            some = self.rest(member, t)
            if not some:
                return True
            if not all(self.covered(m, members, tokens) for m in some):
                return False
        if not all(m >= self.count or self.covered(m, members, tokens) for m in self.tokens[member - self.count]):
            return False
        left = np.frombuffer(self.bits(member), np.uint8)
        for t in tokens:
            left = left & ~np.frombuffer(self.bits(t), np.uint8)
        return all(m in members for m in np.flatnonzero(np.unpackbits(left, bitorder="little")).tolist())


def needed(n: int, src: np.ndarray, dst: np.ndarray, full: bool, of: np.ndarray | None = None, count: int = 0, backward: bool = False) -> np.ndarray:
    """The places of the edges that dependence needs, of edges of ``n`` nodes in order without parallels.

    Sources are all nodes (``full``) or those without in-edges.  ``of`` and ``count`` are the components if known; with ``backward`` they are those of the edges turned round.
    """
    if of is None:
        of, count = components(n, src, dst)
    tail, head = of[src], of[dst]
    outer = tail != head
    own = np.ones(count, bool)
    if not full:
        entered = np.zeros(n, bool)
        entered[dst] = True
        own[of[entered]] = False
    sources = Sources(count, tail[outer], head[outer], own, backward)
    order = np.argsort(dst, kind="stable")
    node, tail, inner = dst[order], tail[order], ~outer[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    group = np.repeat(first, np.diff(np.r_[first, len(node)]))
    earlier = np.cumsum(inner) - inner
    open_edges = np.flatnonzero(earlier == earlier[group])  # none from the node's own component before
    order, node, tail = order[open_edges], node[open_edges], tail[open_edges]
    once = np.sort(np.unique(node * count + tail, return_index=True)[1])  # the first of each component
    order, node, tail = order[once], node[once].tolist(), tail[once].tolist()
    kept, last, members, tokens = [], -1, set(), []
    for i, (v, c) in enumerate(zip(node, tail, strict=True)):
        if v != last:
            last, members, tokens = v, set(), []
        found = sources.of(c)
        if not all(sources.covered(m, members, tokens) for m in ((c,) if full else found)):
            kept.append(i)
        if i + 1 < len(node) and node[i + 1] == v:
            tokens.extend(m for m in found if m >= count and m not in members)
            members.update(found)
    return order[np.array(kept, np.int64)]
