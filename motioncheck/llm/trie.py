"""A path-compressed trie of ordered token sets, joined with itself."""

from __future__ import annotations

import numpy as np

#: A longer edge is cut, so that bounds are tested along it.
EDGE = 32


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Trie:
    """Sets as ascending token ranks, in lexicographic order; flat[at[s]:at[s + 1]] is set s."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.flat, self.at, self.size = flat, at, np.diff(at)
        m = len(self.size)
        nodes: list[tuple[int, int, int, int, int]] = []  # parent, depth before, depth after, first set, end set
        todo = [(0, m, 0, -1)]
        shared = np.zeros(m, np.int64)
        for s in range(1, m):
            n = min(self.size[s - 1], self.size[s])
            unlike = flat[at[s - 1] : at[s - 1] + n] != flat[at[s] : at[s] + n]
            shared[s] = unlike.argmax() if unlike.any() else n
        while todo:  # each range of sets that agree up to a depth, cut where they part
            a, b, depth, parent = todo.pop()
            to = int(self.size[a]) if b - a == 1 else int(min(shared[a + 1 : b].min(), self.size[a]))
            while depth < to:
                nodes.append((parent, depth, min(to, depth + EDGE), a, b))
                parent, depth = len(nodes) - 1, min(to, depth + EDGE)
            if b - a > 1:
                cuts = [a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] == to)).tolist(), b]
                todo += [(x, y, to, parent) for x, y in zip(cuts, cuts[1:]) if not (self.size[x] == to and y - x == 1)]
        table = np.array(nodes, np.int64).reshape(-1, 5)
        self.parent, before, self.depth, self.lo, self.hi = table.T
        self.start, self.length = at[self.lo] + before, self.depth - before
        self.last = flat[at[self.lo] + self.depth - 1] if len(table) else table[:, 0]
        cuts = np.stack([self.lo, self.hi], 1).ravel()
        padded = np.append(self.size, 0)
        self.least = np.minimum.reduceat(padded, cuts)[::2] if len(table) else cuts
        self.most = np.maximum.reduceat(padded, cuts)[::2] if len(table) else cuts
        self.ends = np.where(self.size[self.lo] == self.depth, self.lo, -1) if len(table) else cuts
        order = np.argsort(self.parent, kind="stable")
        self.kids, own = order, self.parent[order]
        self.kid_at = np.searchsorted(own, np.arange(-1, len(table) + 1))  # of node n at n + 1

    def links(self, of: int, mark: np.ndarray, group: np.ndarray, num: int, den: int) -> list[int]:
        """Later sets whose Jaccard similarity with set `of` is num / den or more; sets already in its group are left out.

        mark: for each token, if the set has it. The walk goes down all edges of a level at once:
        a node's overlap is its parent's and its own edge's, and its subtree is left when no set
        in it could still reach the similarity with the tokens that remain on both sides.
        """
        own = self.flat[self.at[of] : self.at[of + 1]]
        n, found = len(own), []
        node = self.kids[self.kid_at[0] : self.kid_at[1]]
        overlap = np.zeros(len(node), np.int64)
        while True:
            live = (self.hi[node] > of + 1) & ((self.hi[node] - self.lo[node] > 1) | (group[self.lo[node]] != group[of]))
            node, overlap = node[live], overlap[live]
            if not len(node):
                return found
            length = self.length[node]
            hits = mark[self.flat[_ranges(self.start[node], length)]]
            overlap = overlap + np.add.reduceat(hits, np.cumsum(length) - length, dtype=np.int64)
            rest = n - np.searchsorted(own, self.last[node], "right")
            depth = self.depth[node]
            best = np.clip(depth + rest, self.least[node], self.most[node])
            most = overlap + np.minimum(best - depth, rest)
            live = most * (num + den) >= num * (n + best)
            node, overlap = node[live], overlap[live]
            end = self.ends[node]
            done = (end > of) & (overlap * (num + den) >= num * (n + self.size[end]))
            found += end[done].tolist()
            count = self.kid_at[node + 2] - self.kid_at[node + 1]
            overlap = np.repeat(overlap, count)
            node = self.kids[_ranges(self.kid_at[node + 1], count)]


def self_join(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (two indices) that connect all sets whose Jaccard similarity is num / den or more.

    Links between sets that earlier links connect already are left out; no two groups that a
    link would connect stay apart. Tokens are ordered by their frequency here, rare ones first.
    """
    if len(sets) < 2:
        return []
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int32)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    cuts = np.cumsum([0, *map(len, sets)])
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts, cuts[1:])]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i4").tobytes())
    size = np.array([len(ranked[i]) for i in order])
    trie = Trie(np.concatenate([ranked[i] for i in order]), np.concatenate([[0], np.cumsum(size)]))
    group, mark, links = np.arange(len(sets)), np.zeros(len(tokens), bool), []
    members = [[i] for i in range(len(sets))]
    for s in range(len(sets) - 1):
        own = trie.flat[trie.at[s] : trie.at[s + 1]]
        mark[own] = True
        for t in trie.links(s, mark, group, num, den):
            if group[t] != group[s]:
                links.append((order[s], order[t]))
                into, gone = sorted((int(group[s]), int(group[t])), key=lambda g: -len(members[g]))
                group[members[gone]] = into  # the smaller group moves
                members[into] += members[gone]
        mark[own] = False
    return links
