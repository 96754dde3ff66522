"""Vantage-point trees over unit vectors (numpy only).

Distances are chord lengths, ``sqrt(2 - 2 cos)``, a metric, so the triangle
inequality prunes exactly. ``factor`` divides the search radius used for
pruning only: 1 is exact, larger values skip subtrees whose boundary the query
merely brushes. Every reported similarity is always the exact one.
"""

from __future__ import annotations

import numpy as np


def chord(cosine):
    """Chord length of a cosine."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.asarray(cosine, dtype=np.float64), 0.0))


def choose_split(points, members, rng, tries=8, probe=1024, shell=0.05, least=0.03):
    """(vantage point, radius) of the best of some candidate splits, or None.

    Candidates are random rows and the mean directions of their closest rows
    (the middle of a topic sees its own topic near and all others far), with
    radii at quantiles of the distances. A search has to follow the rows within
    ``shell`` of a radius on both sides, so the best candidate has the least
    extra work, log(1 + share in the shell), per bit of separation. Rows that
    all lie at one distance give no split.
    """
    sample = points[members if len(members) <= probe else rng.choice(members, probe, replace=False)]
    seeds = sample[rng.choice(len(sample), min(tries, len(sample)), replace=False)]
    close = sample @ seeds.T
    near = max(2, len(sample) // 25)
    means = []
    for i in range(len(seeds)):
        mean = sample[np.argpartition(-close[:, i], min(near, len(sample) - 1))[:near]].mean(0)
        again = sample[np.argpartition(-(sample @ mean), min(near, len(sample) - 1))[:near]].mean(0)
        means.append(again / max(np.linalg.norm(again), 1e-12))
    vantages = np.concatenate([seeds, np.asarray(means, dtype=np.float32)]).astype(np.float32)
    best = None
    for vantage in vantages:
        d = np.sort(chord(sample @ vantage))
        cuts = np.quantile(d, np.linspace(least, 1 - least, 33))
        g = np.searchsorted(d, cuts, side="right") / len(d)
        ok = (g > 0) & (g < 1)
        if not ok.any():
            continue
        cuts, g = cuts[ok], g[ok]
        both = (np.searchsorted(d, cuts + shell) - np.searchsorted(d, cuts - shell)) / len(d)
        score = (np.log1p(both) + 0.01) / -(g * np.log2(g) + (1 - g) * np.log2(1 - g))
        at = int(np.argmin(score))
        if best is None or score[at] < best[0]:
            best = (score[at], vantage, float(cuts[at]))
    return best and best[1:]


class Tree:
    """A tree over ``points`` (rows of unit vectors); leaves hold row numbers."""

    def __init__(self, points, leaf=96, seed=7, max_leaves=None):
        self.vantage, self.radius, self.inner, self.outer, self.leaves = [], [], [], [], []
        self.dim = points.shape[1]
        rng = np.random.default_rng(seed)
        if max_leaves:
            leaf = max(leaf, -(-len(points) // max_leaves))
        self.root = self._grow(points, np.arange(len(points)), leaf, rng)
        self.vantage = np.asarray(self.vantage, dtype=np.float32).reshape(-1, self.dim)

    def _grow(self, points, members, leaf, rng):
        # an explicit stack: a lopsided tree may be deeper than Python's recursion
        top = [None]
        stack = [(members, top, 0)]
        while stack:
            rows, holder, slot = stack.pop()
            split = choose_split(points, rows, rng) if len(rows) > leaf else None
            near = chord(points[rows] @ split[0]) <= split[1] if split else None
            if split is None or near.all() or not near.any():
                holder[slot] = ~len(self.leaves)
                self.leaves.append(rows)
                continue
            node = len(self.vantage)
            holder[slot] = node
            self.vantage.append(split[0])
            self.radius.append(split[1])
            self.inner.append(None)
            self.outer.append(None)
            stack.append((rows[near], self.inner, node))
            stack.append((rows[~near], self.outer, node))
        return top[0]

    def place(self, vectors):
        """The one leaf of each vector."""
        out = np.zeros(len(vectors), dtype=np.int64)
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = ~node
                continue
            near = chord(vectors[rows] @ self.vantage[node]) <= self.radius[node]
            stack.append((self.inner[node], rows[near]))
            stack.append((self.outer[node], rows[~near]))
        return out

    def visits(self, vectors, reach):
        """(query row, leaf) of every leaf within ``reach`` (one, or one a query) of a query."""
        reach = np.broadcast_to(np.asarray(reach, dtype=np.float64), (len(vectors),))
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield rows, ~node
                continue
            d = chord(vectors[rows] @ self.vantage[node])
            stack.append((self.inner[node], rows[d - reach[rows] <= self.radius[node]]))
            stack.append((self.outer[node], rows[d + reach[rows] > self.radius[node]]))

    def within(self, points, vectors, cosine, factor):
        """(query row, point row, cosine) of the pairs of at least ``cosine``."""
        found = []
        for rows, leaf in self.visits(vectors, chord(cosine) / factor):
            own = self.leaves[leaf]
            s = vectors[rows] @ points[own].T
            q, p = np.nonzero(s >= cosine - 1e-5)
            if len(q):
                q, p = rows[q], own[p]
                exact = np.einsum("ij,ij->i", vectors[q].astype(np.float64), points[p].astype(np.float64))
                keep = exact >= cosine - 1e-7
                found.append((q[keep], p[keep], exact[keep]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def nearest(self, points, vectors, k, factor, worst=None):
        """(point rows, cosines), each (queries, k), best first; row -1 where there are fewer.

        The home leaf comes first and gives each query a radius; the rest of
        the tree is then walked in batches, each query's radius shrinking as
        its list fills. ``worst`` may give a cosine a query has already reached.
        """
        n = len(vectors)
        best = np.full((n, k), -2.0, dtype=np.float32)
        ids = np.full((n, k), -1, dtype=np.int64)
        floor = np.full(n, -2.0) if worst is None else np.asarray(worst, dtype=np.float64)
        home = self.place(vectors)

        def look(rows, leaf):
            own = self.leaves[leaf]
            s = vectors[rows] @ points[own].T
            take = min(k, s.shape[1])
            part = np.argpartition(-s, take - 1, axis=1)[:, :take]
            all_s = np.concatenate([best[rows], np.take_along_axis(s, part, 1)], axis=1)
            all_i = np.concatenate([ids[rows], own[part]], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
            best[rows] = np.take_along_axis(all_s, order, 1)
            ids[rows] = np.take_along_axis(all_i, order, 1)

        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                look(rows, home[rows[0]])
        # near sides first: nodes wait on a stack with the queries that may need them
        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            node, rows, gap = stack.pop()
            keep = gap <= chord(np.maximum(best[rows, -1], floor[rows])) / factor
            rows = rows[keep]
            if not len(rows):
                continue
            if node < 0:
                rows = rows[home[rows] != ~node]
                if len(rows):
                    look(rows, ~node)
                continue
            gap = gap[keep]
            d = chord(vectors[rows] @ self.vantage[node])
            over = d - self.radius[node]
            near = over <= 0
            inner, outer = self.inner[node], self.outer[node]
            stack.append((outer, rows[near], np.maximum(gap[near], -over[near])))
            stack.append((inner, rows[~near], np.maximum(gap[~near], over[~near])))
            stack.append((outer, rows[~near], gap[~near]))
            stack.append((inner, rows[near], gap[near]))
        return ids, best
