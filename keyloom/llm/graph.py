"""A robust-pruned directed graph over unit vectors, built and searched in blocks.

Queries are searched in blocks of similar ones. Every query has a beam of its own and expands
its best open points; the points that the whole block meets in one step are compared with all
its queries by one matrix product, so a point that several queries pass is fetched once, and a
query also gains what its neighbours in the block meet. Similarity is the cosine of unit
vectors; distance is 1 - similarity.
"""

from __future__ import annotations

import numpy as np

_NONE = np.float32(-2.0)


class VectorGraph:
    """``graph[i]`` holds the neighbours of point i; unused places hold n."""

    def __init__(self, unit: np.ndarray, graph: np.ndarray, entries: np.ndarray) -> None:
        n, d = unit.shape
        self.n = n
        self.unit = np.vstack([unit, np.zeros((1, d), np.float32)])  # row n: no point
        self.graph, self.entries = graph, entries

    # -- search ----------------------------------------------------------------------------
    def search(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None, width: int = 4, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best ``beam`` points met on the way, best first.
        ``own``: points of the graph to start from besides the nearest entry points."""
        ids = np.full((len(queries), beam), self.n, dtype=np.int32)
        sims = np.full((len(queries), beam), _NONE, dtype=np.float32)
        if not len(queries) or not len(self.entries):
            return ids, sims
        starts = self._entry_points(queries)
        order = np.lexsort((starts[:, -1], starts[:, 0]))  # similar queries share a block
        for s in range(0, len(order), block):
            at = order[s : s + block]
            first = starts[at] if own is None else np.concatenate([starts[at], own[at, None]], axis=1)
            ids[at], sims[at] = self._search(queries[at], first, beam, width)
        return ids, sims

    def _entry_points(self, queries: np.ndarray, m: int = 4) -> np.ndarray:
        """The ``m`` entry points nearest to each query, the nearest first."""
        m = min(m, len(self.entries))
        out = np.empty((len(queries), m), dtype=np.int32)
        pool = self.unit[self.entries].T
        for s in range(0, len(queries), 4096):
            near = queries[s : s + 4096] @ pool
            top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(self.entries) else np.broadcast_to(np.arange(m), (len(near), m))
            best = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
            out[s : s + 4096] = self.entries[np.take_along_axis(top, best, 1)]
        return out

    def _search(self, q: np.ndarray, starts: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), self.n
        met, expanded = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        met[n] = expanded[n] = True
        ids = np.full((b, beam), n, dtype=np.int32)
        sims = np.full((b, beam), _NONE, dtype=np.float32)
        fresh = np.unique(starts)
        fresh = fresh[fresh < n]
        while len(fresh):
            met[fresh] = True
            near = q @ self.unit[fresh].T
            gain = near > sims.min(axis=1)[:, None]
            count = gain.sum(axis=1)
            most = int(count.max())
            if most:  # the gains of every query side by side; beyond them only empty places
                row, col = np.nonzero(gain)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                new_ids, new_sims = np.full((b, most), n, dtype=np.int32), np.full((b, most), _NONE, dtype=np.float32)
                new_ids[row, place], new_sims[row, place] = fresh[col], near[row, col]
                all_ids, all_sims = np.concatenate([ids, new_ids], axis=1), np.concatenate([sims, new_sims], axis=1)
                keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                ids, sims = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            open_ = np.where(expanded[ids], _NONE, sims)
            w = min(width, beam)
            pick = np.argpartition(-open_, w - 1, axis=1)[:, :w] if w < beam else np.broadcast_to(np.arange(w), (b, w))
            chosen = np.take_along_axis(ids, pick, 1)[np.take_along_axis(open_, pick, 1) > _NONE]
            expanded[chosen] = True
            reached = np.zeros(n + 1, dtype=bool)
            reached[self.graph[np.unique(chosen)]] = True
            fresh = np.flatnonzero(reached & ~met)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    # -- pruning ---------------------------------------------------------------------------
    def robust_prune(self, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float, batch: int = 512) -> np.ndarray:
        """Keep the nearest candidate, drop those it covers (``alpha`` times nearer to it than
        to the point), and repeat. Places left over go to the nearest dropped ones."""
        out = np.full((len(cand), degree), self.n, dtype=np.int32)
        for s in range(0, len(cand), batch):
            out[s : s + batch] = self._prune(cand[s : s + batch], sims[s : s + batch], degree, alpha)
        return out

    def _prune(self, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        by_id = np.argsort(cand, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(cand, by_id, 1)
        repeated = np.zeros(cand.shape, dtype=bool)
        repeated[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
        gone = np.zeros(cand.shape, dtype=bool)
        np.put_along_axis(gone, by_id, repeated, 1)
        sims = np.where(gone | (cand == self.n), _NONE, sims)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        vec = self.unit[cand]
        covered_from = 1.0 - (1.0 - sims) / np.float32(alpha)  # similarity at which a kept point covers
        between = np.matmul(vec, vec.transpose(0, 2, 1))
        rows = np.arange(len(cand))
        alive = sims > _NONE
        turn = np.where(alive, 2 * cand.shape[1], 3 * cand.shape[1])  # kept ones first, then dropped, then none
        for step in range(min(degree, cand.shape[1])):
            j = alive.argmax(axis=1)
            has = alive[rows, j]
            if not has.any():
                break
            turn[rows[has], j[has]] = step
            alive[rows, j] = False
            alive &= between[rows, j] < covered_from
        order = np.argsort(turn, axis=1, kind="stable")[:, :degree]
        out = np.full((len(cand), degree), self.n, dtype=np.int32)
        picked = np.where(np.take_along_axis(turn, order, 1) < 3 * cand.shape[1], np.take_along_axis(cand, order, 1), self.n)
        out[:, : picked.shape[1]] = picked
        return out

    def add_reverse(self, points: np.ndarray, degree: int, alpha: float) -> None:
        """Add the edges back to ``points`` from their neighbours. A list has places beyond
        ``degree``; one that would outgrow them is pruned to ``degree``."""
        room = self.graph.shape[1]
        dst = self.graph[points].ravel()
        src = np.repeat(points, room).astype(np.int32)
        ok = dst < self.n
        dst, src = dst[ok], src[ok]
        if not len(dst):
            return
        near = np.einsum("ij,ij->i", self.unit[dst], self.unit[src])
        order = np.lexsort((-near, dst))
        dst, src = dst[order], src[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        keep = place < degree  # the nearest; farther ones would be pruned
        extra = np.full((len(targets), degree), self.n, dtype=np.int32)
        extra[np.repeat(np.arange(len(targets)), count)[keep], place[keep]] = src[keep]
        have = self.graph[targets]
        both = np.concatenate([have, extra], axis=1)
        used = (both < self.n).sum(axis=1)
        fits = used <= room
        slim = both[fits]
        self.graph[targets[fits]] = np.take_along_axis(slim, np.argsort(slim == self.n, axis=1, kind="stable"), 1)[:, :room]
        full = np.flatnonzero(~fits)
        for s in range(0, len(full), 512):
            f = full[s : s + 512]
            sims = np.matmul(self.unit[both[f]], self.unit[targets[f]][:, :, None])[:, :, 0]
            self.graph[targets[f], :degree] = self.robust_prune(both[f], sims, degree, alpha)
            self.graph[targets[f], degree:] = self.n


def build_graph(unit: np.ndarray, *, degree: int = 20, beam: int = 32, alpha: float = 1.2, n_entries: int = 512, seed: int = 7) -> VectorGraph:
    """Insert the points in random order, in batches that at most double the graph.

    Greedy searches from the entry points propose each point's neighbours; the points of one
    batch, which cannot meet in the search, are proposed to each other directly.
    """
    n = len(unit)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n).astype(np.int32)
    g = VectorGraph(unit, np.full((n, degree + degree // 2), n, dtype=np.int32), order[: min(n, n_entries)])
    done = 0
    while done < n:
        size = min(n - done, max(512, min(done, 1024)))
        batch = order[done : done + size]
        q = unit[batch]
        inner = q @ q.T
        np.fill_diagonal(inner, _NONE)
        m = min(degree, size - 1)
        if m > 0:
            top = np.argpartition(-inner, m - 1, axis=1)[:, :m] if m < size else np.broadcast_to(np.arange(m), (size, m))
            cand, sims = batch[top], np.take_along_axis(inner, top, 1)
        else:
            cand, sims = np.full((size, 1), n, dtype=np.int32), np.full((size, 1), _NONE, dtype=np.float32)
        if done:
            old = VectorGraph.__new__(VectorGraph)
            old.n, old.unit, old.graph = n, g.unit, g.graph
            old.entries = order[: min(done, n_entries)]
            ids, near = old.search(q, beam)
            cand, sims = np.concatenate([cand, ids], axis=1), np.concatenate([sims, near], axis=1)
        g.graph[batch, :degree] = g.robust_prune(cand, sims, degree, alpha)
        g.add_reverse(batch, degree, alpha)
        done += size
    return g
