"""Hierarchical navigable small-world graph; batches of queries advance together."""

from __future__ import annotations

import io
import math

import numpy as np

LINKS = 16  # neighbours a new node chooses; the lowest level keeps twice as many
BUILD_BEAM = 64
BATCH = 256
UPPER_BEAM = 4
PICKS = 4  # of a beam's nodes are followed at once; with the links of a node below 255, for the marks
CELLS = 16 << 20  # visited marks of one batch of queries, or bytes of its beams
BEAM_BYTES = 40  # for each node of a query's beam


class Hnsw:
    """Unit vectors in layers of neighbour lists.  ``absorb`` is the cosine from which a new vector joins its
    nearest node's ball in place of becoming a node."""

    def __init__(self, vectors: np.ndarray, absorb: float = 2.0) -> None:
        self.all = vectors.astype(np.float32, copy=False)
        n = len(vectors)
        self.leader = np.full(n, -1, dtype=np.int64)  # node (place in ``all``) of each vector
        self.node = np.zeros(0, dtype=np.int64)  # place in ``all`` of each node
        u = (np.random.PCG64(5).random_raw(n) >> np.uint64(11)).astype(np.float64) + 0.5
        level = np.floor(-np.log(u / 2.0 ** 53) / math.log(LINKS)).astype(np.int64)
        self.v = np.zeros((n, vectors.shape[1]), dtype=np.float32)
        self.size, tops = 0, int(level.max()) + 1 if n else 1
        self.level = np.zeros(n, dtype=np.int64)
        # the lowest level has a row for each node; the others have one for each of theirs, at its place
        self.next = [np.full((int((level >= k).sum()), LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(tops)]
        self.place = [np.full(n if k else 0, -1, dtype=np.int32) for k in range(tops)]
        self.count = [0] * tops
        self.near = [np.full(a.shape, -2.0, dtype=np.float32) for a in self.next]
        self.into = np.zeros(n, dtype=np.int64)  # links of the lowest level that lead to a node
        nodes: list[int] = []
        for i in range(0, n, BATCH):
            self._insert(np.arange(i, min(n, i + BATCH)), level, absorb, nodes)
        self.node = np.array(nodes, dtype=np.int64)
        self._trim()

    def _trim(self) -> None:
        del self.all, self.near
        self.v = self.v[:self.size]
        self.next = [a[:max(1, c)] for a, c in zip(self.next, self.count)]

    def _insert(self, batch: np.ndarray, level: np.ndarray, absorb: float, nodes: list[int]) -> None:
        x = self.all[batch]
        found, sims = self.search(x, BUILD_BEAM) if self.size else (np.full((len(batch), 1), -1), np.full((len(batch), 1), -2.0))
        own = x @ x.T
        fresh: list[int] = []  # places in the batch
        for i in range(len(batch)):
            if sims[i, 0] >= absorb:
                self.leader[batch[i]] = nodes[found[i, 0]]
                continue
            if fresh:
                k = int(own[i, fresh].argmax())
                if own[i, fresh[k]] >= absorb:
                    self.leader[batch[i]] = batch[fresh[k]]
                    continue
            fresh.append(i)
        first = self.size
        for i in fresh:
            self.leader[batch[i]] = batch[i]
            self.v[self.size], self.level[self.size] = x[i], level[batch[i]]
            nodes.append(int(batch[i]))
            for k in range(level[batch[i]] + 1):
                if k:
                    self.place[k][self.size] = self.count[k]
                self.count[k] += 1
            self.size += 1
        new = np.arange(first, self.size)
        if not len(new):
            return
        for k in range(len(self.next)):
            mine = new[self.level[new] >= k]
            if not len(mine):
                break
            if k == 0:
                ids = np.concatenate([found[fresh], np.broadcast_to(new, (len(new), len(new)))], axis=1)
                score = np.concatenate([sims[fresh], own[np.ix_(fresh, fresh)]], axis=1)
            else:  # the upper levels are small: all of their nodes
                others = np.flatnonzero(self.level[:self.size] >= k)
                ids, score = np.broadcast_to(others, (len(mine), len(others))), self.v[mine] @ self.v[others].T
            score = np.where((ids == mine[:, None]) | (ids < 0), -2.0, score)
            top = np.argsort(-score, axis=1)[:, :LINKS]
            for row, node in enumerate(mine):
                for c in top[row]:
                    s = score[row, c]
                    if s > -2.0:
                        self._link(k, int(node), int(ids[row, c]), float(s))
                        self._link(k, int(ids[row, c]), int(node), float(s))

    def _link(self, k: int, a: int, b: int, s: float) -> None:
        i = self.place[k][a] if k else a
        row, near = self.next[k][i], self.near[k][i]
        if (row == b).any():
            return
        at = int(near.argmin())
        if near[at] > -2.0:
            if s <= near[at]:
                # a node that nothing leads to could not be found
                if k or self.into[b]:
                    return
            if k == 0 and self.into[row[at]] <= 1:
                able = self.into[row] > 1
                if not able.any():
                    return
                at = int(np.where(able, near, 3.0).argmin())
            if k == 0:
                self.into[row[at]] -= 1
        row[at], near[at] = b, s
        if k == 0:
            self.into[b] += 1

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and cosines of the ``beam`` best found for each query, best first (-1 and -2: none)."""
        ids, sims = [], []
        step = max(8, min(512, CELLS // max(self.size, BEAM_BYTES * beam, 1)))
        for i in range(0, len(queries), step):
            q = queries[i:i + step].astype(np.float32)
            at = np.zeros((len(q), 1), dtype=np.int64)
            top = np.flatnonzero(self.level[:self.size] >= len(self.next) - 1)
            if len(top):
                at[:] = top[0]
            else:
                at[:] = int(self.level[:self.size].argmax())
            for k in range(len(self.next) - 1, 0, -1):
                at, _ = self._layer(q, at, UPPER_BEAM, k)
            a, s = self._layer(q, at, beam, 0)
            ids.append(a)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def _layer(self, q: np.ndarray, entry: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, self.size + 1), dtype=np.uint8)  # 0: not yet; the last mark is for -1
        seen[:, -1] = 1
        ids = np.full((n, beam), -1, dtype=np.int64)
        sims = np.full((n, beam), -2.0, dtype=np.float32)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("nd,nkd->nk", q, self.v[ids[:, :width]]), -2.0)
        seen[rows[:, None], ids[:, :width]] = 1
        done, picks = ids < 0, min(PICKS, beam)
        while True:
            best = np.where(done[rows], -3.0, sims[rows])
            alive = best.max(axis=1) > -3.0
            rows, best = rows[alive], best[alive]
            if not len(rows):
                break
            line = np.arange(len(rows))[:, None]
            pick = np.argpartition(-best, picks - 1, axis=1)[:, :picks] if picks < beam else np.broadcast_to(np.arange(beam), best.shape)
            done[rows[:, None], pick] = True
            here = ids[rows[:, None], pick]
            if k:
                here = self.place[k][here]
            near = self.next[k][here]
            near[(best[line, pick] <= -3.0) | (here < 0)] = -1
            near = near.reshape(len(rows), -1)
            at, col = np.nonzero(seen[rows[:, None], near] == 0)
            to, own = near[at, col], rows[at]
            seen[own, to] = mark = (col + 1).astype(np.uint8)
            once = seen[own, to] == mark  # a node that several picks lead to counts once
            at, to, own = at[once], to[once], own[once]
            s = np.einsum("fd,fd->f", q.take(own, axis=0), self.v.take(to, axis=0))
            better = s > sims[rows].min(axis=1)[at]
            at, to, s = at[better], to[better], s[better]
            if not len(at):
                continue
            count = np.bincount(at, minlength=len(rows))
            place = np.arange(len(at)) - (np.cumsum(count) - count)[at]
            new, score = np.full((len(rows), count.max()), -1, dtype=np.int64), np.full((len(rows), count.max()), -2.0, dtype=np.float32)
            new[at, place], score[at, place] = to, s
            new, score = np.concatenate([ids[rows], new], axis=1), np.concatenate([sims[rows], score], axis=1)
            flag = np.concatenate([done[rows], np.broadcast_to(False, (len(rows), count.max()))], axis=1)
            keep = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            ids[rows], sims[rows], done[rows] = new[line, keep], score[line, keep], flag[line, keep]
            done[rows] |= sims[rows] <= -2.0
        order = np.argsort(-sims, axis=1)
        ids, sims = ids[np.arange(n)[:, None], order], sims[np.arange(n)[:, None], order]
        return np.where(sims > -2.0, ids, -1), sims

    def save(self, vectors: bool = True, **more: np.ndarray) -> bytes:
        """Without its vectors a graph has some 140 bytes for each node, whatever their length."""
        out = io.BytesIO()
        if vectors:
            more["v"] = self.v
        np.savez(out, level=self.level[:self.size].astype(np.uint8), node=self.node, **{f"next{k}": a for k, a in enumerate(self.next)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, v: np.ndarray | None = None) -> tuple[Hnsw, dict[str, np.ndarray]]:
        """``v``: unit vectors of the nodes, where they were not saved."""
        parts = dict(np.load(io.BytesIO(data)))
        out = cls.__new__(cls)
        out.v = parts.pop("v") if v is None else v
        out.level, out.node = parts.pop("level"), parts.pop("node")
        out.size = len(out.v)
        out.next = [parts.pop(f"next{k}") for k in range(sum(n.startswith("next") for n in parts))]
        out.place = [np.full(out.size if k else 0, -1, dtype=np.int32) for k in range(len(out.next))]
        for k in range(1, len(out.next)):
            own = np.flatnonzero(out.level >= k)
            out.place[k][own] = np.arange(len(own))
        return out, parts
