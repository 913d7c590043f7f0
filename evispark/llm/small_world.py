"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at once in numpy."""

from __future__ import annotations

import math

import numpy as np

from evispark.llm.words import mix

#: Neighbours of a node in the upper layers and in the lowest one; candidates looked at when a node is linked.
UPPER, LOWEST, LINKING = 8, 16, 32
#: Nodes linked together, queries searched together, and numbers gathered at a time.
LINK_BATCH, QUERY_BATCH, GATHER = 512, 512, 4 << 20
#: Nodes a layer's search hands down as entry points.
ENTRIES = 4
_LAYER = np.uint64(0x632BE59BD9B4E019)


def _best(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` most similar of each row, most similar first; -1 fills rows that have fewer."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam_search(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of the ``width`` best nodes found for each query, best first.

    All queries take a step together: each expands the best node of its beam that it has not expanded. A query is done
    when its beam has no such node.
    """
    rows, width = len(queries), max(width, entries.shape[1])
    seen = np.zeros((rows, len(vectors) + 1), bool)  # the last column is that of -1
    seen[:, -1] = True
    ids = np.full((rows, width), -1, np.int32)
    ids[:, : entries.shape[1]] = entries
    sims = np.full((rows, width), -np.inf, np.float32)
    for j in range(entries.shape[1]):
        fresh = ~seen[np.arange(rows), entries[:, j]]
        sims[fresh, j] = np.einsum("ij,ij->i", vectors[entries[fresh, j]], queries[fresh])
        seen[np.arange(rows), entries[:, j]] = True
    to_do = sims > -np.inf
    while True:
        ahead = np.where(to_do, sims, -np.inf)
        pick = ahead.argmax(axis=1)
        live = np.flatnonzero(ahead[np.arange(rows), pick] > -np.inf)
        if not len(live):
            return _best(ids, sims, width)
        to_do[live, pick[live]] = False
        near = table[ids[live, pick[live]]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        row, column = np.nonzero(fresh)
        found = np.full(near.shape, -np.inf, np.float32)
        found[row, column] = np.einsum("ij,ij->i", vectors[near[row, column]], queries[live[row]])
        some = np.flatnonzero((found > sims[live].min(axis=1)[:, None]).any(axis=1))
        if not len(some):
            continue
        live, near, found = live[some], near[some], found[some]
        all_sims = np.concatenate([sims[live], found], axis=1)
        order = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, 1)
        to_do[live] = np.take_along_axis(np.concatenate([to_do[live], found > -np.inf], axis=1), order, 1)
        sims[live] = np.take_along_axis(all_sims, order, 1)


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` neighbours of each row: those no better neighbour is more similar to come first, then the rest."""
    out_ids, out_sims = np.full((len(ids), most), -1, np.int32), np.full((len(ids), most), -np.inf, np.float32)
    ids, sims = _best(ids, sims, ids.shape[1])
    step = max(1, GATHER // (ids.shape[1] * max(vectors.shape[1], ids.shape[1])))
    for a in range(0, len(ids), step):
        part, near = ids[a : a + step], sims[a : a + step]
        gathered = vectors[part]
        between = gathered @ gathered.transpose(0, 2, 1)
        chosen = np.zeros(part.shape, bool)
        for j in range(part.shape[1]):
            rival = np.where(chosen, between[:, j], -np.inf).max(axis=1)
            chosen[:, j] = (near[:, j] > -np.inf) & (rival < near[:, j]) & (chosen.sum(axis=1) < most)
        first = np.where(near > -np.inf, near + 4 * chosen, -np.inf)
        order = np.argsort(-first, axis=1, kind="stable")[:, :most]
        width = order.shape[1]
        out_sims[a : a + step, :width] = np.take_along_axis(near, order, 1)
        out_ids[a : a + step, :width] = np.where(out_sims[a : a + step, :width] > -np.inf, np.take_along_axis(part, order, 1), -1)
    return out_ids, out_sims


class SmallWorld:
    """Layers of neighbour tables. Nodes are ordered by falling top layer, so every layer is a prefix of the nodes."""

    def __init__(self, vectors: np.ndarray, tables: list[np.ndarray]):
        self.vectors, self.tables = vectors, tables  # the lowest layer is the last

    @staticmethod
    def order(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The order in which nodes of these 64-bit keys are to be given, and the sizes of the layers, lowest last."""
        chance = (mix(keys.astype(np.uint64) ^ _LAYER) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        top = np.floor(-np.log(np.maximum(chance, 1e-18)) / math.log(UPPER)).astype(int)
        order = np.lexsort((keys, chance, -top))
        return order, [int((top >= i).sum()) for i in range(int(top.max(initial=0)), -1, -1)]

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int]) -> SmallWorld:
        world = cls(vectors, [])
        for i, size in enumerate(sizes):
            world.tables.append(world._layer(size, LOWEST if i == len(sizes) - 1 else UPPER))
        return world

    def _layer(self, size: int, most: int) -> np.ndarray:
        vectors = self.vectors[:size]
        table, sims = np.full((size, most), -1, np.int32), np.full((size, most), -np.inf, np.float32)
        done = 0
        while done < size:
            stop = min(size, done + min(max(done, 64), LINK_BATCH))
            batch = np.arange(done, stop)
            among = vectors[done:stop] @ vectors[done:stop].T
            np.fill_diagonal(among, -np.inf)
            near = np.argsort(-among, axis=1)[:, :most].astype(np.int32)
            ids, found = near + done, np.take_along_axis(among, near, 1)
            if done:
                entries = self._entries(vectors[done:stop])
                entries = np.where(entries < done, entries, -1)
                entries[(entries < 0).all(axis=1), 0] = 0
                old, old_sims = beam_search(vectors[:done], table[:done], vectors[done:stop], entries, LINKING)
                ids, found = np.concatenate([ids, old], axis=1), np.concatenate([found, old_sims], axis=1)
            table[batch], sims[batch] = _diverse(vectors, ids, found, most)
            self._link_back(vectors, table, sims, batch)
            done = stop
        return table

    @staticmethod
    def _link_back(vectors, table, sims, batch) -> None:
        """Let the neighbours of new nodes know them; a full list keeps a diverse choice."""
        most = table.shape[1]
        to, sim = table[batch].ravel(), sims[batch].ravel()
        new = np.repeat(batch, most)
        ok = to >= 0
        to, sim, new = to[ok], sim[ok], new[ok]
        order = np.lexsort((-sim, to))
        to, sim, new = to[order], sim[order], new[order]
        heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        rank = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
        nodes, row = to[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(to))))
        keep = (rank < most) & ~(table[to] == new[:, None]).any(axis=1)
        ids, found = np.full((len(nodes), 2 * most), -1, np.int32), np.full((len(nodes), 2 * most), -np.inf, np.float32)
        ids[:, :most], found[:, :most] = table[nodes], sims[nodes]
        ids[row[keep], most + rank[keep]], found[row[keep], most + rank[keep]] = new[keep], sim[keep]
        table[nodes], sims[nodes] = _diverse(vectors, ids, found, most)

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """Nodes near each query, from the layers built so far."""
        entries = np.zeros((len(queries), 1), np.int32)
        for table in self.tables:
            entries = beam_search(self.vectors[: len(table)], table, queries, entries, ENTRIES)[0]
        return entries

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of each query's beam in the lowest layer."""
        ids, sims = [], []
        for a in range(0, len(queries), QUERY_BATCH):
            part = queries[a : a + QUERY_BATCH]
            entries = np.zeros((len(part), 1), np.int32)
            for i, table in enumerate(self.tables):
                last = i == len(self.tables) - 1
                entries, near = beam_search(self.vectors[: len(table)], table, part, entries, width if last else ENTRIES)
            ids.append(entries)
            sims.append(near)
        return np.concatenate(ids), np.concatenate(sims)
