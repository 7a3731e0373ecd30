"""Hierarchical navigable small-world graph of one shard of vectors, in flat neighbour arrays.

A layer is one integer matrix, a row of neighbours per node, -1 where there are fewer. Points enter
from the highest level down, in batches that are searched in lockstep with numpy; points of one batch
also see each other. Neighbours are chosen to spread: a candidate nearer to a chosen neighbour than to
the point itself comes last.
"""

from __future__ import annotations

import io

import numpy as np

LINKS = 16
WIDTH_BUILD = 64
BATCH = 256


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


def _starts(nodes: np.ndarray) -> np.ndarray:
    """Different nodes to start the next layer from: four each, or one where some query has fewer."""
    return nodes[:, :4] if nodes.shape[1] >= 4 and (nodes[:, :4] >= 0).all() else nodes[:, :1]


class GraphIndex:
    def __init__(self, points: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.points, self.layers, self.entry = points, layers, entry
        self.norms = _square(points)

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 7) -> GraphIndex:
        """``points``: float32 rows, compared by Euclidean distance."""
        n = len(points)
        random = np.random.RandomState(seed)
        levels = np.floor(-np.log(random.uniform(1e-12, 1, n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-levels, kind="stable")
        layers = [np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(levels[order[0]] + 1)]
        index = cls(points, layers, int(order[0]))
        at = 1
        while at < n:
            batch = order[at : at + min(BATCH, at)]
            index._insert(batch, levels[batch], order[:at], levels)
            at += len(batch)
        return index

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's norm; infinite where a node is -1."""
        found = self.norms[nodes] - 2 * np.einsum("qd,qkd->qk", queries, self.points[nodes])
        found[nodes < 0] = np.inf
        return found

    def _walk(self, layer: int, queries: np.ndarray, entries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, nearest first, and their distances."""
        links, n = self.layers[layer], len(queries)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.points) + 1), bool)
        seen[:, -1] = True  # where -1 points to
        seen[rows, entries] = True
        nodes = np.full((n, width), -1, np.int64)
        near = np.full((n, width), np.inf, np.float32)
        k = entries.shape[1]
        nodes[:, :k], near[:, :k] = entries, self._distances(queries, entries)
        order = np.argsort(near, 1, kind="stable")
        nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
        done = nodes < 0
        active = np.arange(n)
        while len(active):
            a_nodes, a_done = nodes[active], done[active]
            pick = np.argsort(a_done, 1, kind="stable")[:, :step]
            fresh = ~np.take_along_axis(a_done, pick, 1)
            chosen = np.where(fresh, np.take_along_axis(a_nodes, pick, 1), -1)
            np.put_along_axis(a_done, pick, True, 1)
            spread = links[chosen]
            spread[chosen < 0] = -1
            spread = spread.reshape(len(active), -1).astype(np.int64)
            spread[seen[active[:, None], spread]] = -1
            # The same node from two links counts once.
            spread.sort(1)
            spread[:, 1:][spread[:, 1:] == spread[:, :-1]] = -1
            seen[active[:, None], spread] = True
            both = np.concatenate((a_nodes, spread), 1)
            reach = np.concatenate((near[active], self._distances(queries[active], spread)), 1)
            state = np.concatenate((a_done, spread < 0), 1)
            best = np.argsort(reach, 1, kind="stable")[:, :width]
            nodes[active], near[active] = np.take_along_axis(both, best, 1), np.take_along_axis(reach, best, 1)
            done[active] = np.take_along_axis(state, best, 1)
            active = active[~done[active].all(1)]
        return nodes, near

    def _spread_out(self, nodes: np.ndarray, near: np.ndarray, norms: np.ndarray, keep: int) -> np.ndarray:
        """``keep`` of the candidate ``nodes`` (sorted by ``near``) per row: spread ones first."""
        if nodes.shape[1] <= keep:
            return nodes
        points = self.points[nodes]
        own = self.norms[nodes]
        between = own[:, :, None] + own[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        near = near + norms[:, None]
        covered = np.zeros(nodes.shape, bool)
        for i in range(1, nodes.shape[1]):
            covered[:, i] = ((between[:, i, :i] < near[:, i, None]) & ~covered[:, :i] & (nodes[:, :i] >= 0)).any(1)
        rank = np.argsort(np.where(nodes < 0, 2, covered), 1, kind="stable")[:, :keep]
        return np.take_along_axis(nodes, rank, 1)

    def _insert(self, batch: np.ndarray, levels: np.ndarray, present: np.ndarray, all_levels: np.ndarray) -> None:
        queries = self.points[batch]
        entries = np.full((len(batch), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            joins = levels >= layer
            width = WIDTH_BUILD if joins.any() else 4
            nodes, near = self._walk(layer, queries, entries, width)
            entries = _starts(nodes)
            if not joins.any():
                continue
            new, found, reach = batch[joins], nodes[joins], near[joins]
            mates = np.broadcast_to(new, (len(new), len(new))).copy()
            apart = self._distances(self.points[new], mates)
            apart[np.eye(len(new), dtype=bool)] = np.inf
            mates[np.eye(len(new), dtype=bool)] = -1
            found, reach = np.concatenate((found, mates), 1), np.concatenate((reach, apart), 1)
            order = np.argsort(reach, 1, kind="stable")[:, :WIDTH_BUILD]
            found, reach = np.take_along_axis(found, order, 1), np.take_along_axis(reach, order, 1)
            chosen = self._spread_out(found, reach, self.norms[new], LINKS)
            self.layers[layer][new, : chosen.shape[1]] = chosen
            self._link_back(layer, new, chosen)

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        links = self.layers[layer]
        to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 512):
            part, c, f = nodes[at : at + 512], counts[at : at + 512], first[at : at + 512]
            extra = np.full((len(part), c.max()), -1, np.int64)
            row = np.repeat(np.arange(len(part)), c)
            extra[row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = source[np.repeat(f - (np.cumsum(c) - c), c) + np.arange(len(row))]
            # A link that is already there comes once.
            extra[(extra[:, :, None] == links[part][:, None, :]).any(2)] = -1
            both = np.concatenate((links[part].astype(np.int64), extra), 1)
            reach = self._distances(self.points[part], both)
            rank = np.argsort(reach, 1, kind="stable")[:, : 2 * links.shape[1]]
            both, reach = np.take_along_axis(both, rank, 1), np.take_along_axis(reach, rank, 1)
            links[part] = self._spread_out(both, reach, self.norms[part], links.shape[1])

    def search(self, queries: np.ndarray, count: int, width: int) -> np.ndarray:
        """Up to ``count`` nearest nodes of each query, -1 where there are fewer."""
        found = []
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            entries = np.full((len(part), 1), self.entry, np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                entries = _starts(self._walk(layer, part, entries, 4)[0])
            found.append(self._walk(0, part, entries, max(width, count))[0][:, :count])
        return np.concatenate(found) if found else np.zeros((0, count), np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, entry=self.entry, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> GraphIndex:
        held = np.load(io.BytesIO(data))
        count = sum(name.startswith("layer") for name in held.files)
        return cls(held["points"], [held[f"layer{i}"] for i in range(count)], int(held["entry"]))
