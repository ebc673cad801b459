"""Histogram gradient-boosted trees for a binary label, in numpy.

Rows are binned once on quantile edges. Trees grow level by level from gradient
histograms and are kept as flat arrays of nodes, so that scoring walks all rows of
a batch one level at a time without a loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in one array of nodes; children are node numbers, leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -50, 50)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of quantile bins per feature; a value goes to the first edge not below it."""
    levels = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], levels, method="lower")) for j in range(x.shape[1])]


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, l2: float = 1.0, min_hessian: float = 1.0,
) -> Trees:
    """Newton boosting of the log loss on rows ``x`` and labels ``y`` of 0 and 1.

    Without rows, or with a single class, the model has no split and scores the
    smoothed share of ones.
    """
    n, features = x.shape
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    edges = bin_edges(x, bins) if n else [np.empty(0)] * features
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if n else np.empty((0, features), int)
    cells = bins + 1
    margin = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float = 0.0) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = leaf(_newton(grad.sum(), hess.sum(), l2, rate))
        roots.append(root)
        at = np.full(n, root)
        level = [root]
        for _ in range(depth):
            slot = np.full(len(nodes), -1)
            slot[level] = np.arange(len(level))
            here = slot[at]
            live = here >= 0
            cell = (here[live, None] * features + np.arange(features)) * cells + binned[live]
            shape = len(level), features, cells
            total = len(level) * features * cells
            g = np.bincount(cell.ravel(), np.repeat(grad[live], features), total).reshape(shape)
            h = np.bincount(cell.ravel(), np.repeat(hess[live], features), total).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < min_hessian) | (ht - hl < min_hessian)] = 0
            grown = []
            for k, node in enumerate(level):
                j, c = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, j, c] <= 1e-9 or c >= len(edges[j]):
                    continue
                children = [
                    leaf(_newton(gs, hs, l2, rate))
                    for gs, hs in ((gl[k, j, c], hl[k, j, c]), (gt[k, j, 0] - gl[k, j, c], ht[k, j, 0] - hl[k, j, c]))
                ]
                nodes[node] = [j, float(edges[j][c]), *children, 0.0]
                mine = at == node
                at[mine] = np.where(binned[mine, j] <= c, *children)
                grown += children
            if not grown:
                break
            level = grown
        margin += np.array([v[4] for v in nodes])[at]
    if not roots:
        roots.append(leaf())
    table = np.array(nodes, dtype=float)
    return Trees(
        table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32),
        table[:, 3].astype(np.int32), table[:, 4], np.array(roots, np.int32), depth, base,
    )


def _newton(g: float, h: float, l2: float, rate: float) -> float:
    return float(-rate * g / (h + l2))
