"""Histogram gradient boosting for binary labels and isotonic calibration, in numpy, for bounded samples."""

from __future__ import annotations

import numpy as np


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 32,
    least: int = 20,
    l2: float = 1.0,
) -> dict:
    """Boosted trees on the logistic loss. Each tree is an array of (feature, threshold, left, right, value)."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    score, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, tree=tree, g=g, h=h) -> int:
            at = len(tree)
            G, H = g[rows].sum(), h[rows].sum()
            tree.append([-1, 0.0, -1, -1, -rate * G / (H + l2)])
            if level == depth or len(rows) < 2 * least:
                return at
            best = (1e-6, -1, -1)
            for j in range(d):
                if not len(edges[j]):
                    continue
                k, b = len(edges[j]) + 1, binned[rows, j]
                gl, hl, cl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                gain = np.where(
                    (cl >= least) & (len(rows) - cl >= least),
                    gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2),
                    0,
                )
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                j, cut = best[1:]
                left = binned[rows, j] <= cut
                tree[at][:2] = j, float(edges[j][cut])
                tree[at][2] = grow(rows[left], level + 1)
                tree[at][3] = grow(rows[~left], level + 1)
            return at

        grow(np.arange(n), 0)
        trees.append(np.array(tree))
        score = score + apply(trees[-1], x)
    return {"base": base, "trees": trees}


def apply(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while True:
        feature = tree[node, 0].astype(np.int64)
        inner = feature >= 0
        if not inner.any():
            return tree[node, 4]
        left = x[np.arange(len(x)), np.maximum(feature, 0)] <= tree[node, 1]
        node = np.where(inner, np.where(left, tree[node, 2], tree[node, 3]).astype(np.int64), node)


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    return model["base"] + sum((apply(t, x) for t in model["trees"]), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from score to rate."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, s, s])
        while len(blocks) > 1 and (
            blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]
        ):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([x for b in blocks for x in b[2:]])
    rate = np.repeat([b[0] / b[1] for b in blocks], 2)
    return at, rate
