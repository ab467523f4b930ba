"""Small gradient-boosted trees in numpy, for models whose training rows are bounded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A split (``feature`` < ``cut`` goes left) or, with feature -1, a leaf."""

    feature: int
    cut: float
    value: float
    left: Node | None = None
    right: Node | None = None


def cuts_of(x: np.ndarray, most: int = 24) -> list[np.ndarray]:
    """Candidate thresholds of each feature: middles between its distinct quantiles."""
    found = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, most + 1)))
        values = values if len(np.unique(column)) > most else np.unique(column)
        found.append((values[1:] + values[:-1]) / 2)
    return found


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: float, ridge: float = 1.0) -> Node:
    """A tree that fits one Newton step: leaves are sum(grad) / (sum(hess) + ridge)."""
    total_g, total_h = grad.sum(), hess.sum()
    leaf = Node(-1, 0.0, float(total_g / (total_h + ridge)))
    if depth == 0 or total_h < 2 * least:
        return leaf
    best = (1e-6, -1, 0.0)
    whole = total_g**2 / (total_h + ridge)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        place = np.searchsorted(edges, x[:, f], "right")
        g = np.cumsum(np.bincount(place, grad, len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(place, hess, len(edges) + 1))[:-1]
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - whole
        gain[(h < least) | (total_h - h < least)] = 0
        n = int(gain.argmax())
        if gain[n] > best[0]:
            best = (float(gain[n]), f, float(edges[n]))
    if best[1] < 0:
        return leaf
    _, f, cut = best
    go = x[:, f] < cut
    return Node(
        f, cut, leaf.value,
        grow(x[go], grad[go], hess[go], cuts, depth - 1, least, ridge),
        grow(x[~go], grad[~go], hess[~go], cuts, depth - 1, least, ridge),
    )


def apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] < node.cut, apply(node.left, x), apply(node.right, x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.2, least: float = 2.0, seed: int | None = None, share: float = 1.0) -> tuple[float, list[Node]]:
    """The prior log-odds and the trees (rate included in use: see ``margin``); with a seed, each tree sees a share of the rows."""
    rng = np.random.default_rng(seed)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, trees, cuts = np.full(len(y), prior), [], cuts_of(x)
    for _ in range(rounds):
        p = sigmoid(score)
        rows = rng.random(len(y)) < share if share < 1 else slice(None)
        tree = grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, depth, least)
        trees.append(tree)
        score += rate * apply(tree, x)
    return prior, trees


def margin(model: tuple[float, list[Node]], x: np.ndarray, rate: float = 0.2) -> np.ndarray:
    prior, trees = model
    return prior + rate * sum((apply(t, x) for t in trees), np.zeros(len(x)))
