"""Gradient-boosted trees for a bounded training table: fitted on the driver, applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Node:
    node = Node(value=float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return node
    best, all_g, all_h = 1e-6, g.sum(), h.sum()
    own = all_g**2 / (all_h + 1.0)
    n_low = np.arange(1, len(x))
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = gl**2 / (hl + 1.0) + (all_g - gl) ** 2 / (all_h - hl + 1.0) - own
        gain[(v[1:] == v[:-1]) | (n_low < least) | (n_low > len(x) - least)] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, node.feature, node.cut = gain[i], f, float((v[i] + v[i + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = _grow(x[low], g[low], h[low], depth - 1, least)
        node.high = _grow(x[~low], g[~low], h[~low], depth - 1, least)
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> list[Node]:
    """Trees whose sum, times the rate already, is the log odds of y = 1."""
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, least)
        stack = [tree]
        while stack:
            node = stack.pop()
            node.value *= rate
            stack += [n for n in (node.low, node.high) if n]
        score += _apply(tree, x)
        trees.append(tree)
    return trees


def predict(trees: list[Node], x: np.ndarray) -> np.ndarray:
    return sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def expression(trees: list[Node], features: list[str]) -> str:
    """SQL: the log odds over SQL for the features."""

    def of(node: Node) -> str:
        if node.feature < 0:
            return f"double('{node.value!r}')"
        return f"case when {features[node.feature]} <= double('{node.cut!r}') then {of(node.low)} else {of(node.high)} end"

    return " + ".join(map(of, trees)) or "double(0)"
