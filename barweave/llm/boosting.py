"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Trees are complete binary trees: node i has the children 2i + 1 and 2i + 2, so that a batch of rows walks all trees with
a few array look-ups per level. A node that was not split sends every row to its left."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` by tree and inner node (rows with a value above the threshold go right), ``leaf``
    by tree and leaf, ``prior`` the log odds without any tree."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of class 1, for each row of features."""
        trees, inner = self.feature.shape
        tree, row = np.arange(trees)[None, :], np.arange(len(rows))[:, None]
        node = np.zeros((len(rows), trees), dtype=np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            right = rows[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        odds = self.prior + self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 values that cut a feature into parts of about equal size; a value above all cuts is in the
    last bin."""
    different = np.unique(values)
    middles = (different[1:] + different[:-1]) / 2
    if len(middles) < bins:
        return middles
    ranks = np.linspace(0, len(values) - 1, bins + 1)[1:-1].astype(np.int64)
    return np.unique(np.sort(values)[ranks])


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least_weight: float = 1.0) -> Trees:
    """Trees on the log loss. Each level of a tree adds up gradients and curvatures by (node, feature, bin) and splits
    every node where that gains most; a tie goes to the first feature and the lowest cut, so that the same rows in the
    same order give the same trees. With one class or no rows there are no trees, only the prior."""
    n, width = rows.shape
    inner, leaves = 2**depth - 1, 2**depth
    prior = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    if n == 0 or labels.min() == labels.max():
        return Trees(prior, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [cut_points(rows[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
    #: Where a feature has fewer cuts, the bins beyond them stay empty.
    cut_table = np.full((width, bins), np.inf)
    for f, found in enumerate(cuts):
        cut_table[f, : len(found)] = found
    places = binned + np.arange(width)[None, :] * bins

    odds = np.full(n, prior)
    features, thresholds, values = (np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-odds))
        gradient, curvature = labels - p, p * (1.0 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes = 2**level
            at = (places + (node - (nodes - 1))[:, None] * width * bins).ravel()
            size = nodes * width * bins
            g = np.bincount(at, np.repeat(gradient, width), size).reshape(nodes, width, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(curvature, width), size).reshape(nodes, width, bins).cumsum(axis=2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least_weight) | (h_all - h < least_weight) | ~np.isfinite(cut_table)[None]] = 0.0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            found = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            here = slice(nodes - 1, 2 * nodes - 1)
            features[t, here] = np.where(found, best // bins, 0)
            thresholds[t, here] = np.where(found, cut_table[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (rows[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curvature, leaves) + ridge)
        odds += values[t, leaf]
    return Trees(prior, features, thresholds, values)
