"""Isotonic calibration of scores to probabilities."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """Non-decreasing step function fitted by pooling adjacent violators; a constant if there is nothing to fit."""

    def __init__(self, scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, default: float = 0.0):
        scores, labels = np.asarray(scores, float), np.asarray(labels, float)
        weights = np.ones(len(scores)) if weights is None else np.asarray(weights, float)
        values, inverse = np.unique(scores, return_inverse=True)
        total, hits = np.bincount(inverse, weights, len(values)), np.bincount(inverse, weights * labels, len(values))
        blocks: list[list[float]] = []  # hits, weight, lowest score
        for v, w, h in zip(values, total, hits, strict=True):
            blocks.append([h, w, v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                h2, w2, _ = blocks.pop()
                blocks[-1][0] += h2
                blocks[-1][1] += w2
        self.x = np.array([b[2] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        self.default = default

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.full(len(scores), self.default)
        return self.y[np.maximum(0, np.searchsorted(self.x, scores, "right") - 1)]
