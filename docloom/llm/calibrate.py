"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the non-decreasing fit of labels to raw scores; equal scores share a value."""
    if not len(raw):
        return np.array([0.0]), np.array([0.5])
    xs, at = np.unique(raw, return_inverse=True)
    n = np.bincount(at).astype(float)
    mean = np.bincount(at, weights=labels) / n
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for x, m, w in zip(xs, mean, n):
        blocks.append([m * w, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    y = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return x, y


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Values between the knots are interpolated, those outside take the nearest knot's."""
    return np.clip(np.interp(raw, *knots), 0.0, 1.0)
