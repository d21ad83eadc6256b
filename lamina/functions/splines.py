"""Penalised cubic splines with few knots, by their values and second derivatives at the knots."""

from __future__ import annotations

import numpy as np


def cubic_penalty(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the natural cubic spline through values at knots: the matrix that gives its second derivatives, and that of its roughness."""
    h, n = np.diff(knots), len(knots)
    d, b = np.zeros((n - 2, n)), np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < n - 2:
            b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(n), inner, np.zeros(n)]), d.T @ inner


def smooth_map(x: np.ndarray, y: np.ndarray, k: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knots, values and second derivatives of a penalised natural cubic spline of y on x with k knots at quantiles of x; the penalty by generalised cross-validation."""
    knots = np.unique(np.quantile(np.unique(x), np.linspace(0, 1, k)))
    if len(knots) < 3:
        line = np.polyfit(x, y, 1) if len(knots) == 2 else np.array([0.0, y.mean()])
        ends = knots if len(knots) == 2 else np.array([knots[0], knots[0] + 1])
        return ends, np.polyval(line, ends), np.zeros(2)
    second, rough = cubic_penalty(knots)
    h = np.diff(knots)
    i = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(h) - 1)
    t, u, rows = knots[i + 1] - x, x - knots[i], np.arange(len(x))
    design = ((t**3 / h[i] - h[i] * t) / 6)[:, None] * second[i] + ((u**3 / h[i] - h[i] * u) / 6)[:, None] * second[i + 1]
    design[rows, i] += t / h[i]
    design[rows, i + 1] += u / h[i]
    gram, moment, best = design.T @ design, design.T @ y, None
    scale = np.trace(gram) / max(np.trace(rough), 1e-300)
    for power in np.linspace(-12, 6, 73):
        full = gram + scale * 10.0**power * rough
        try:
            beta, edf = np.linalg.solve(full, moment), np.trace(np.linalg.solve(full, gram))
        except np.linalg.LinAlgError:
            continue
        gcv = len(x) * ((y - design @ beta) ** 2).sum() / max(len(x) - edf, 1e-9) ** 2
        if best is None or gcv < best[0] - 1e-12 * abs(best[0]):
            best = (gcv, beta)
    return knots, best[1], second @ best[1]
