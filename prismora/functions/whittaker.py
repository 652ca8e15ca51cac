"""Whittaker smoothing of many series at once: five-diagonal systems, linear in their length, and Tukey weights.

The constant 4.685 is Tukey's; missing values weigh nothing. The smoother that the results are compared with is not
public, so its constant and treatment of missing values are assumptions here.
"""

from __future__ import annotations

import numpy as np

TUKEY = 4.685


def solve(w: np.ndarray, v: np.ndarray, strength: float) -> np.ndarray:
    """z with (diag(w) + strength D'D) z = w v for every row, D the second differences; by an LDL' decomposition."""
    rows, n = v.shape
    a = np.full(n, 6.0)
    b, c = np.full(n, -4.0), np.ones(n)
    a[[0, -1]], a[[1, -2]], b[[0, n - 2]] = 1.0, 5.0, -2.0
    if n == 3:
        a[:], b[:2], c[0] = (1.0, 4.0, 1.0), -2.0, 1.0
    a, b, c = strength * a, strength * b, strength * c
    b[n - 1] = 0.0
    c[n - 2 :] = 0.0
    d, e, f, z = (np.zeros((n, rows)) for _ in range(4))
    weight, right = np.ascontiguousarray(w.T), np.ascontiguousarray((w * v).T)
    for i in range(n):
        di, ei, zi = a[i] + weight[i], b[i], right[i]
        if i >= 1:
            di = di - d[i - 1] * e[i - 1] ** 2
            ei = ei - d[i - 1] * e[i - 1] * f[i - 1]
            zi = zi - e[i - 1] * z[i - 1]
        if i >= 2:
            di = di - d[i - 2] * f[i - 2] ** 2
            zi = zi - f[i - 2] * z[i - 2]
        d[i], z[i] = di, zi
        e[i], f[i] = ei / di, c[i] / di
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1]
        if i + 2 < n:
            z[i] -= f[i] * z[i + 2]
    return z.T


def smooth(y: np.ndarray, strength: float = 100.0, rounds: int = 8, cut: float = TUKEY) -> tuple[np.ndarray, np.ndarray]:
    """(smooth, weights) of each row: weights by residual over 1.4826 MAD, refitted `rounds` times or until settled.

    A row with under three values stays as it is, with weight 1 on them.
    """
    known = np.isfinite(y)
    z, w = np.array(y, float), known.astype(float)
    todo = np.flatnonzero(known.sum(axis=1) >= 3) if y.shape[1] >= 3 else np.zeros(0, int)
    v = np.where(known, y, 0.0)
    for _ in range(rounds):
        if not len(todo):
            break
        z[todo] = solve(w[todo], v[todo], strength)
        r = np.where(known[todo], v[todo] - z[todo], np.nan)
        scale = 1.4826 * np.nanmedian(np.abs(r - np.nanmedian(r, axis=1, keepdims=True)), axis=1)
        ok = scale > 1e-12
        u = np.clip(np.abs(r) / (cut * np.where(ok, scale, 1.0))[:, None], 0, 1)
        new = np.where(known[todo], (1 - u * u) ** 2, 0.0)
        new = np.nan_to_num(new)
        ok &= np.count_nonzero(new, axis=1) >= 3
        w[todo[ok]] = new[ok]
        todo = todo[ok]
    return z, w
