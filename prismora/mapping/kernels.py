"""Numpy kernels of the mapping: exact nearest rows, weights, reconstruction and confidence of a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EXACT = 1e-12
CELLS = 4_000_000  # distances in memory at a time
ESTIMATORS = ("mean", "distance_weighted_mean", "simplex_mixture")


def nearest(q: np.ndarray, valid: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int, banned: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, distances) of the k nearest rows by root mean square over valid bands, ordered by distance, then row.

    Both are (queries, k), -1 and inf where there are fewer. banned: a mask (queries of a slice, rows) of pairs to leave
    out. A matrix product finds all rows that can be among the nearest; those are measured exactly.
    """
    n = len(q)
    at, far = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not len(x) or not n:
        return at, far
    w = valid.astype(float)
    known = np.where(valid, q, 0.0)
    norm, bands, squares = (known * known).sum(axis=1), np.maximum(w.sum(axis=1), 1), (x * x).T
    slack = 1e-9 * (1 + norm + squares.sum(axis=0).max())
    kk = min(k, len(x))
    step = max(1, CELLS // len(x))
    for lo in range(0, n, step):
        part = slice(lo, min(n, lo + step))
        near = np.maximum(norm[part, None] - 2 * known[part] @ x.T + w[part] @ squares, 0)
        if banned is not None:
            near[banned(part)] = np.inf
        cut = np.partition(near, kk - 1, axis=1)[:, kk - 1]
        who, row = np.nonzero(near <= (cut + slack[part])[:, None])
        keep = np.isfinite(near[who, row])
        who, row = who[keep], row[keep]
        off = np.where(valid[part][who], q[part][who] - x[row], 0.0)
        d = np.sqrt((off * off).sum(axis=1) / bands[part][who])
        order = np.lexsort((rows[row], d, who))
        who, row, d = who[order], row[order], d[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < k
        at[lo + who[keep], rank[keep]], far[lo + who[keep], rank[keep]] = row[keep], d[keep]
    return at, far


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest points of the probability simplex, row by row; -inf elements stay 0."""
    u = -np.sort(-v, axis=1)
    finite = np.isfinite(u)
    over = np.cumsum(np.where(finite, u, 0.0), axis=1) - 1
    count = np.arange(1, v.shape[1] + 1)
    ok = finite & (u - over / count > 0)
    last = v.shape[1] - 1 - ok[:, ::-1].argmax(axis=1)
    shift = over[np.arange(len(v)), last] / (last + 1)
    return np.maximum(np.where(np.isfinite(v), v - shift[:, None], 0.0), 0.0)


def simplex_weights(near: np.ndarray, q: np.ndarray, used: np.ndarray, rounds: int = 250, stop: float = 1e-10) -> np.ndarray:
    """Weights on the simplex that minimise |w near - q|^2 for each query, by accelerated projected gradients.

    near: (queries, k, bands), q: (queries, bands), both 0 in bands that don't count; used: (queries, k). Queries that
    have settled are left alone.
    """
    n, k, _ = near.shape
    gram = np.einsum("nib,njb->nij", near, near)
    aim = np.einsum("nib,nb->ni", near, q)
    blocked = np.where(used, 0.0, -np.inf)
    step = 1 / np.maximum(np.linalg.eigvalsh(np.where(used[:, :, None] & used[:, None, :], gram, 0.0))[:, -1], 1e-12) if n else np.zeros(0)
    w = used / np.maximum(used.sum(axis=1, keepdims=True), 1)
    y, t, todo = w.copy(), 1.0, np.arange(n)
    for _ in range(rounds):
        if not len(todo):
            break
        grad = np.einsum("nij,nj->ni", gram[todo], y[todo]) - aim[todo]
        new = onto_simplex(y[todo] - step[todo, None] * grad + blocked[todo])
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - w[todo]
        y[todo] = new + (t - 1) / t2 * moved
        w[todo] = new
        t = t2
        todo = todo[np.abs(moved).sum(axis=1) > stop]
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def weights(estimator: str, near: np.ndarray, far: np.ndarray, q: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """(queries, k) weights of sum 1; unused places weigh 0. Rows at distance 0 share all weight, unless by plain mean."""
    used = np.isfinite(far)
    some = np.maximum(used.sum(axis=1, keepdims=True), 1)
    if estimator == "mean":
        return used / some
    hit = used & (far <= EXACT)
    exact = hit / np.maximum(hit.sum(axis=1, keepdims=True), 1)
    on_row = hit.any(axis=1)
    if estimator == "distance_weighted_mean":
        raw = np.where(used, 1 / np.maximum(np.where(used, far, 1.0), EXACT), 0.0)
        soft = raw / np.maximum(raw.sum(axis=1, keepdims=True), 1e-300)
    else:
        known = np.where(valid, q, 0.0)
        soft = simplex_weights(np.where(valid[:, None, :] & used[:, :, None], near, 0.0), known, used)
    return np.where(on_row[:, None], exact, soft)


def fit_rmse(w: np.ndarray, near: np.ndarray, q: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Error of the weighted neighbours against the query, over valid bands."""
    off = np.where(valid, np.einsum("nk,nkb->nb", w, near) - q, 0.0)
    return np.sqrt((off * off).sum(axis=1) / np.maximum(valid.sum(axis=1), 1))


def confidence(q: np.ndarray, valid: np.ndarray, far: np.ndarray, w: np.ndarray, rmse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, its parts coverage, distance, fit and weight concentration) of each query."""
    n = valid.sum(axis=1)
    scale = np.where(valid, np.abs(q), 0.0).sum(axis=1) / np.maximum(n, 1)
    scale = np.where(scale <= EXACT, 1.0, scale)
    used = np.isfinite(far)
    mean = np.where(used, far, 0.0).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    parts = np.stack([n / max(valid.shape[1], 1), np.exp(-mean / scale), np.exp(-rmse / scale), w.max(axis=1, initial=0.0)], axis=1)
    return np.clip(parts @ [0.25, 0.35, 0.25, 0.15], 0.0, 1.0), parts
