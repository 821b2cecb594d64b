"""Small dense numerics for the driver's searches; they work on Gram matrices, not on data."""

from __future__ import annotations

import math

import numpy as np


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def min_norm(g: np.ndarray, b: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
    """Minimum-norm solution of the normal equations, scaled to a unit diagonal when it is safe."""
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    s = g / np.outer(scale, scale)
    if np.linalg.matrix_rank(s, tol=rcond * max(1, len(s)), hermitian=True) < len(s):
        return np.linalg.pinv(g, rcond=rcond, hermitian=True) @ b
    return np.linalg.solve(s, b / scale) / scale


def nnls(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares from the Gram matrix, by active sets."""
    return bounded(g, b, np.zeros(len(b)), np.full(len(b), np.inf))


def bounded(g: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """min x'Gx/2 - b'x with low <= x <= high, by an active-set method with the KKT signs checked."""
    n = len(b)
    x = np.clip(np.zeros(n), low, high)
    at = np.where(x <= low, -1, np.where(x >= high, 1, 0))
    for _ in range(rounds):
        free = at == 0
        while free.any():
            target = x.copy()
            target[free] = min_norm(g[np.ix_(free, free)], b[free] - g[np.ix_(free, ~free)] @ x[~free])
            d = target - x
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(d > 0, (high - x) / d, np.where(d < 0, (low - x) / d, np.inf))
            room[~free] = np.inf
            k = int(np.argmin(room))
            if room[k] >= 1:
                x = target
                break
            x = x + max(room[k], 0) * d
            at[k] = 1 if d[k] > 0 else -1
            x[k] = high[k] if d[k] > 0 else low[k]
            free = at == 0
        slope = b - g @ x
        gain = np.where(at == -1, slope, np.where(at == 1, -slope, 0.0))
        gain[low == high] = 0
        k = int(np.argmax(gain))
        if gain[k] <= 1e-10 * max(1.0, np.abs(b).max()):
            return x
        at[k] = 0
    return x
