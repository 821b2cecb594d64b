"""Model structure searches over a Gram matrix.

The data is read once for the Gram matrix; every search below needs only its entries.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

import numpy as np

from .estimate import least_squares
from .floating import Dense, Floating
from .gram import Gram

if TYPE_CHECKING:
    from .wide import Columns

__all__ = ["ratios", "forward", "CRITERIA", "by_order", "best_order", "accelerated", "Floating"]

EPS = float(np.finfo(float).eps)
#: Columns fetched together as the likely next ones.
AHEAD = 16


def ratios(d: np.ndarray, b: np.ndarray, yy: float, floor: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Error reduction ratio of every term from the diagonal of the Gram matrix and its products with y; 0 where nothing is left of a term."""
    usable = d > floor
    return np.where(usable, b * b / np.where(usable, (d + alpha) * yy, 1.0), 0.0) if yy > 0 else np.zeros(len(b))


def forward(q: Gram, n_terms: int, alpha: float = 0.0, err_tol: float | None = None) -> tuple[list[int], list[float]]:
    """Orthogonal forward regression: each step takes the term with the largest error reduction ratio and
    removes its direction from the others, which is one elimination step on the Gram matrix.  Ties: first term."""
    g, b = q.g.copy(), q.b.copy()
    floor = 1e-13 * np.maximum(np.diag(q.g), 1e-300)
    chosen, found = [], []
    for _ in range(min(n_terms, len(b))):
        d = np.diag(g)
        err = ratios(d, b, q.yy, floor, alpha)
        err[chosen] = -1
        k = int(np.argmax(np.round(err, 14)))
        chosen.append(k)
        found.append(float(err[k]))
        if d[k] > floor[k]:
            row = g[k] / d[k]
            b = b - row * b[k]
            g = g - np.outer(g[:, k], row)
        if err_tol is not None and sum(found) >= err_tol:
            break
    return chosen, found


def aic(n, var, m, log=math.log):
    """Criteria take numbers, or columns with ``log`` = ``functions.ln``."""
    return n * log(var) + 2 * m


def aicc(n, var, m, log=math.log):
    return aic(n, var, m, log) + 2 * m * (m + 1) / (n - m - 1)


def bic(n, var, m, log=math.log):
    return n * log(var) + m * log(n)


def fpe(n, var, m, log=math.log):
    return n * log(var) + n * log((n + m) / (n - m))


def lilc(n, var, m, log=math.log):
    return n * log(var) + 2 * m * log(log(n))


def apress(n, mse, m, log=math.log, penalty: float = 1.0):
    """Infinite, or null for columns, without room for the terms."""
    room = n - penalty * m
    if not isinstance(room, (int, float)):
        return (n / room) * (n / room) * mse
    return (n / room) ** 2 * mse if room > 0 else math.inf


CRITERIA = {"aic": aic, "aicc": aicc, "bic": bic, "fpe": fpe, "lilc": lilc, "apress": apress}


def by_order(q: Gram, order: list[int], criterion: str, estimator=least_squares, residual=None) -> list[float]:
    """Criterion of the first 1..len(order) terms: the greedy prefixes are nested, so one search serves all.

    Where the Gram matrix has no digits left for the residual, ``residual(indices, theta)`` gives its variance from the data.
    """
    out = []
    for m in range(1, len(order) + 1):
        s = q.sub(order[:m])
        theta = estimator(s)
        var = s.residual_variance(theta)
        if var < 1e-10 * q.yy / q.n and residual:
            var = residual(order[:m], theta)
        var = max(var, 1e-300)
        out.append(CRITERIA[criterion](q.n, s.sse(theta) / q.n if criterion == "apress" else var, m))
    return out


def best_order(values: list[float], criterion: str) -> int:
    """Number of terms: up to the first increase, or the global minimum for apress."""
    if criterion == "apress":
        return int(np.argmin(values)) + 1
    return next((i + 1 for i in range(len(values) - 1) if values[i + 1] > values[i]), len(values))


def accelerated(q: Gram | Columns, k: int, width: int = 1, threshold: float = 1e-9, estimator=least_squares) -> tuple[list[int], np.ndarray]:
    """Accelerated orthogonal least squares: ``width`` terms an iteration by their projected contribution.

    Only the columns of the terms taken are needed.  Terms come back in column order without zero coefficients.
    """
    q = Dense(q) if isinstance(q, Gram) else q
    d, b, left = q.d.copy(), q.b.copy(), q.yy
    floor = 1e-13 * np.maximum(q.d, 1e-300)
    rows = np.zeros((0, q.m))
    chosen: list[int] = []
    for _ in range(min(k, q.n // max(1, width))):
        if math.sqrt(max(left, 0.0)) <= threshold or len(chosen) >= q.m:
            break
        ok = d > floor
        gain = np.where(ok, b * b / np.where(ok, d, 1.0), 0.0)
        gain[chosen] = 0
        order = np.argsort(-gain, kind="stable")
        q.fetch(order[: max(width, AHEAD)].tolist())
        for j in order[:width].tolist():
            if j in chosen or d[j] <= floor[j]:
                continue
            chosen.append(j)
            # the direction that the term adds, as its products with all candidates
            row = (q.column(j) - rows[:, j] @ rows) / math.sqrt(d[j])
            along = b[j] / math.sqrt(d[j])
            left -= along * along
            b = b - row * along
            d = d - row * row
            rows = np.vstack([rows, row])
    theta = estimator(q.gram(chosen))
    if width > 1 and len(chosen) > k:
        chosen = [chosen[i] for i in np.argsort(-np.abs(theta), kind="stable")[:k]]
        theta = estimator(q.gram(chosen))
    kept = sorted((c, t) for c, t in zip(chosen, theta) if t != 0)
    return [c for c, _ in kept], np.array([t for _, t in kept])
