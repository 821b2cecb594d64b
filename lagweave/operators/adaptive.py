"""Adaptive estimators over each series: the LMS family and recursive least squares.

Updates that are affine in the coefficients, and recursive least squares, whose state is a discounted sum of products, are
associative scans (``scan``): a long series is worked on by as many tasks as it has stretches.  The other rules, with a sign or a power of the
error, depend on the state itself and are ordered folds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .fold import ordered


def _sign(v: float) -> float:
    return (v > 0) - (v < 0)


#: Update of one coefficient: t its value, p its regressor, e the error, g the step, n eps plus the regressors' squared norm, a leak, a weight.
RULES: dict[str, Callable] = {
    "lms": lambda t, p, e, g, n, a, w: t + 2 * g * e * p,
    "sign_error": lambda t, p, e, g, n, a, w: t + g * _sign(e) * p,
    "normalized": lambda t, p, e, g, n, a, w: t + 2 * g * e * p / n,
    "normalized_sign_error": lambda t, p, e, g, n, a, w: t + 2 * g * _sign(e) * p / n,
    "sign_regressor": lambda t, p, e, g, n, a, w: t + g * e * _sign(p),
    "normalized_sign_regressor": lambda t, p, e, g, n, a, w: t + g * e * _sign(p) / n,
    "sign_sign": lambda t, p, e, g, n, a, w: t + 2 * g * _sign(e) * _sign(p),
    "normalized_sign_sign": lambda t, p, e, g, n, a, w: t + 2 * g * _sign(e) * _sign(p) / n,
    "normalized_leaky": lambda t, p, e, g, n, a, w: t * (1 - g * a) + g * e * p / n,
    "leaky": lambda t, p, e, g, n, a, w: t * (1 - g * a) + g * e * p,
    "fourth": lambda t, p, e, g, n, a, w: t + g * p * e * e * e,
    "mixed_norm": lambda t, p, e, g, n, a, w: t + g * p * e * (w + (1 - w) * e * e),
}


#: Rules with theta -> (1 - g a) theta + g f (y - p'theta) l: (factor f, whether divided by n, whether l is the sign of p, whether it leaks).
AFFINE: dict[str, tuple[float, bool, bool, bool]] = {
    "lms": (2.0, False, False, False),
    "normalized": (2.0, True, False, False),
    "sign_regressor": (1.0, False, True, False),
    "normalized_sign_regressor": (1.0, True, True, False),
    "leaky": (1.0, False, False, True),
    "normalized_leaky": (1.0, True, False, True),
}


def affine_steps(m: int, rule: str, mu: float, eps: float, gama: float) -> scan.Steps:
    """Steps of an affine rule over rows (y, p0..pm-1, row); the first m rows change nothing."""
    factor, normed, signed, leaks = AFFINE[rule]

    def steps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, p, late = data[:, 0], data[:, 1 : m + 1], data[:, m + 1] > m
        gain = np.full(len(y), mu * factor)
        if normed:
            gain /= eps + np.einsum("ij,ij->i", p, p)
        side = np.where(late, gain, 0.0)[:, None] * (np.sign(p) if signed else p)
        a = -side[:, :, None] * p[:, None, :]
        a[:, np.arange(m), np.arange(m)] += np.where(late & leaks, 1 - mu * gama, 1.0)[:, None]
        return a, (side * y[:, None])[:, :, None]

    return steps


def discounted_steps(m: int, lam: float, delta: float) -> scan.Steps:
    """Steps of (sum of lam^age x x' + lam^n delta I, sum of lam^age x y) over rows (y, x0..xm-1, row), from row 3 on; the first row sets delta I."""

    def steps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, x, row = data[:, 0], data[:, 1 : m + 1], data[:, m + 1]
        late = row > 2
        b = np.concatenate([(x[:, :, None] * x[:, None, :]).reshape(len(y), m * m), x * y[:, None]], axis=1) * late[:, None]
        b[row == 1, : m * m] = delta * np.eye(m).ravel()
        return np.where(late, lam, 1.0)[:, None, None], b[:, None, :]

    return steps


def _dot(a: list, b: list) -> float:
    return sum(x * y for x, y in zip(a, b))


def lms(psi: DataFrame, m: int, rule: str = "lms", mu: float = 0.01, eps: float = 2.220446049250313e-16, gama: float = 0.2, weight: float = 0.02, length: int | None = None) -> DataFrame:
    """(series_id, theta) after a pass over psi (series_id, k, y, t0..tm-1), k dense; updates begin after row m, from zeros."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in [0, 1]")
    if mu <= 0 or eps <= 0:
        raise ValueError("mu and eps must be positive")
    columns = ["y", *(f"t{i}" for i in range(m))]
    if rule in AFFINE:
        rows, single = scan.placed(psi, length)
        return scan.final(rows, [*columns, "row"], (m, 1), affine_steps(m, rule, mu, eps, gama), single).select("series_id", F.col("value").alias("theta"))
    update = RULES[rule]

    def step(state: dict, k: int, y: float, *p: float) -> list:
        state["row"] += 1
        if state["row"] > m:
            e, n = y - _dot(state["theta"], p), eps + _dot(p, p)
            state["theta"] = [update(t, v, e, mu, n, gama, weight) for t, v in zip(state["theta"], p)]
        return state["theta"]

    out = ordered(psi, columns, lambda *row: {"row": 0, "theta": [0.0] * m}, step, "array<double>", last_only=True)
    return out.select("series_id", F.col("value").alias("theta"))


def rls(psi: DataFrame, m: int, lam: float = 0.98, delta: float = 0.01, path: bool = False, length: int | None = None) -> DataFrame:
    """(series_id, theta) by recursive least squares with forgetting, P = I / delta, from row 3 on, k dense; with ``path`` (series_id, k, theta) for every row.

    The recursion's theta solves the normal equations of products discounted by their age, and these are sums.
    """
    if not 0 < lam <= 1 or delta <= 0:
        raise ValueError("lam must lie in (0, 1] and delta be positive")
    columns, shape, steps = ["y", *(f"t{i}" for i in range(m)), "row"], (1, m * m + m), discounted_steps(m, lam, delta)
    rows, single = scan.placed(psi, length)

    def solved(held: np.ndarray) -> np.ndarray:
        """theta of (n, m * m + m) sums; NaN where they overflowed."""
        whole = np.isfinite(held).all(1)
        held = np.where(whole[:, None], held, np.r_[np.eye(m).ravel(), np.full(m, np.nan)])
        g, b = held[:, : m * m].reshape(-1, m, m), held[:, m * m :]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", g), 1e-300))
        return np.einsum("nij,nj->ni", np.linalg.pinv(g / scale[:, :, None] / scale[:, None, :], hermitian=True), b / scale) / scale

    as_lists = lambda theta: pa.array(theta.tolist(), pa.list_(pa.float64()))
    if path:
        return scan.run(rows, columns, shape, steps, lambda held, data: as_lists(solved(held[:, 0])), "array<double>", single).select("series_id", "k", F.col("value").alias("theta"))

    def run(batches):
        for batch in batches:
            held = np.asarray(batch["value"].flatten()).reshape(batch.num_rows, m * m + m)
            yield pa.RecordBatch.from_arrays([batch["series_id"], as_lists(solved(held))], ["series_id", "theta"])

    kind = psi.schema["series_id"].dataType.simpleString()
    return scan.final(rows, columns, shape, steps, single).mapInArrow(run, f"series_id {kind}, theta array<double>")
