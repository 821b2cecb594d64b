"""Batch estimators on a Gram matrix."""

from __future__ import annotations

import re
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.basis import Basis, Polynomial, Term
from ..sources.scratch import materialize
from . import qr
from .gram import Gram, gram_of, grouped
from .lagging import lagged, regressors


def least_squares(q: Gram) -> np.ndarray:
    return numerics.min_norm(q.g, q.b)


def check_rank(q: Gram) -> None:
    """A warning if the terms are not independent: their coefficients are then one choice among many."""
    scale = np.sqrt(np.where(np.diag(q.g) > 0, np.diag(q.g), 1.0))
    rank = np.linalg.matrix_rank(q.g / np.outer(scale, scale), tol=1e-12 * max(1, len(q.b)), hermitian=True) if len(q.b) else 0
    if rank < len(q.b):
        warnings.warn(f"{len(q.b)} terms have rank {rank}", stacklevel=2)


def ridge(q: Gram, alpha: float = float(np.finfo(float).eps)) -> np.ndarray:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return np.linalg.solve(q.g + alpha * np.eye(len(q.b)), q.b)


def total_least_squares(q: Gram) -> np.ndarray:
    """From the least eigenvector of the Gram matrix of [Psi y]."""
    full = np.block([[q.g, q.b[:, None]], [q.b[None], np.array([[q.yy]])]])
    v = np.linalg.eigh(full)[1][:, 0]
    if abs(v[-1]) < 1e-15:
        raise ValueError("no total least squares solution")
    return -v[:-1] / v[-1]


def affine_lms(q: Gram, mu: float = 0.01, offset_covariance: float = 0.2) -> np.ndarray:
    """Affine least mean squares over the whole sample."""
    if mu <= 0 or offset_covariance < 0:
        raise ValueError("mu must be positive and offset_covariance not negative")
    return _affine(q, mu, offset_covariance)


def _affine(q: Gram, mu: float, offset_covariance: float) -> np.ndarray:
    """n - m batch updates mu (G + cI)+ (b - G theta) from zero, summed up in the eigenvectors of G."""
    value, vector = np.linalg.eigh(q.g)
    value = np.maximum(value, 0.0)
    gain = np.where(value + offset_covariance > 0, mu / np.where(value + offset_covariance > 0, value + offset_covariance, 1.0), 0.0)
    rounds = max(0, q.n - len(q.b))
    shrink = 1 - gain * value
    total = np.where(shrink == 1, rounds * gain, (1 - shrink**rounds) / np.where(value > 0, value, 1.0))
    return vector @ (total * (vector.T @ q.b))


def non_negative(q: Gram) -> np.ndarray:
    return numerics.nnls(q.g, q.b)


def bounded(q: Gram, low: float | np.ndarray = -np.inf, high: float | np.ndarray = np.inf) -> np.ndarray:
    m = len(q.b)
    return numerics.bounded(q.g, q.b, np.broadcast_to(np.asarray(low, float), m), np.broadcast_to(np.asarray(high, float), m))


def minimal_residual(q: Gram, damp: float = 0.0) -> np.ndarray:
    """Damped minimum-norm least squares."""
    return numerics.min_norm(q.g + damp * damp * np.eye(len(q.b)), q.b)


ESTIMATORS = {"least_squares": least_squares, "ridge": ridge, "total_least_squares": total_least_squares, "affine_lms": affine_lms, "non_negative": non_negative, "bounded": bounded, "minimal_residual": minimal_residual}


def by_series(psi: DataFrame, m: int, estimator: str = "least_squares", **options) -> DataFrame:
    """(series_id, theta): an estimator for every series, from its Gram matrix summed in SQL."""
    solve = ESTIMATORS[estimator]
    kind = psi.schema["series_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            theta = [solve(Gram(np.array(r.g).reshape(m, m), np.array(r.b), r.yy, np.array(r.s), r.ys, r.n), **options).tolist() for r in pdf.itertuples()]
            yield pdf[["series_id"]].assign(theta=theta)

    return grouped(psi, m).mapInPandas(run, f"series_id {kind}, theta array<double>")


def unbiased(series: DataFrame, columns: list[str], terms: list[Term], theta: np.ndarray, elag: int = 2, rounds: int = 20, estimator=None, tolerance: float = 1e-12, basis: Basis | None = None, bucket: int | None = None) -> np.ndarray:
    """Extended least squares: the residuals' lags 1..elag, expanded by ``basis`` as if they were outputs, join the regressors, and the fit is repeated with the
    residuals of the extended model, which are 0 before the first row.

    basis: that of the model, by default its lags alone (a polynomial of degree 1 without a constant).  A round is one lag and one pass; the residuals travel
    in a table.  ``estimator`` takes a Gram matrix; by default the fit is least squares by R factors, of least norm where
    the basis repeats a column of the model.  Ends when no coefficient changes by more than ``tolerance``, after ``rounds`` at the latest.
    """
    if elag < 1 or rounds < 1:
        raise ValueError("needs an elag and a round at least")
    m = len(terms)
    lags = [f"e_{j}" for j in range(1, elag + 1)]
    expand = basis or Polynomial(1, False)
    # a basis knows lags of y; its expressions are turned to those of e
    extra = [re.sub(r"\by_(\d+)\b", r"e_\1", sql) for _, sql in expand.terms([f"y_{j}" for j in range(1, elag + 1)])]
    names = [f"t{i}" for i in range(m)]
    psi = materialize(regressors(series, columns, terms, bucket), "regressors")

    def residual(frame: DataFrame, over: list[str], value: np.ndarray) -> DataFrame:
        fit = sum((F.lit(float(a)) * F.col(c) for a, c in zip(value, over)), F.lit(0.0))
        return materialize(frame.select("series_id", "k", "y", *names, (F.col("y") - fit).alias("e")), "residuals")

    every = [f"t{i}" for i in range(m + len(extra))]
    now, full = residual(psi, names, np.asarray(theta, float)), None
    for _ in range(rounds):
        wide = lagged(now, lags, bucket)
        wide = wide.select("series_id", "k", "y", *names, *(F.expr(sql).cast("double").alias(f"t{m + j}") for j, sql in enumerate(extra)))
        old, full = full, estimator(gram_of(wide, len(every))) if estimator else qr.solve(qr.factor(wide, len(every)))
        if old is not None and np.abs(full - old).max() <= tolerance:
            break
        now = residual(wide, every, full)
    return full[:m]
