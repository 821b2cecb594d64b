"""Multi-objective least squares: dynamic data, a static function and its gain share one set of coefficients.

At rest every lag of a variable has the same value, so each term becomes a power of the static
output times powers of the inputs, and its derivative tells the gain.  Every objective is one Gram
matrix; a weight for each gives one solution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import Term, factors, variable
from .estimate import least_squares
from .gram import Gram, gram_of


def exponents(terms: list[Term]) -> list[dict[str, int]]:
    """How often each variable occurs in every term, whatever the lag."""
    out = []
    for name, _ in terms:
        by: dict[str, int] = {}
        for f in factors(name):
            by[variable(f)] = by.get(variable(f), 0) + 1
        out.append(by)
    return out


def clusters(terms: list[Term]) -> tuple[list[dict[str, int]], np.ndarray]:
    """(distinct exponents, R): R[c, j] is 1 where term j belongs to cluster c."""
    every = exponents(terms)
    kinds = [e for i, e in enumerate(every) if e not in every[:i]]
    return kinds, np.array([[int(e == kind) for e in every] for kind in kinds])


def _power(column: str, n: int) -> str:
    return " * ".join([column] * n) or "1D"


def static_terms(terms: list[Term]) -> list[str]:
    """SQL of every term at rest, over y and x1.."""
    return [" * ".join(_power(v, n) for v, n in sorted(e.items())) or "1D" for e in exponents(terms)]


def gain_terms(terms: list[Term]) -> list[str]:
    """SQL of every term's part in the gain, over gain, y and x1..: d/dy times the gain plus the derivatives by the inputs, each of its own power."""
    out = []
    for e in exponents(terms):
        parts = [(f"gain * {n} * " if v == "y" else f"{n} * ") + _power(v, n - 1) for v, n in sorted(e.items())]
        out.append(" + ".join(parts) or "0D")
    return out


def _gram(rows: DataFrame, target: str, parts: list[str]) -> Gram:
    return gram_of(rows.select(F.expr(target).alias("y"), *(F.expr(sql).cast("double").alias(f"t{i}") for i, sql in enumerate(parts))), len(parts))


def weights(spark: SparkSession, function: bool = True, gain: bool = True, start: float = -0.01, stop: float = -5.0, num: int = 50, base: float = 2.71) -> DataFrame:
    """(dynamic, function, gain): log-spaced weights that add up to 1; the column of an objective that is left out is 0."""
    if num < 1:
        raise ValueError("num must be positive")
    steps = F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: F.pow(F.lit(float(base)), F.lit(float(start)) + (float(stop) - float(start)) * i / max(1, num - 1)))
    w = spark.range(1).select(F.explode(steps).alias("dynamic"))
    rest, zero = (1 - F.col("dynamic")), F.lit(0.0)
    if not (function and gain):
        return w.select("dynamic", (rest if function else zero).alias("function"), (rest if gain else zero).alias("gain"))
    # num weights for each of num weights
    both = w.select("dynamic", F.explode(steps).alias("gain")).where("dynamic + gain <= 1")
    return both.select("dynamic", (1 - (F.col("dynamic") + F.col("gain"))).alias("function"), "gain")


def affine_least_squares(psi: DataFrame, terms: list[Term], weighing: Sequence[Sequence[float]], static: DataFrame | None = None, gain: DataFrame | None = None) -> list[dict]:
    """A row for each weighing (dynamic, function, gain): weights, theta, the errors of the objectives, and their norm.

    psi: regressors of the dynamic data; static (y, x1..) and gain (gain, y, x1..) hold data at rest, either or both.  Errors and norms are
    divided by their largest; the best compromise has the least norm.
    """
    if static is None and gain is None:
        raise ValueError("without data at rest there is one objective only")
    objectives = [(0, gram_of(psi, len(terms)))]
    if static is not None:
        objectives.append((1, _gram(static, "y", static_terms(terms))))
    if gain is not None:
        objectives.append((2, _gram(gain, "gain", gain_terms(terms))))
    out = []
    for w in weighing:
        g = sum(w[i] * q.g for i, q in objectives)
        b = sum(w[i] * q.b for i, q in objectives)
        theta = least_squares(Gram(g, b, 0.0, np.zeros(len(b)), 0.0, 1))
        out.append({"weights": tuple(w), "theta": theta, "errors": np.array([max(0.0, q.sse(theta)) for _, q in objectives])})
    most = np.max([r["errors"] for r in out], axis=0)
    norms = np.array([np.linalg.norm(r["errors"]) for r in out])
    for r, norm in zip(out, norms):
        r["errors"] = r["errors"] / np.where(most > 0, most, 1.0)
        r["norm"] = float(norm / norms.max()) if norms.max() > 0 else 0.0
    return out
