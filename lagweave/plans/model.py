"""Fit and predict: a model is a small table of terms, everything else is a query."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basis as bases
from ..functions.basis import Basis, Polynomial, Term, index_of, lag_columns, lags, product_terms
from ..functions.equations import equation, results
from ..operators import estimate, predict, qr, select, wide
from ..operators.gram import Gram, gram, packed, unpack
from ..operators.lagging import regressors
from ..sources.series import validate

SEARCHES = ("frols", "aols", "osf", "oif", "oos", "all")
EPS = float(np.finfo(float).eps)
#: Candidates from which a search fetches columns of the Gram matrix as it needs them.
WIDE = 1000


@dataclass(frozen=True)
class Spec:
    """What to identify: lags, basis, search, criterion and estimator."""

    ylag: int | list[int] = 2
    xlag: tuple = (2,)
    model_type: str = "NARMAX"
    basis: Basis = field(default_factory=Polynomial)
    search: str = "frols"
    n_terms: int | None = None
    n_info_values: int = 15
    criterion: str = "aic"
    estimator: str = "least_squares"
    err_tol: float | None = None
    bucket: int | None = None
    #: "gram", or "qr" for least squares and ridge by R factors, which keep the digits that the Gram matrix loses.
    solver: str = "gram"
    #: Extended least squares with so many lags of the residuals, expanded by the basis; 0: none.
    elag: int = 0

    def __post_init__(self):
        if self.solver not in ("gram", "qr") or self.elag < 0:
            raise ValueError("unknown solver, or elag below 0")
        if self.solver == "qr" and self.estimator not in ("least_squares", "ridge", "total_least_squares"):
            raise ValueError("no estimator of this name by R factors")
        if self.search not in SEARCHES or self.criterion not in select.CRITERIA or self.estimator not in estimate.ESTIMATORS:
            raise ValueError("unknown search, criterion or estimator")
        if self.n_terms is not None and self.n_terms < 1 or self.n_info_values < 1:
            raise ValueError("numbers of terms must be positive")

    @property
    def columns(self) -> list[str]:
        return lag_columns(lags(self.ylag), [lags(x) for x in self.xlag], self.model_type)

    @property
    def candidates(self) -> list[Term]:
        return self.basis.terms(self.columns)


@dataclass(frozen=True)
class Model:
    """Selected terms with coefficients and error reduction ratios."""

    columns: list[str]
    terms: list[Term]
    theta: list[float]
    err: list[float]
    criterion: list[float] = field(default_factory=list)

    def predict(self, series: DataFrame, steps_ahead: int | None = None) -> DataFrame:
        """(series_id, k, y, yhat): 1 step, blocks of several, or a free run (None); models without y lags always one step."""
        self._check_inputs(series)
        if steps_ahead is not None and (isinstance(steps_ahead, bool) or not isinstance(steps_ahead, int) or steps_ahead < 1):
            raise ValueError("steps_ahead must be an integer from 1, or None")
        if steps_ahead == 1 or not any(c.startswith("y_") for c in self.columns):
            return predict.one_step(series, self.columns, self.terms, self.theta)
        return predict.n_steps(series, self.columns, self.terms, self.theta, steps_ahead)

    def forecast(self, series: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        """(series_id, k, yhat) after the end of each series; a model with inputs takes theirs from ``future`` (series_id, k, x1..)."""
        self._check_inputs(series)
        if future is not None:
            self._check_inputs(future)
        return predict.forecast(series, self.columns, self.terms, self.theta, horizon, future=future)

    def _check_inputs(self, series: DataFrame) -> None:
        missing = sorted({c.rpartition("_")[0] for c in self.columns} - {"y", *series.columns})
        if missing:
            raise ValueError(f"the model needs {missing}")

    def table(self, spark: SparkSession) -> DataFrame:
        """(pos, term, expression, theta, err); a term that a Python function computes has no expression."""
        rows = [(i, n, s if isinstance(s, str) else None, float(t), float(e)) for i, ((n, s), t, e) in enumerate(zip(self.terms, self.theta, self.err))]
        return spark.createDataFrame(rows, "pos int, term string, expression string, theta double, err double")

    def save(self, spark: SparkSession, path: str) -> None:
        df = self.table(spark).withColumn("columns", F.array(*map(F.lit, self.columns)))
        df.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, basis: Basis | None = None) -> Model:
        """A saved model; terms without an expression are those of that name of ``basis``."""
        rows = spark.read.parquet(path).orderBy("pos").collect()
        if not rows:
            return Model([], [], [], [])
        known = dict(basis.terms(list(rows[0]["columns"]))) if basis is not None else {}
        lost = [r["term"] for r in rows if r["expression"] is None and r["term"] not in known]
        if lost:
            raise ValueError(f"{lost} were computed by a Python function: give the basis")
        return Model(list(rows[0]["columns"]), [(r["term"], r["expression"] if r["expression"] is not None else known[r["term"]]) for r in rows], [r["theta"] for r in rows], [r["err"] for r in rows])

    def equation(self, digits: int = 4, style: str = "text") -> str:
        """y(k) = ... in text, latex or ascii."""
        return equation([n for n, _ in self.terms], self.theta, digits, style)

    def results(self, theta_digits: int = 4, err_digits: int = 8, scientific: bool = False) -> list[tuple[str, str, str]]:
        """(regressor, coefficient, error reduction ratio) as text."""
        return results([n for n, _ in self.terms], self.theta, self.err, theta_digits, err_digits, scientific)


def choose(q: Gram, spec: Spec, residual=None) -> tuple[list[int], list[float], list[float]]:
    """(terms in order, their error reduction ratios, criterion by order) from the Gram matrix."""
    m = len(q.b)
    k = min(spec.n_terms or spec.n_info_values, m)
    if spec.search == "all":
        order = list(range(m))
    elif spec.search == "aols":
        order = select.accelerated(q, k)[0]
    elif spec.search == "frols":
        order = select.forward(q, k, err_tol=spec.err_tol)[0]
    else:
        order = getattr(select.Floating(q), spec.search)(k)
    values: list[float] = []
    if spec.n_terms is None and spec.search == "frols":
        values = select.by_order(q, order, spec.criterion, estimate.ESTIMATORS[spec.estimator], residual)
        order = order[: select.best_order(values, spec.criterion)]
    sub = q.sub(order)
    position, ratios = select.forward(sub, len(order))
    by = dict(zip(position, ratios))
    return order, [by.get(i, 0.0) for i in range(len(order))], values


def _finite(series: DataFrame, columns: list[str], *sums) -> None:
    """An error that names the column if a sum shows that a value was null, NaN or infinite."""
    if not all(np.isfinite(x).all() for x in sums):
        validate(series, sorted({"y", *(c.rpartition("_")[0] for c in columns)}))
        raise ValueError("a term overflows on these values")


def fit(series: DataFrame, spec: Spec) -> Model:
    """Lag, expand, one Gram pass, search, estimate; from ``WIDE`` candidates on a search takes a pass for some chosen terms."""
    columns, terms = spec.columns, spec.candidates

    def residual(idx: list[int], theta) -> float:
        value = sum((F.lit(float(t)) * F.col(f"t{i}") for i, t in enumerate(theta)), F.lit(0.0))
        psi = regressors(series, columns, [terms[i] for i in idx], spec.bucket)
        return float(psi.agg(F.var_samp(F.col("y") - value)).first()[0])

    solve = estimate.ESTIMATORS[spec.estimator]
    if spec.search != "all" and len(terms) >= WIDE:
        held = wide.Columns(series, columns, terms, spec.bucket)
        try:
            _finite(series, columns, held.d, held.b)
            k = spec.n_terms or spec.n_info_values
            if spec.search == "frols":
                order, err = wide.forward(held, k, err_tol=spec.err_tol)
            else:
                order = select.accelerated(held, k)[0] if spec.search == "aols" else getattr(select.Floating(held), spec.search)(k)
            q = held.gram(order)
        finally:
            held.close()
        values: list[float] = []
        if spec.search != "frols":
            position, found = select.forward(q, len(order))
            err = [dict(zip(position, found)).get(i, 0.0) for i in range(len(order))]
        elif spec.n_terms is None:
            values = select.by_order(q, list(range(len(order))), spec.criterion, solve, lambda idx, theta: residual([order[i] for i in idx], theta))
            order = order[: select.best_order(values, spec.criterion)]
            err = err[: len(order)]
        q = q.sub(range(len(order)))
    else:
        q = gram(series, columns, terms, spec.bucket)
        _finite(series, columns, q.g, q.b)
        order, err, values = choose(q, spec, residual)
        q = q.sub(order)
    if spec.solver == "qr":
        r = qr.factor(regressors(series, columns, [terms[i] for i in order], spec.bucket), len(order))
        theta = qr.total(r) if spec.estimator == "total_least_squares" else qr.solve(r, EPS if spec.estimator == "ridge" else 0.0)
    else:
        estimate.check_rank(q)
        theta = solve(q)
    if spec.elag:
        theta = estimate.unbiased(series, columns, [terms[i] for i in order], theta, spec.elag, basis=spec.basis, bucket=spec.bucket)
    return Model(columns, [terms[i] for i in order], [float(t) for t in theta], err, values)


def given(series: DataFrame, wanted: list[str], theta: list[float] | None = None, estimator: str = "least_squares") -> Model:
    """A model whose terms are given by name, in that order: coefficients as given, or estimated on the series.

    The ratios are those of the terms in the order in which they reduce the error most.
    """
    columns, terms = product_terms(wanted)
    index_of(terms, wanted)
    if theta is not None and len(theta) != len(terms):
        raise ValueError(f"{len(terms)} terms need as many coefficients")
    q = gram(series, columns, terms)
    _finite(series, columns, q.g, q.b)
    position, found = select.forward(q, len(terms))
    by = dict(zip(position, found))
    if theta is None:
        theta = estimate.ESTIMATORS[estimator](q)
    return Model(columns, terms, [float(t) for t in theta], [by.get(i, 0.0) for i in range(len(terms))])


def simulate(series: DataFrame, wanted: list[str], theta: list[float] | None = None, steps_ahead: int | None = None, train: DataFrame | None = None, estimator: str = "least_squares") -> tuple[Model, DataFrame]:
    """A given model and its prediction of ``series``; without ``theta`` it is estimated on ``train``, or on the series itself."""
    model = given(train if train is not None else series, wanted, theta, estimator)
    return model, model.predict(series, steps_ahead)


def fit_by_series(series: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, term, pos, theta, err): the same search for every series, from its Gram matrix summed in SQL.

    What meets in a task is one Gram matrix a series, never its samples.  A series without a sample beyond its lags has no row.
    """
    columns, terms = spec.columns, spec.candidates
    m = len(terms)
    psi = regressors(series, columns, terms)
    names = [n for n, _ in terms]
    kind = series.schema["series_id"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                q = unpack(r.values, m)
                order, err, _ = choose(q, spec)
                theta = estimate.ESTIMATORS[spec.estimator](q.sub(order))
                rows += [(r.series_id, names[i], p, float(t), float(e)) for p, (i, t, e) in enumerate(zip(order, theta, err))]
            yield pd.DataFrame(rows, columns=["series_id", "term", "pos", "theta", "err"])

    return packed(psi, m).mapInPandas(run, f"series_id {kind}, term string, pos int, theta double, err double")


def coefficients(models: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, theta): the coefficients of ``fit_by_series`` over all candidates in order, 0 where a term was not chosen."""
    by = models.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "theta"))).alias("by"))
    names = F.array(*(F.lit(n) for n, _ in spec.candidates))
    return by.select("series_id", F.transform(names, lambda n: F.coalesce(F.element_at("by", n), F.lit(0.0))).alias("theta"))


__all__ = ["Spec", "Model", "fit", "fit_by_series", "coefficients", "given", "simulate", "bases"]
