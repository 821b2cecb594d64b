"""Queries by name over the test tables, with the SQL that checks them.

Views: E events by user, O daily orders, L daily shipments.  Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import basis, metrics, residuals
from .functions.basis import Polynomial
from .operators import adaptive, affine, estimate, gram, lagging, neural, predict, qr, robust, select, swarm
from .plans import model
from .sources import series

QUERIES: dict = {}
ORACLE: dict = {}

E = "e as (select user_id series_id, row_number() over (partition by user_id order by ts, event_id) k, cast(value as double) y from events)"
O = "o as (select 0::bigint series_id, row_number() over (order by d) k, y, x1 from (select cast(o_orderdate as date) d, sum(o_totalprice) / 1e6 y, cast(count(*) as double) x1 from orders group by 1))"
L = "l as (select 0::bigint series_id, row_number() over (order by d) k, y, x1, x2 from (select cast(l_shipdate as date) d, sum(l_extendedprice) / 1e6 y, sum(l_quantity) / 1e3 x1, avg(l_discount) x2 from lineitem group by 1))"
#: AR(2) by user: lags, normal equations, coefficients, one-step prediction.
AR2 = f"""{E},
 b as (select series_id, k, y, coalesce(lag(y, 1) over w, 0.0) y1, coalesce(lag(y, 2) over w, 0.0) y2 from e window w as (partition by series_id order by k)),
 p as (select * from b where k > 2),
 g as (select series_id, sum(y1*y1) a, sum(y1*y2) c, sum(y2*y2) d, sum(y1*y) e1, sum(y2*y) f from p group by series_id),
 th as (select series_id, (e1*d-f*c)/(a*d-c*c) t1, (a*f-c*e1)/(a*d-c*c) t2 from g),
 r as (select p.series_id, k, y, t1*y1 + t2*y2 yhat from p join th on p.series_id = th.series_id)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0 becomes 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 {c}" for c in columns.split())


COLS2 = ["y_1", "y_2"]
TERMS2 = [basis.product((c,)) for c in COLS2]


def ar2_models(e: DataFrame) -> DataFrame:
    """(series_id, theta) of an AR(2) for every series by least squares."""
    return estimate.by_series(lagging.regressors(e, COLS2, TERMS2), 2)


def ar2(spark: SparkSession, sf: str) -> DataFrame:
    e = series.events(spark, sf)
    return predict.one_step_by_series(e, COLS2, TERMS2, ar2_models(e)).where("k > 2")


@query("ar2_one_step_rrse", f"with {AR2}, m as (select *, avg(y) over (partition by series_id) m from r) select series_id, round(sqrt(sum((yhat-y)*(yhat-y)) / sum((y-m)*(y-m))), 6) rrse from m group by series_id")
def ar2_one_step_rrse(spark, sf):
    return _round(ar2(spark, sf).groupBy("series_id").agg(metrics.root_relative_squared_error().alias("rrse")))


@query("ar2_one_step", f"with {AR2} select series_id, k, {_r('y yhat')} from r")
def ar2_one_step(spark, sf):
    return _round(ar2(spark, sf))


@query("ar1_regression", f"with {E}, b as (select series_id, k, y, lag(y) over (partition by series_id order by k) y1 from e) select series_id, round(regr_slope(y, y1), 6) slope, round(regr_intercept(y, y1), 6) intercept from b where k > 1 group by series_id")
def ar1_regression(spark, sf):
    psi = lagging.regressors(series.events(spark, sf), ["y_1"], [basis.BIAS, ("y_1", "y_1")])
    return _round(estimate.by_series(psi, 2).select("series_id", F.col("theta")[1].alias("slope"), F.col("theta")[0].alias("intercept")))


@query("series_split", f"with {E} select series_id, k, y, case when k <= floor(count(*) over (partition by series_id) * 0.75) then 'train' else 'test' end part from e")
def series_split(spark, sf):
    return series.split(series.events(spark, sf), 0.25)


@query("series_decimate", f"with {E} select series_id, (k - 1) // 5 + 1 k, y from e where (k - 1) % 5 = 0")
def series_decimate(spark, sf):
    return series.decimate(series.events(spark, sf), 5)


_SCALE = {
    "series_minmax": ("minmax", "(y - min(y) over w) / nullif(max(y) over w - min(y) over w, 0)"),
    "series_zscore": ("standard", "(y - avg(y) over w) / nullif(stddev_pop(y) over w, 0)"),
    "series_maxabs": ("maxabs", "y / nullif(max(abs(y)) over w, 0)"),
}
for _name, (_method, _sql) in _SCALE.items():
    QUERIES[_name] = lambda spark, sf, m=_method: _round(series.scale(series.events(spark, sf), ["y"], m))
    ORACLE[_name] = f"with {E} select series_id, k, round({_sql}, 6) + 0.0 y from e window w as (partition by series_id)"


@query("series_check", f"with {E} select count(*) n, count(*) filter (y is null) y_null, count(*) filter (isnan(y)) y_nan, count(*) filter (isinf(y)) y_inf from e")
def series_check(spark, sf):
    return series.check(series.events(spark, sf), ["y"])


@query("series_index", "select event_id, row_number() over (order by ts, event_id) k from events")
def series_index(spark, sf):
    return series.index_series(series.read(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "k")


def _lag_sql(columns: list[str]) -> str:
    return ", ".join(f"coalesce(lag({c.rpartition('_')[0]}, {c.rpartition('_')[2]}) over w, 0.0) {c}" for c in columns)


_VIEWS = {"E": (series.events, E, "e"), "O": (series.orders, O, "o"), "L": (series.shipments, L, "l")}
_LAGS = {
    "lag_nar": ("E", basis.lag_columns([1, 2, 3], [], "NAR")),
    "lag_nfir": ("O", basis.lag_columns([], [[1, 2]], "NFIR")),
    "lag_narmax_siso": ("O", basis.lag_columns([1, 2], [[1, 3]])),
    "lag_narmax_miso": ("L", basis.lag_columns([1, 2], [[1, 2], [2]])),
}
for _name, (_view, _cols) in _LAGS.items():
    _get, _cte, _alias = _VIEWS[_view]
    QUERIES[_name] = lambda spark, sf, g=_get, c=_cols: _round(lagging.lagged(g(spark, sf), c).select("series_id", "k", *c), 8)
    ORACLE[_name] = f"with {_cte}, z as (select series_id, k, {_lag_sql(_cols)} from {_alias} window w as (partition by series_id order by k)) select series_id, k, {_r(' '.join(_cols), 8)} from z"
QUERIES["lag_bucketed"] = lambda spark, sf: _round(lagging.lagged(series.orders(spark, sf), _LAGS["lag_narmax_siso"][1], bucket=100).select("series_id", "k", *_LAGS["lag_narmax_siso"][1]), 8)
ORACLE["lag_bucketed"] = ORACLE["lag_narmax_siso"]

_BASIS_COLS = ["y_1", "x1_1"]
_BASES = {
    "basis_polynomial": Polynomial(3),
    "basis_bilinear": basis.Bilinear(2),
    "basis_fourier": basis.Fourier(n=2),
    "basis_legendre": basis.Legendre(4),
    "basis_hermite": basis.Hermite(3),
    "basis_hermite_norm": basis.HermiteNormalized(3),
    "basis_laguerre": basis.Laguerre(3),
    "basis_bernstein": basis.Bernstein(3),
    "basis_fourier_plain": basis.Fourier(n=1, ensemble=False),
    "basis_legendre_ensemble": basis.Legendre(2, False, True),
}
#: Orders scaled to [0, 1], as the bases are queried on them.
O01 = O + ", s as (select series_id, k, (y - min(y) over ()) / (max(y) over () - min(y) over ()) y, (x1 - min(x1) over ()) / (max(x1) over () - min(x1) over ()) x1 from o), w as (select series_id, k, y, lag(y) over (order by k) y_1, lag(x1) over (order by k) x1_1 from s)"
_DIRECT = {
    "basis_polynomial": "1 y_1 x1_1 y_1*y_1 y_1*x1_1 x1_1*x1_1 y_1*y_1*y_1 y_1*y_1*x1_1 y_1*x1_1*x1_1 x1_1*x1_1*x1_1",
    "basis_legendre": "1 " + " ".join(f"{c} (3*{c}*{c}-1)/2 (5*{c}*{c}*{c}-3*{c})/2 (35*{c}*{c}*{c}*{c}-30*{c}*{c}+3)/8" for c in _BASIS_COLS),
    "basis_hermite": "1 " + " ".join(f"2*{c} 4*{c}*{c}-2 8*{c}*{c}*{c}-12*{c}" for c in _BASIS_COLS),
    "basis_hermite_norm": "1 " + " ".join(f"{c} {c}*{c}-1 {c}*{c}*{c}-3*{c}" for c in _BASIS_COLS),
    "basis_laguerre": "1 " + " ".join(f"1-{c} ({c}*{c}-4*{c}+2)/2 (-{c}*{c}*{c}+9*{c}*{c}-18*{c}+6)/6" for c in _BASIS_COLS),
    "basis_bernstein": "1 " + " ".join(f"3*{c}*(1-{c})*(1-{c}) 3*{c}*{c}*(1-{c}) {c}*{c}*{c}" for c in _BASIS_COLS),
    "basis_bilinear": "1 y_1 x1_1 y_1*x1_1",
    "basis_fourier_plain": " ".join(f"{f}({c})" for c in _BASIS_COLS for f in ("cos", "sin")),
    "basis_legendre_ensemble": "y_1 x1_1 " + " ".join(f"{c} (3*{c}*{c}-1)/2" for c in _BASIS_COLS),
    "basis_fourier": "y_1 x1_1 " + " ".join(f"{f}({h}*{c})" for c in _BASIS_COLS for h in (1, 2) for f in ("cos", "sin")),
}


def _basis(spark: SparkSession, sf: str, b: basis.Basis) -> DataFrame:
    scaled = series.scale(series.orders(spark, sf), ["y", "x1"], "minmax")
    terms = b.terms(_BASIS_COLS)
    return lagging.regressors(scaled, _BASIS_COLS, terms).select("k", *((F.round(f"t{i}", 5) + F.lit(0.0)).alias(f"t{i}") for i in range(len(terms))))


def _order(name: str) -> list[str]:
    """The expected expressions in the order of the basis' own terms."""
    want = _DIRECT[name].split()
    if name in ("basis_polynomial", "basis_bilinear"):
        names = [n for n, _ in _BASES[name].terms(_BASIS_COLS)]
        return [n if n != "1" else "1.0" for n in names if n in want]
    return ["1.0" if w == "1" else w for w in want]


for _name, _b in _BASES.items():
    QUERIES[_name] = partial(_basis, b=_b)
    ORACLE[_name] = f"with {O01} select k, " + ", ".join(f"round(cast({x} as double), 5) + 0.0 t{i}" for i, x in enumerate(_order(_name))) + " from w where k > 1"


def _bumps(lags: np.ndarray) -> np.ndarray:
    """tanh of each lag, a bell over the first and the product of all."""
    return np.column_stack([np.tanh(lags), np.exp(-lags[:, 0] ** 2), lags.prod(1)])


BUMPS = basis.Vectorised(function=_bumps, names=("tanh(y_1)", "tanh(x1_1)", "bell(y_1)", "y_1 x1_1"))


@query("basis_python", f"with {O01} select k, 1.0::double t0, round(tanh(y_1), 5) + 0.0 t1, round(tanh(x1_1), 5) + 0.0 t2, round(exp(-y_1 * y_1), 5) + 0.0 t3, round(y_1 * x1_1, 5) + 0.0 t4 from w where k > 1")
def basis_python(spark, sf):
    """A basis that is a Python function of the lags."""
    return _basis(spark, sf, BUMPS)


@query("basis_python_free_run", f"with recursive {O01}, f as (select k, 0.1 + 0.5 * tanh(y_1) + 0.2 * exp(-y_1 * y_1) + 0.3 * y_1 * x1_1 yhat from w where k = 2 union all select f.k + 1, 0.1 + 0.5 * tanh(f.yhat) + 0.2 * exp(-f.yhat * f.yhat) + 0.3 * f.yhat * w.x1_1 from f join w on w.k = f.k + 1) select 0::bigint series_id, k, round(yhat, 6) + 0.0 yhat from f")
def basis_python_free_run(spark, sf):
    """Its free run with given coefficients."""
    scaled = series.scale(series.orders(spark, sf), ["y", "x1"], "minmax")
    return _round(predict.free_run(scaled, _BASIS_COLS, BUMPS.terms(_BASIS_COLS), [0.1, 0.5, 0.0, 0.2, 0.3]).where("k > 1").select("series_id", "k", "yhat"))


@query("gram_matrix", f"with {E}, z as (select series_id, k, y, {_lag_sql(COLS2)} from e window w as (partition by series_id order by k)), t as (select unnest([0, 1, 2, 3]) i, unnest([1.0, y_1, y_2, y]) v, series_id, k from z where k > 2) select a.i, b.i j, round(sum(a.v * b.v), 4) g from t a join t b using (series_id, k) where a.i <= b.i group by all")
def gram_matrix(spark, sf):
    psi = lagging.regressors(series.events(spark, sf), COLS2, [basis.BIAS, *TERMS2])
    return gram.gram_rows(psi, 3).where("i < 4 and j < 4").select("i", "j", F.round("g", 4).alias("g"))


_ERR_COLS = ["y_1", "y_2", "x1_1", "x1_2"]


@query("err_round1", f"with {O}, z as (select series_id, k, y, {_lag_sql(_ERR_COLS)} from o window w as (partition by series_id order by k)), t as (select y, unnest(['1', 'y_1', 'y_2', 'x1_1', 'x1_2']) term, unnest([1.0, y_1, y_2, x1_1, x1_2]) v from z where k > 2) select term, round(sum(v*y) * sum(v*y) / (sum(v*v) * sum(y*y)), 6) err from t group by term")
def err_round1(spark, sf):
    terms = [basis.BIAS, *(basis.product((c,)) for c in _ERR_COLS)]
    q = gram.gram(series.orders(spark, sf), _ERR_COLS, terms)
    err = select.ratios(q.g.diagonal(), q.b, q.yy, 0 * q.b)
    return spark.createDataFrame([(n, round(float(e), 6)) for (n, _), e in zip(terms, err)], "term string, err double")


#: Two rounds of forward regression: Gram entries of all pairs, the best term, and what it leaves of the others.
_FROLS2 = f"""with {O}, z as (select series_id, k, y, {_lag_sql(_ERR_COLS)} from o window w as (partition by series_id order by k)),
 t as (select k, y, unnest(['1', 'y_1', 'y_2', 'x1_1', 'x1_2']) term, unnest([1.0, y_1, y_2, x1_1, x1_2]) v from z where k > 2),
 g as (select a.term p, b.term q, sum(a.v * b.v) g from t a join t b using (k) group by 1, 2),
 b as (select term, sum(v * y) b, max((select sum(y * y) from z where k > 2)) yy from t group by 1),
 e as (select b.term, b.b, yy, g.g, b.b * b.b / (g.g * yy) err from b join g on g.p = b.term and g.q = b.term),
 f as (select * from e order by err desc limit 1),
 r as (select e.term, (e.b - g.g / f.g * f.b) * (e.b - g.g / f.g * f.b) / ((e.g - g.g * g.g / f.g) * e.yy) err from e, f, g where e.term <> f.term and g.p = e.term and g.q = f.term),
 s as (select * from r order by err desc limit 1)
 select 0 pos, term, round(err, 6) err from f union all select 1, term, round(err, 6) from s"""


@query("frols_two_rounds", _FROLS2)
def frols_two_rounds(spark, sf):
    m = model.fit(series.orders(spark, sf), model.Spec(2, (2,), basis=Polynomial(1), n_terms=2))
    return m.table(spark).select("pos", "term", F.round("err", 6).alias("err"))


@query("ar2_n_step", f"with recursive {AR2}, s as (select b.*, (k - 3) % 5 j from b where k > 2), f as (select series_id, k, y, t1*y1 + t2*y2 yhat, y1 prev, j from s join th using (series_id) where j = 0 union all select s.series_id, s.k, s.y, t1*f.yhat + t2*f.prev, f.yhat, s.j from f join s on s.series_id = f.series_id and s.k = f.k + 1 and s.j > 0 join th on th.series_id = s.series_id) select series_id, k, round(yhat, 6) + 0.0 yhat from f")
def ar2_n_step(spark, sf):
    e = series.events(spark, sf)
    return _round(predict.n_steps(e, COLS2, TERMS2, None, 5, ar2_models(e)).where("k > 2").select("series_id", "k", "yhat"))


@query("ar2_free_run", f"with recursive {AR2}, f as (select series_id, k, t1*y1 + t2*y2 yhat, y1 prev from p join th using (series_id) where k = 3 union all select f.series_id, f.k + 1, t1*f.yhat + t2*f.prev, f.yhat from f join e on e.series_id = f.series_id and e.k = f.k + 1 join th on th.series_id = f.series_id) select series_id, k, round(yhat, 6) + 0.0 yhat from f")
def ar2_free_run(spark, sf):
    e = series.events(spark, sf)
    return _round(predict.free_run(e, COLS2, TERMS2, None, ar2_models(e)).where("k > 2").select("series_id", "k", "yhat"))


@query("ridge_ar2", f"with {AR2} select series_id, round((e1*(d+10)-f*c)/((a+10)*(d+10)-c*c), 6) t1, round(((a+10)*f-c*e1)/((a+10)*(d+10)-c*c), 6) t2 from g")
def ridge_ar2(spark, sf):
    return _theta2(spark, sf, "ridge", alpha=10.0)


def _theta2(spark: SparkSession, sf: str, estimator: str, **options) -> DataFrame:
    found = estimate.by_series(lagging.regressors(series.events(spark, sf), COLS2, TERMS2), 2, estimator, **options)
    return _round(found.select("series_id", F.col("theta")[0].alias("t1"), F.col("theta")[1].alias("t2")))


def _theta1(spark: SparkSession, sf: str, estimator: str, **options) -> DataFrame:
    found = estimate.by_series(lagging.regressors(series.events(spark, sf), ["y_1"], [("y_1", "y_1")]), 1, estimator, **options)
    return _round(found.select("series_id", F.col("theta")[0].alias("t")))


#: Sums of an AR(1): a of squared lags, b of lag times y, d of y squared, n samples.
_SUMS1 = f"{E}, p as (select series_id, k, y, lag(y) over (partition by series_id order by k) y1 from e), s as (select series_id, sum(y1*y1) a, sum(y1*y) b, sum(y*y) d, count(*) n from p where k > 1 group by series_id)"
_ONE = {
    "total_least_squares_ar1": ("total_least_squares", {}, "(d - a + sqrt((d - a) * (d - a) + 4 * b * b)) / (2 * b)"),
    "affine_lms_ar1": ("affine_lms", {}, "b / a * (1 - power(1 - 0.01 * a / (a + 0.2), n - 1))"),
    "bounded_ar1": ("bounded", {"low": 0.2, "high": 0.9}, "least(0.9, greatest(0.2, b / a))"),
}
for _name, (_estimator, _options, _sql) in _ONE.items():
    QUERIES[_name] = partial(_theta1, estimator=_estimator, **_options)
    ORACLE[_name] = f"with {_SUMS1} select series_id, round({_sql}, 6) + 0.0 t from s"
QUERIES["least_squares_ar2"] = partial(_theta2, estimator="least_squares")
ORACLE["least_squares_ar2"] = f"with {AR2} select series_id, round(t1, 6) + 0.0 t1, round(t2, 6) + 0.0 t2 from th"
QUERIES["minimal_residual_ar2"] = partial(_theta2, estimator="minimal_residual", damp=3.0)
ORACLE["minimal_residual_ar2"] = f"with {AR2} select series_id, round((e1*(d+9)-f*c)/((a+9)*(d+9)-c*c), 6) + 0.0 t1, round(((a+9)*f-c*e1)/((a+9)*(d+9)-c*c), 6) + 0.0 t2 from g"
QUERIES["non_negative_ar2"] = partial(_theta2, estimator="non_negative")
# two lags: both free if that is feasible, else the better of the two alone
ORACLE["non_negative_ar2"] = f"""with {AR2}, c as (select g.*, t1, t2, greatest(0, e1/a) o1, greatest(0, f/d) o2 from g join th using (series_id)),
 h as (select *, 2*e1*o1 - a*o1*o1 as win1, 2*f*o2 - d*o2*o2 as win2 from c)
 select series_id, round(case when t1 >= 0 and t2 >= 0 then t1 when win1 >= win2 then o1 else 0 end, 6) + 0.0 t1, round(case when t1 >= 0 and t2 >= 0 then t2 when win1 >= win2 then 0 else o2 end, 6) + 0.0 t2 from h"""


_FOLDS = {
    "lms": "2 * 0.0001 * (y - t * y1) * y1",
    "sign_error": "0.0001 * sign(y - t * y1) * y1",
    "normalized": "2 * 0.0001 * (y - t * y1) * y1 / (2.220446049250313e-16 + y1 * y1)",
    "normalized_sign_error": "2 * 0.0001 * sign(y - t * y1) * y1 / (2.220446049250313e-16 + y1 * y1)",
    "sign_regressor": "0.0001 * (y - t * y1) * sign(y1)",
    "normalized_sign_regressor": "0.0001 * (y - t * y1) * sign(y1) / (2.220446049250313e-16 + y1 * y1)",
    "sign_sign": "2 * 0.0001 * sign(y - t * y1) * sign(y1)",
    "normalized_sign_sign": "2 * 0.0001 * sign(y - t * y1) * sign(y1) / (2.220446049250313e-16 + y1 * y1)",
    "normalized_leaky": "0.0001 * (y - t * y1) * y1 / (2.220446049250313e-16 + y1 * y1) - t * 0.0001 * 0.2",
    "leaky": "0.0001 * (y - t * y1) * y1 - t * 0.0001 * 0.2",
    "fourth": "1e-12 * y1 * (y - t * y1) * (y - t * y1) * (y - t * y1)",
    "mixed_norm": "1e-12 * y1 * (y - t * y1) * (0.02 + 0.98 * (y - t * y1) * (y - t * y1))",
}
for _name, _sql in _FOLDS.items():
    QUERIES[f"adaptive_{_name}_ar1"] = lambda spark, sf, r=_name: _round(adaptive.lms(lagging.regressors(series.events(spark, sf), ["y_1"], [("y_1", "y_1")]), 1, r, mu=1e-12 if r in ("fourth", "mixed_norm") else 0.0001).select("series_id", F.col("theta")[0].alias("t")))
    ORACLE[f"adaptive_{_name}_ar1"] = f"with recursive {E}, b as (select series_id, k, y, lag(y) over (partition by series_id order by k) y1 from e), f as (select series_id, k, 0.0::double t from e where k = 2 union all select b.series_id, b.k, t + {_sql} from f join b on b.series_id = f.series_id and b.k = f.k + 1), z as (select series_id, max(k) k from f group by 1) select series_id, round(t, 6) + 0.0 t from f join z using (series_id, k)"


@query("rls_ar1", f"with recursive {E}, b as (select series_id, k, y, lag(y) over (partition by series_id order by k) y1 from e), f as (select series_id, k, 0.0::double t, 100.0::double p from e where k = 3 union all select b.series_id, b.k, t + p*y1/(0.98+p*y1*y1)*(y-t*y1), (p - p*y1*p*y1/(0.98+p*y1*y1))/0.98 from f join b on b.series_id = f.series_id and b.k = f.k + 1), z as (select series_id, max(k) k from f group by 1) select series_id, round(t, 6) + 0.0 t from f join z using (series_id, k)")
def rls_ar1(spark, sf):
    psi = lagging.regressors(series.events(spark, sf), ["y_1"], [("y_1", "y_1")])
    return _round(adaptive.rls(psi, 1).select("series_id", F.col("theta")[0].alias("t")))


_METRICS = {
    "mean_forecast_error": "avg(y - yhat)",
    "mean_squared_error": "avg((y - yhat)*(y - yhat))",
    "root_mean_squared_error": "sqrt(avg((y - yhat)*(y - yhat)))",
    "normalized_root_mean_squared_error": "sqrt(avg((y - yhat)*(y - yhat))) / (max(y) - min(y))",
    "root_relative_squared_error": "sqrt(sum((y - yhat)*(y - yhat)) / (count(*) * var_pop(y)))",
    "mean_absolute_error": "avg(abs(y - yhat))",
    "mean_squared_log_error": "avg((ln(y + 1) - ln(yhat + 1)) * (ln(y + 1) - ln(yhat + 1)))",
    "median_absolute_error": "median(abs(y - yhat))",
    "explained_variance_score": "1 - var_pop(y - yhat) / var_pop(y)",
    "r2_score": "1 - sum((y - yhat)*(y - yhat)) / (count(*) * var_pop(y))",
    "symmetric_mean_absolute_percentage_error": "avg(case when abs(y) + abs(yhat) = 0 then 0 else 200 * abs(y - yhat) / (abs(y) + abs(yhat)) end)",
}
for _name, _sql in _METRICS.items():
    QUERIES[f"metric_{_name}"] = lambda spark, sf, f=metrics.METRICS[_name]: _round(ar2(spark, sf).groupBy("series_id").agg(f().alias("value")))
    ORACLE[f"metric_{_name}"] = f"with {AR2} select series_id, round({_sql}, 6) + 0.0 value from r group by series_id"


@query("metric_mean_absolute_scaled_error", f"with {AR2}, s as (select series_id, avg(abs(d)) scale from (select series_id, y - lag(y) over (partition by series_id order by k) d from e) group by 1) select series_id, round(avg(abs(y - yhat)) / max(scale), 6) mase from r join s using (series_id) group by series_id")
def metric_mase(spark, sf):
    return _round(metrics.mean_absolute_scaled_error(series.events(spark, sf), ar2(spark, sf)))


@query("metric_forecast_error", f"with {AR2} select series_id, k, round(y - yhat, 6) + 0.0 e from r")
def metric_forecast_error(spark, sf):
    return _round(residuals.residues(ar2(spark, sf)))


_RES = f"{O}, q as (select k, y - avg(y) over () e, x1 from o)"


def _residual(spark: SparkSession, sf: str) -> DataFrame:
    o = series.orders(spark, sf)
    return residuals.residues(o.withColumn("yhat", F.avg("y").over(Window.partitionBy("series_id"))))


@query("residual_acf", f"with {_RES}, c as (select l.lag, sum(a.e * b.e) c from (select unnest(range(0, 21)) lag) l join q a on true join q b on b.k = a.k + l.lag group by l.lag) select 0::bigint series_id, lag, round(c / (select c from c where lag = 0), 6) + 0.0 acf, round(1.96 / sqrt(2 * (select count(*) from q) - 1), 6) bound from c")
def residual_acf(spark, sf):
    return _round(residuals.autocorrelation(_residual(spark, sf), 20))


@query("residual_ccf", f"with {_RES}, m as (select l.lag, case when lag = 0 then (select avg(x1) from q) else (select avg(x1) from q where k <= lag) end x, (select avg(e) from q where k > lag) z from (select unnest(range(0, 21)) lag) l), c as (select lag, sum((a.x1 - x) * (b.e - z)) c, sum((a.x1 - x) * (a.x1 - x)) u, sum((b.e - z) * (b.e - z)) v from m join q a on true join q b on b.k = a.k + lag group by lag) select 0::bigint series_id, lag, round(c / sqrt(u * v), 5) + 0.0 ccf, round(1.96 / sqrt(2 * (select count(*) from q) - 1), 6) bound from c")
def residual_ccf(spark, sf):
    e = _residual(spark, sf).join(series.orders(spark, sf).select("k", F.col("x1").alias("a")), "k")
    return residuals.cross_correlation(e.select("series_id", "k", "a", F.col("e").alias("b")), 20).select("series_id", "lag", (F.round("ccf", 5) + F.lit(0.0)).alias("ccf"), F.round("bound", 6).alias("bound"))


@query("raw_acf", f"with {_RES}, c as (select b.k - a.k lag, sum(a.e * b.e) c from q a join q b on b.k >= a.k group by 1) select 0::bigint series_id, lag, round(c / (select c from c where lag = 0), 6) + 0.0 acf from c")
def raw_acf(spark, sf):
    """Autocorrelation over all lags."""
    return _round(residuals.autocorrelation(_residual(spark, sf)).drop("bound"))


@query("input_ccf_all_lags", f"""with {_RES}, n as (select count(*) n from q), l as (select lag, case when lag = 0 then (select avg(x1) from q) else (select avg(x1) from q where k <= lag) end x, (select avg(e) from q where k > lag) z from (select unnest(range(0, (select n // 2 from n))) lag)),
 c as (select l.lag, sum((a.x1 - x) * (b.e - z)) c, sum((a.x1 - x) * (a.x1 - x)) u, sum((b.e - z) * (b.e - z)) v from l join q a on a.k <= (select n from n) - l.lag join q b on b.k = a.k + l.lag group by l.lag)
 select 0::bigint series_id, lag, round(c / sqrt(u * v), 5) + 0.0 ccf from c""")
def input_ccf_all_lags(spark, sf):
    """Cross-correlation of the number of orders with the residual, over all lags under half the days."""
    e = _residual(spark, sf).join(series.orders(spark, sf).select("k", F.col("x1").alias("a")), "k")
    return _round(residuals.cross_correlation(e.select("series_id", "k", "a", F.col("e").alias("b"))).drop("bound"), 5)


_CRITERIA = {
    "aic": "n * ln(v) + 2 * m",
    "aicc": "n * ln(v) + 2 * m + 2.0 * m * (m + 1) / (n - m - 1)",
    "bic": "n * ln(v) + m * ln(n)",
    "fpe": "n * ln(v) + n * ln((n + m) / (n - m))",
    "lilc": "n * ln(v) + 2 * m * ln(ln(n))",
    "apress": "(n / (n - m)) * (n / (n - m)) * mse",
}


def _by_order(spark: SparkSession, sf: str, criterion: str) -> DataFrame:
    """Criterion of nested AR models of order 1 and 2 for every series, all from two grouped Gram matrices."""
    e = series.events(spark, sf)
    psi = lagging.regressors(e, COLS2, TERMS2)
    first = estimate.by_series(psi, 1).select("series_id", F.concat("theta", F.array(F.lit(0.0))).alias("theta"), F.lit(1).cast("long").alias("m"))
    models = first.unionByName(ar2_models(e).withColumn("m", F.lit(2).cast("long")))
    err = psi.join(models, "series_id").withColumn("d", F.expr("y - theta[0] * t0 - theta[1] * t1"))
    stats = err.groupBy("series_id", "m").agg(F.count("*").cast("double").alias("n"), F.var_samp("d").alias("v"), F.avg(F.col("d") * F.col("d")).alias("mse"))
    value = select.CRITERIA[criterion](F.col("n"), F.col("mse" if criterion == "apress" else "v"), F.col("m"), F.ln)
    return stats.select("series_id", "m", F.round(value, 4).alias("value"))


for _name, _sql in _CRITERIA.items():
    QUERIES[f"{_name}_by_order"] = partial(_by_order, criterion=_name)
    ORACLE[f"{_name}_by_order"] = f"with {AR2}, h as (select series_id, 1 m, e1 / a t1, 0.0 t2 from g union all select series_id, 2, t1, t2 from th), d as (select p.series_id, m, y - t1*y1 - t2*y2 d from p join h on p.series_id = h.series_id), s as (select series_id, cast(m as bigint) m, cast(count(*) as double) n, var_samp(d) v, avg(d*d) mse from d group by 1, 2) select series_id, m, round({_sql}, 4) \"value\" from s"

_W, _ = robust.kernel(1, 5)


@query("uofr_modulated_bspline", f"with {O}, z as (select k, " + " + ".join(f"({float(a)!r}) * lead(y, {i}) over (order by k)" for i, a in enumerate(_W)) + " y from o) select k, round(y, 6) + 0.0 y from z where y is not null")
def uofr_modulated_bspline(spark, sf):
    return _round(robust.modulate(series.orders(spark, sf), ["y"], _W.tolist()).select("k", "y"))


_LOO = f"""with {O}, z as (select k, y, lag(y) over (order by k) y1, lag(x1) over (order by k) x from o),
 t as (select k, y, unnest([0, 1]) term, unnest([y1, x]) v from z where k > 1),
 s as (select term, sum(v * y) b, sum(v * v) g from t group by 1),
 v as (select k "view", t.term, (s.b - v * y) / (s.g - v * v) theta from t join s on s.term = t.term),
 m as (select "view", v.term, {{}} e from v join t on t.term = v.term and t.k <> "view" group by 1, 2)
 select cast(term as integer) term, round(avg(e), 6) error from m group by term"""
_MEASURES = {
    "mae": "avg(abs(y - theta * v))",
    "mse": "avg((y - theta * v) * (y - theta * v))",
    "phi3": "sum(abs(y - theta * v)) / (sum(abs(y)) + sum(abs(theta * v)))",
    "rmse_ratio": "sqrt(avg((y - theta * v) * (y - theta * v))) / (sqrt(avg(y * y)) + sqrt(avg(theta * v * theta * v)))",
}


def _loo(spark: SparkSession, sf: str, measure: str) -> DataFrame:
    """Overall leave-one-out error of two terms alone, every day left out once."""
    psi = lagging.regressors(series.orders(spark, sf), ["y_1", "x1_1"], [("y_1", "y_1"), ("x1_1", "x1_1")])
    return _round(robust.overall_errors(robust.view_errors(psi, 2, [], measure)))


for _name, _sql in _MEASURES.items():
    QUERIES[f"loo_overall_{_name}"] = partial(_loo, measure=_name)
    ORACLE[f"loo_overall_{_name}"] = _LOO.format(_sql)


@query("ksg_distance_counts", f"""with {O}, d as (select a.k, abs(a.x1 - b.x1) dx, abs(a.y - b.y) dy, greatest(abs(a.x1 - b.x1), abs(a.y - b.y)) r from o a join o b on a.k <> b.k),
 q as (select k, min(r, 2)[2] r from d group by k)
 select 0::bigint series_id, d.k, count(*) filter (dx < q.r) nx, count(*) filter (dy < q.r) ny from d join q using (k) group by d.k""")
def ksg_distance_counts(spark, sf):
    return robust.neighbour_counts(series.orders(spark, sf), ["x1"], neighbours=2)


#: A model with an input whose coefficients are given, run freely from its first outputs.
_GIVEN = ["1", "y_1", "y_2", "x1_1"]
_THETA = [0.05, 0.4, -0.2, 0.03]
_RUN = "0.05 + 0.4 * f.p1 - 0.2 * f.p2 + 0.03 * f.x"


@query("narmax_free_run", f"with recursive {O}, f as (select k + 1 k, y p1, (select y from o where k = 1) p2, x1 x from o where k = 2 union all select f.k + 1, {_RUN}, f.p1, o.x1 from f join o on o.k = f.k) select 0::bigint series_id, f.k, round({_RUN}, 6) + 0.0 yhat from f where k <= (select max(k) from o)")
def narmax_free_run(spark, sf):
    _, run = model.simulate(series.orders(spark, sf), _GIVEN, _THETA)
    return _round(run.where("k > 2").select("series_id", "k", "yhat"))


_HALF = "h as (select max(k) - 90 n from o)"


@query("narmax_forecast", f"with recursive {O}, {_HALF}, f as (select n + 1 k, (select y from o where k = n) p1, (select y from o where k = n - 1) p2, (select x1 from o where k = n) x from h union all select f.k + 1, {_RUN}, f.p1, o.x1 from f join o on o.k = f.k) select 0::bigint series_id, f.k, round({_RUN}, 6) + 0.0 yhat from f where k <= (select n from h) + 60")
def narmax_forecast(spark, sf):
    """The last 90 days are to come: only their inputs are known, and 60 of them are forecast."""
    o = series.orders(spark, sf)
    last = o.agg(F.max("k")).first()[0] - 90
    known = o.where(F.col("k") <= last)
    return _round(model.given(known, _GIVEN, _THETA).forecast(known, 60, o.drop("y")))


_SIM = f"""{O}, z as (select k, y, {_lag_sql(["y_1", "x1_1"])} from o window w as (order by k)), p as (select * from z where k > 1),
 g as (select sum(y_1*y_1) a, sum(y_1*x1_1) c, sum(x1_1*x1_1) d, sum(y_1*y) e, sum(x1_1*y) f, sum(y*y) yy from p),
 th as (select *, (e*d-f*c)/(a*d-c*c) t1, (a*f-c*e)/(a*d-c*c) t2 from g),
 r as (select *, e*e/(a*yy) r1, f*f/(d*yy) r2, (f-c/a*e)*(f-c/a*e)/((d-c*c/a)*yy) s2, (e-c/d*f)*(e-c/d*f)/((a-c*c/d)*yy) s1 from th)"""


@query("simulate_model", f"with {_SIM} select 0 pos, 'x1_1' term, round(t2, 6) theta, round(case when r1 >= r2 then s2 else r2 end, 6) err from r union all select 1, 'y_1', round(t1, 6), round(case when r1 >= r2 then r1 else s1 end, 6) from r")
def simulate_model(spark, sf):
    """Terms in the order they are given, coefficients estimated, with their error reduction ratios."""
    return _round(model.given(series.orders(spark, sf), ["x1_1", "y_1"]).table(spark).drop("expression"))


@query("simulate_one_step", f"with {_SIM} select 0::bigint series_id, k, round(t1 * y_1 + t2 * x1_1, 6) + 0.0 yhat from p, th")
def simulate_one_step(spark, sf):
    _, run = model.simulate(series.orders(spark, sf), ["x1_1", "y_1"], steps_ahead=1)
    return _round(run.where("k > 1").select("series_id", "k", "yhat"))


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with yesterday's value and number."""
    return lagging.regressors(series.orders(spark, sf), ["y_1", "x1_1"], [("y_1", "y_1"), ("x1_1", "x1_1")])


def _coefficients(spark: SparkSession, theta) -> DataFrame:
    return _round(spark.createDataFrame([(i, float(t)) for i, t in enumerate(theta)], "term int, theta double"))


@query("qr_least_squares", f"with {_SIM} select 0 term, round(t1, 6) + 0.0 theta from th union all select 1, round(t2, 6) + 0.0 from th")
def qr_least_squares(spark, sf):
    """Least squares from a tree of R factors."""
    return _coefficients(spark, qr.solve(qr.factor(_days(spark, sf), 2)))


@query("qr_ridge", f"with {_SIM} select 0 term, round((e*(d+50)-f*c)/((a+50)*(d+50)-c*c), 6) + 0.0 theta from g union all select 1, round(((a+50)*f-c*e)/((a+50)*(d+50)-c*c), 6) + 0.0 from g")
def qr_ridge(spark, sf):
    return _coefficients(spark, qr.solve(qr.factor(_days(spark, sf), 2), ridge=50.0))


@query("minimal_residual_krylov", f"with {_SIM} select 0 term, round((e*(d+49)-f*c)/((a+49)*(d+49)-c*c), 6) + 0.0 theta from g union all select 1, round(((a+49)*f-c*e)/((a+49)*(d+49)-c*c), 6) + 0.0 from g")
def minimal_residual_krylov(spark, sf):
    """Damped least squares by bidiagonalisation, a pass a step."""
    return _coefficients(spark, qr.minimal_residual(_days(spark, sf), 2, damp=7.0)[0])


@query("qr_by_series_ar2", f"with {AR2} select series_id, round(t1, 6) + 0.0 t1, round(t2, 6) + 0.0 t2 from th")
def qr_by_series_ar2(spark, sf):
    found = qr.by_series(lagging.regressors(series.events(spark, sf), COLS2, TERMS2), 2)
    return _round(found.select("series_id", F.col("theta")[0].alias("t1"), F.col("theta")[1].alias("t2")))


@query("rls_path_ar1", f"with recursive {E}, b as (select series_id, k, y, lag(y) over (partition by series_id order by k) y1 from e), f as (select series_id, k, 0.0::double t, 100.0::double p from e where k = 3 union all select b.series_id, b.k, t + p*y1/(0.98+p*y1*y1)*(y-t*y1), (p - p*y1*p*y1/(0.98+p*y1*y1))/0.98 from f join b on b.series_id = f.series_id and b.k = f.k + 1) select series_id, k, round(t, 6) + 0.0 t from f where k > 3")
def rls_path_ar1(spark, sf):
    """The coefficient after every sample, each series cut into stretches of 16 samples."""
    psi = lagging.regressors(series.events(spark, sf), ["y_1"], [("y_1", "y_1")])
    return _round(adaptive.rls(psi, 1, path=True, length=16).where("k > 3").select("series_id", "k", F.col("theta")[0].alias("t")))


@query("extended_least_squares", f"""with {O}, p as (select k, y, lag(y) over (order by k) y1 from o), q as (select * from p where k > 1), s as (select sum(y1*y) / sum(y1*y1) t from q),
 r as (select k, y, y1, coalesce(lag(y - t * y1) over (order by k), 0.0) e1 from q, s), g as (select sum(y1*y1) a, sum(y1*e1) c, sum(e1*e1) d, sum(y1*y) e, sum(e1*y) f from r),
 u as (select (e*d-f*c)/(a*d-c*c) t, (a*f-c*e)/(a*d-c*c) v from g),
 r2 as (select k, y, y1, coalesce(lag(y - t * y1 - v * e1) over (order by k), 0.0) e1 from r, u), g2 as (select sum(y1*y1) a, sum(y1*e1) c, sum(e1*e1) d, sum(y1*y) e, sum(e1*y) f from r2)
 select 0 term, round((e*d-f*c)/(a*d-c*c), 6) + 0.0 theta from g2""")
def extended_least_squares(spark, sf):
    """Two rounds of extended least squares with one lag of the residuals."""
    o, terms = series.orders(spark, sf), [("y_1", "y_1")]
    theta = qr.solve(qr.factor(lagging.regressors(o, ["y_1"], terms), 1))
    return _coefficients(spark, estimate.unbiased(o, ["y_1"], terms, theta, elag=1, rounds=2))


@query("nfir_prediction", f"with {O}, z as (select k, y, lag(x1, 1) over (order by k) a, lag(x1, 2) over (order by k) b from o) select 0::bigint series_id, k, round(y, 6) + 0.0 y, round(case when k <= 2 then y else 0.5 * a - 0.25 * b end, 6) + 0.0 yhat from z")
def nfir_prediction(spark, sf):
    m = model.given(series.orders(spark, sf), ["x1_1", "x1_2"], [0.5, -0.25])
    return _round(m.predict(series.orders(spark, sf)))


@query("legendre_free_run", f"with recursive {O01}, f as (select k, (1.5 * y_1 * y_1 - 0.5) * 0.3 + 0.5 * x1_1 yhat from w where k = 2 union all select f.k + 1, (1.5 * f.yhat * f.yhat - 0.5) * 0.3 + 0.5 * w.x1_1 from f join w on w.k = f.k + 1) select 0::bigint series_id, k, round(yhat, 6) + 0.0 yhat from f")
def legendre_free_run(spark, sf):
    """A free run of a basis that is no polynomial of the lags' names: the second Legendre polynomial of the last output."""
    scaled = series.scale(series.orders(spark, sf), ["y", "x1"], "minmax")
    terms = [basis.Legendre(2).terms(["y_1"])[-1], ("x1_1", "x1_1")]
    return _round(predict.free_run(scaled, ["y_1", "x1_1"], terms, [0.3, 0.5]).where("k > 1").select("series_id", "k", "yhat"))


@query("series_vectors", "select vec_id series_id, i k, round(cast(embedding[i] as double), 6) + 0.0 y from (select *, unnest(range(1, len(embedding) + 1)) i from embeddings)")
def series_vectors(spark, sf):
    return _round(series.vectors(spark, sf))


@query("series_scale_train", f"with {E}, s as (select series_id, k, y, k <= floor(count(*) over (partition by series_id) * 0.75) train from e) select series_id, k, round((y - avg(y) filter (train) over w) / nullif(stddev_pop(y) filter (train) over w, 0), 6) + 0.0 y from s window w as (partition by series_id)")
def series_scale_train(spark, sf):
    """Scaled with the statistics of the training part alone."""
    return _round(series.scale(series.split(series.events(spark, sf), 0.25), ["y"], "standard", "part = 'train'").select("series_id", "k", "y"))


for _search in ("frols", "aols", "osf", "oif", "oos"):
    QUERIES[f"{_search}_terms"] = lambda spark, sf, s=_search: _round(model.fit(series.orders(spark, sf), model.Spec(2, (2,), basis=Polynomial(2), search=s, n_terms=4)).table(spark).drop("expression"))


@query("uofr_terms")
def uofr_terms(spark, sf):
    cols = ["y_1", "y_2", "x1_1", "x1_2"]
    terms = Polynomial(2).terms(cols)
    q = robust.ultra_orthogonal(lagging.regressors(series.orders(spark, sf), cols, terms), len(terms), 2)
    order, err = select.forward(q, 4)
    return spark.createDataFrame([(i, terms[t][0], round(e, 6)) for i, (t, e) in enumerate(zip(order, err))], "pos int, term string, err double")


@query("group_forecast", f"with recursive {AR2}, n as (select series_id, max(k) n from e group by 1), f as (select e.series_id, n + 1 k, t1*e.y + t2*d.y yhat, e.y prev, 1 i from n join e on e.series_id = n.series_id and e.k = n join e d on d.series_id = n.series_id and d.k = n - 1 join th on th.series_id = n.series_id union all select f.series_id, f.k + 1, t1*f.yhat + t2*f.prev, f.yhat, i + 1 from f join th using (series_id) where i < 10) select series_id, k, round(yhat, 6) + 0.0 yhat from f")
def group_forecast(spark, sf):
    e = series.events(spark, sf)
    return _round(predict.forecast(e, COLS2, TERMS2, None, 10, ar2_models(e)))


@query("group_frols")
def group_frols(spark, sf):
    return _round(model.fit_by_series(series.events(spark, sf), model.Spec(3, (), "NAR", Polynomial(1), n_terms=2)))


#: For every series, the better of two lags by error reduction ratio, then the other with what is left of it.
ORACLE["group_frols_ar2"] = f"""with {AR2}, q as (select series_id, sum(y*y) yy from p group by 1), h as (select g.*, yy, t1, t2, e1*e1/(a*yy) r1, f*f/(d*yy) r2 from g join q using (series_id) join th using (series_id))
 select series_id, 'y_1' term, case when r1 >= r2 then 0 else 1 end pos, round(t1, 6) theta, round(case when r1 >= r2 then r1 else (e1-c/d*f)*(e1-c/d*f)/((a-c*c/d)*yy) end, 6) err from h
 union all select series_id, 'y_2', case when r1 >= r2 then 1 else 0 end, round(t2, 6), round(case when r1 >= r2 then (f-c/a*e1)*(f-c/a*e1)/((d-c*c/a)*yy) else r2 end, 6) from h"""


@query("group_frols_ar2", ORACLE["group_frols_ar2"])
def group_frols_ar2(spark, sf):
    return _round(model.fit_by_series(series.events(spark, sf), model.Spec(2, (), "NAR", Polynomial(1, False), n_terms=2)))


@query("rmss_terms")
def rmss_terms(spark, sf):
    """Robust forward regression on all days of orders, with coefficients averaged over the views."""
    cols = ["y_1", "y_2", "x1_1"]
    terms = Polynomial(2).terms(cols)
    psi = lagging.regressors(series.orders(spark, sf), cols, terms)
    chosen, errors = robust.robust_forward(psi, len(terms), 3)
    theta = robust.averaged_theta(psi, len(terms), chosen)
    return _round(spark.createDataFrame([(i, terms[c][0], float(e), float(t)) for i, (c, e, t) in enumerate(zip(chosen, errors, theta))], "pos int, term string, error double, theta double"))


@query("er_terms")
def er_terms(spark, sf):
    """Entropic regression of every user's series on three lags."""
    cols = ["y_1", "y_2", "y_3"]
    found = robust.entropic(lagging.regressors(series.events(spark, sf), cols, [basis.product((c,)) for c in cols]), 3)
    return found.select("series_id", F.array(*map(F.lit, cols))[F.col("term")].alias("term"))


@query("metamss_terms")
def metamss_terms(spark, sf):
    """Swarm search over orders: trained on the first three quarters of the days, simulated over the rest."""
    cols = basis.lag_columns([1, 2], [[1, 2]])
    terms = Polynomial(2).terms(cols)
    train, valid = swarm.tail(series.split(series.orders(spark, sf), 0.25), "part", basis.max_lag(cols))
    chosen, theta, _ = swarm.swarm_search(train, valid, cols, terms)
    return _round(spark.createDataFrame([(i, terms[c][0], float(t)) for i, (c, t) in enumerate(zip(chosen, theta))], "pos int, term string, theta double"))


@query("metamss_by_users")
def metamss_by_users(spark, sf):
    """Swarm search of one structure over the series of all users at once."""
    cols = ["y_1", "y_2"]
    terms = Polynomial(2).terms(cols)
    train, valid = swarm.tail(series.split(series.events(spark, sf), 0.25), "part", 2)
    chosen, theta, _ = swarm.swarm_search(train, valid, cols, terms)
    return _round(spark.createDataFrame([(i, terms[c][0], float(t)) for i, (c, t) in enumerate(zip(chosen, theta))], "pos int, term string, theta double"))


@query("neural_one_step")
def neural_one_step(spark, sf):
    """A network over two lags of orders and their number, trained on three quarters of the days; one-step predictions of all days."""
    o = series.orders(spark, sf)
    parts = series.split(o, 0.25)
    last = parts.where("part = 'train'").agg(F.max("k")).first()[0]
    valid = parts.where("part = 'test'").withColumn("k", F.col("k") - last)
    net = neural.train(parts.where("part = 'train'"), basis.lag_columns([1, 2], [[1, 2]]), valid, hidden=(6,), rounds=40)
    return _round(net.predict(o, 1), 3)


@query("ails_weights")
def ails_weights(spark, sf):
    """Daily orders fitted together with a static curve through their monthly means, for a grid of weights."""
    o = series.orders(spark, sf)
    _, terms = basis.product_terms(["1", "y_1", "x1_1", "x1_1*x1_1"])
    static = o.groupBy(F.expr("(k - 1) div 30").alias("month")).agg(F.avg("y").alias("y"), F.avg("x1").alias("x1"))
    weighing = [tuple(r) for r in affine.weights(spark, gain=False).collect()]
    found = affine.affine_least_squares(lagging.regressors(o, ["y_1", "x1_1"], terms), terms, weighing, static)
    return _round(spark.createDataFrame([(float(r["weights"][0]), r["theta"].tolist(), r["errors"].tolist(), r["norm"]) for r in found], "dynamic double, theta array<double>, errors array<double>, norm double"))
