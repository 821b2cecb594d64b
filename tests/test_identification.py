"""Known systems are recovered, and invariants of prediction hold."""

import numpy as np
import pytest

from lagweave.functions import numerics
from lagweave.functions.basis import Legendre, Polynomial
from lagweave.operators import estimate, lagging, predict, select
from lagweave.operators.gram import Gram, gram_of
from lagweave.plans.model import Model, Spec, fit, fit_by_series
from lagweave.sources import series


@pytest.fixture(scope="module")
def siso(spark):
    return series.siso(spark, 300, n_series=2).cache()


def test_siso_terms_and_coefficients(siso):
    m = fit(siso, Spec(2, (2,), n_terms=3))
    assert {n: round(t, 6) for (n, _), t in zip(m.terms, m.theta)} == {"x1_2": 0.9, "y_1": 0.2, "y_1*x1_1": 0.1}
    assert m.equation(1) == "y(k) = " + " ".join(f"{t:+.1f} {n}" for (t, n) in zip(m.theta, ["x1(k-2)", "y(k-1)", "y(k-1) x1(k-1)"]))


@pytest.mark.parametrize("search", ["aols", "osf", "oif", "oos"])
def test_other_searches_find_the_system(siso, search):
    m = fit(siso, Spec(2, (2,), search=search, n_terms=3))
    assert {n for n, _ in m.terms} == {"x1_2", "y_1", "y_1*x1_1"}


def test_miso_recovered(spark):
    m = fit(series.miso(spark, 400), Spec(2, (2, 2), n_terms=4))
    got = {n: round(t, 5) for (n, _), t in zip(m.terms, m.theta)}
    assert got == {"y_1*y_1": 0.4, "y_1*x1_1": 0.1, "x2_1": 0.6, "x1_1*x2_2": -0.3}


def test_n_step_is_a_segmented_free_run(siso):
    m = fit(siso, Spec(2, (2,), n_terms=2))
    got = {(r.series_id, r.k): r.yhat for r in m.predict(siso, 7).collect()}
    data = {}
    for r in siso.orderBy("series_id", "k").collect():
        data.setdefault(r.series_id, []).append((r.y, r.x1))
    for sid, rows in data.items():
        y = [r[0] for r in rows]
        p = list(y)
        for k in range(2, len(y)):
            if (k - 2) % 7 == 0:
                hist = y[:k]
            env = {"y_1": hist[-1], "y_2": hist[-2], "x1_1": rows[k - 1][1], "x1_2": rows[k - 2][1]}
            p[k] = sum(t * np.prod([env[f] for f in n.split("*")]) for (n, _), t in zip(m.terms, m.theta))
            hist = [*hist, p[k]]
        assert np.allclose([got[sid, k + 1] for k in range(len(y))], p)


def test_buckets_change_nothing(siso):
    cols = ["y_1", "y_3", "x1_2"]
    a = lagging.lagged(siso, cols).orderBy("series_id", "k").collect()
    assert a == lagging.lagged(siso, cols, bucket=10).select(lagging.lagged(siso, cols).columns).orderBy("series_id", "k").collect()


def test_by_series_equals_one_by_one(siso):
    spec = Spec(2, (2,), basis=Polynomial(1), n_terms=2)
    both = {(r.series_id, r.term): r.theta for r in fit_by_series(siso, spec).collect()}
    one = fit(siso.where("series_id = 1"), spec)
    assert all(np.isclose(both[1, n], t) for (n, _), t in zip(one.terms, one.theta))


def test_save_and_load(spark, siso, tmp_path):
    m = fit(siso, Spec(2, (2,), n_terms=3))
    m.save(spark, str(tmp_path / "m"))
    assert Model.load(spark, str(tmp_path / "m")).theta == m.theta


def test_estimators_agree_on_clean_data(siso):
    terms = [("y_1", "y_1"), ("x1_2", "x1_2"), ("y_1*x1_1", "y_1 * x1_1")]
    q = gram_of(lagging.regressors(siso, ["y_1", "x1_1", "x1_2"], terms), 3)
    for f in (estimate.least_squares, estimate.ridge, estimate.total_least_squares, estimate.non_negative, estimate.bounded, estimate.minimal_residual):
        assert np.allclose(f(q), [0.2, 0.9, 0.1], atol=1e-4), f.__name__
    assert np.allclose(estimate.bounded(q, 0, 0.15)[2] <= 0.15, True)
    theta = estimate.unbiased(siso, ["y_1", "x1_1", "x1_2"], terms, np.zeros(3), rounds=3)
    assert np.allclose(theta, [0.2, 0.9, 0.1], atol=1e-3)


def test_validation():
    with pytest.raises(ValueError):
        Spec(search="none")
    with pytest.raises(ValueError):
        Spec(n_terms=0)
    with pytest.raises(ValueError):
        Spec(ylag=0).columns  # noqa: B018


def test_numerics():
    assert np.isclose(numerics.digamma(np.array([1.0]))[0], -0.5772156649015329)
    assert np.isclose(numerics.t_tail(2.0, 10), 0.07338803, atol=1e-7)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=30)
    x = numerics.nnls(a.T @ a, a.T @ b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope[x == 0] <= 1e-8).all() and np.allclose(slope[x > 0], 0, atol=1e-8)
    assert np.isclose(predict.max_lag(["y_1", "x1_7"]), 7) and Legendre(3).terms(["y_1"])[-1][0] == "Legendre3(y_1)"


def test_forward_matches_qr():
    rng = np.random.default_rng(1)
    psi = rng.normal(size=(200, 8))
    y = psi @ [0, 3, 0, 0, 1, 0, 0.5, 0] + 0.01 * rng.normal(size=200)
    q = Gram(psi.T @ psi, psi.T @ y, y @ y, psi.sum(0), y.sum(), 200)
    order, err = select.forward(q, 3)
    assert order == [1, 4, 6] and 0.99 < sum(err) <= 1
