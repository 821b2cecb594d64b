"""Searches, simulation and forecasts against plain NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import basis, equations
from lagweave.functions.basis import Legendre, Polynomial
from lagweave.operators import adaptive, affine, estimate, gram, lagging, predict, robust, select, swarm, wide
from lagweave.plans import model
from lagweave.plans.model import Spec
from lagweave.sources import series

COLS = ["y_1", "y_2", "x1_1", "x1_2"]


def known_system(n=1000):
    np.random.seed(42)
    x = np.random.uniform(-1, 1, n)
    y = np.zeros(n)
    for k in range(2, n):
        y[k] = 0.2 * y[k - 1] ** 2 + 0.7 * y[k - 1] * x[k - 1] + 0.6 * x[k - 2] - 0.7 * y[k - 2] * x[k - 2] - 0.5 * y[k - 2]
    return x, y


@pytest.fixture(scope="module")
def known(spark):
    x, y = known_system()
    return spark.createDataFrame([(1, k + 1, float(b), float(a)) for k, (a, b) in enumerate(zip(x, y))], "series_id long, k long, y double, x1 double").cache()


@pytest.fixture(scope="module")
def two(spark):
    """Two short series with their matrices of three terms."""
    rng = np.random.default_rng(5)
    data = {s: rng.normal(size=(n, 4)) for s, n in ((1, 14), (2, 11))}
    for d in data.values():
        d[:, 0] += 2 * d[:, 2] + 0.5 * d[:, 3]
    rows = [(s, k + 1, *map(float, r)) for s, d in data.items() for k, r in enumerate(d)]
    return data, spark.createDataFrame(rows, "series_id long, k long, y double, t0 double, t1 double, t2 double").cache()


@pytest.mark.parametrize("at", [1000, 1])
def test_known_terms_and_criterion(known, monkeypatch, at):
    """The same with the whole Gram matrix and with its columns as needed."""
    monkeypatch.setattr(model, "WIDE", at)
    m = model.fit(known, Spec(2, (2,), basis=Polynomial(2), criterion="bic", n_info_values=5))
    assert [n for n, _ in m.terms] == ["x1_2", "y_2", "y_1*x1_1", "y_2*x1_2", "y_1*y_1"]
    assert np.allclose(m.theta, [0.6, -0.5, 0.7, -0.7, 0.2], atol=1e-6)
    assert np.allclose(m.criterion[:4], [-1764.885, -2320.101, -2976.391, -4461.908], atol=2e-3)
    assert all(a > b for a, b in zip(m.criterion, m.criterion[1:]))


def test_wide_columns_are_those_of_the_gram_matrix(known, monkeypatch):
    terms = [*Polynomial(3).terms(COLS), *Legendre(2, False).terms(COLS), *basis.Fourier(n=1, ensemble=False).terms(COLS), *basis.Bernstein(2, False).terms(COLS)]
    monkeypatch.setattr(wide, "BLOCK", 16)
    monkeypatch.setattr(wide, "CELLS", 5000)
    held, q = wide.Columns(known, COLS, terms), gram.gram(known, COLS, terms)
    held.fetch([0, 7, len(terms) - 1])
    assert all(np.allclose(held.known[i], q.g[i]) for i in held.known) and np.allclose(held.b, q.b) and np.allclose(held.d, np.diag(q.g))
    assert wide.forward(held, 6)[0] == select.forward(q, 6)[0]
    held.close()


def test_simulation_of_a_given_model(known):
    x, y = known_system()
    names = ["y_1", "y_1*x1_1", "x1_2"]
    m, run = model.simulate(known, names, [0.2, 0.1, 0.9])
    want = list(y[:2])
    for k in range(2, len(y)):
        want.append(0.2 * want[k - 1] + 0.1 * want[k - 1] * x[k - 1] + 0.9 * x[k - 2])
    assert np.allclose([r.yhat for r in run.orderBy("k").collect()], want)
    m, run = model.simulate(known, ["x1_2", "x1_1*y_1", "y_2", "x1_2*y_2", "y_1*y_1"])
    assert np.allclose(m.theta, [0.6, 0.7, -0.5, -0.7, 0.2]) and np.allclose(sum(m.err), 1)
    assert np.allclose([r.yhat for r in run.orderBy("k").collect()], y)
    for wrong in (["y_1", "y_1"], ["y_0"], ["y_1*x1_1", "x1_1*y_1"], ["z"]):
        with pytest.raises(ValueError):
            model.given(known, wrong)
    with pytest.raises(ValueError):
        model.given(known, names, [1.0])


def test_index_of_terms():
    terms = Polynomial(2).terms(["y_1", "x1_1"])
    assert basis.index_of(terms, ["x1_1*y_1", "1"]) == [4, 0] and [n for n, _ in basis.output_terms(terms)] == ["y_1", "y_1*y_1", "y_1*x1_1"]
    assert [n for n, _ in basis.input_terms(terms)] == ["x1_1", "y_1*x1_1", "x1_1*x1_1"]
    with pytest.raises(ValueError):
        basis.index_of(terms, ["y_2"])
    assert [n for n, _ in Polynomial(1).terms(basis.lag_columns([1, 2], [[1, 2]]))] == ["1", "y_1", "y_2", "x1_1", "x1_2"]


def test_forecast_with_inputs_continues_the_system(spark, known):
    m = model.given(known, ["x1_2", "y_2", "y_1*x1_1", "y_2*x1_2", "y_1*y_1"], [0.6, -0.5, 0.7, -0.7, 0.2])
    head = known.where("k <= 900")
    got = m.forecast(head, 50, known.drop("y")).orderBy("k").collect()
    _, y = known_system()
    assert [r.k for r in got] == list(range(901, 951)) and np.allclose([r.yhat for r in got], y[900:950])
    assert m.forecast(head, 500, known.where("k <= 910").drop("y")).count() == 10
    for bad in (lambda: m.forecast(head, 5), lambda: m.forecast(head, 0, known), lambda: m.predict(head.drop("x1")), lambda: m.predict(head, True), lambda: m.forecast(head, 5, head.drop("x1"))):
        with pytest.raises(ValueError):
            bad()
    free = m.predict(known.withColumn("y", F.when(F.col("k") <= 2, F.col("y")))).orderBy("k").collect()
    assert np.allclose([r.yhat for r in free], y)


def test_values_must_be_finite(spark, known):
    for bad in ("cast('nan' as double)", "null", "cast('inf' as double)"):
        with pytest.raises(ValueError):
            model.fit(known.withColumn("x1", F.expr(f"if(k = 7, {bad}, x1)")), Spec(2, (2,), n_terms=2))
    short = known.where("k <= 2").unionByName(known.withColumn("series_id", F.lit(2).cast("long")))
    assert {r.series_id for r in model.fit_by_series(short, Spec(2, (2,), n_terms=1)).collect()} == {2}


def test_affine_lms_is_the_sum_of_its_updates(known):
    q = gram.gram(known, COLS, [basis.product((c,)) for c in COLS])
    theta = np.zeros(4)
    inverse = np.linalg.pinv(q.g + 0.2 * np.eye(4))
    for _ in range(q.n - 4):
        theta = theta + 0.01 * inverse @ (q.b - q.g @ theta)
    assert np.allclose(estimate.affine_lms(q), theta)


def test_unbiased_removes_the_bias_of_coloured_noise(spark):
    d = series.siso(spark, 4000, sigma=0.5, colored=True)
    terms = [basis.product(("y_1",)), basis.product(("x1_2",))]
    q = gram.gram(d, ["y_1", "x1_1", "x1_2"], terms)
    plain = estimate.least_squares(q)
    mended = estimate.unbiased(d, ["y_1", "x1_1", "x1_2"], terms, plain, rounds=15)
    assert abs(plain[0] - 0.2) > 0.1 and abs(mended[0] - 0.2) < 0.5 * abs(plain[0] - 0.2)


def test_adaptive_folds_of_several_regressors(known):
    terms = [basis.product((c,)) for c in ("y_2", "x1_2")]
    psi = lagging.regressors(known, ["y_2", "x1_2"], terms)
    rows = [(r.y, np.array([r.t0, r.t1])) for r in psi.orderBy("k").collect()]
    theta = np.zeros(2)
    for y, p in rows[2:]:
        theta = theta + 2 * 0.02 * (y - theta @ p) * p
    assert np.allclose(adaptive.lms(psi, 2, mu=0.02).first()["theta"], theta)
    theta, cov = np.zeros(2), np.eye(2) / 0.01
    path = [theta, theta]
    for y, p in rows[2:]:
        gain = cov @ p / (0.98 + p @ cov @ p)
        theta = theta + gain * (y - theta @ p)
        cov = (cov - np.outer(gain, p @ cov)) / 0.98
        path.append(theta)
    assert np.allclose(adaptive.rls(psi, 2).first()["theta"], theta)
    assert np.allclose([r.theta for r in adaptive.rls(psi, 2, path=True).orderBy("k").collect()], path)
    with pytest.raises(ValueError):
        adaptive.rls(psi, 2, lam=0)


def plain_robust(data, n_terms, measure):
    """Leave-one-out views orthogonalised one by one, errors averaged over views, then series."""

    def error(y, q):
        a = y @ q / (q @ q)
        e = y - a * q
        if measure == "mae":
            return np.abs(e).mean()
        if measure == "mse":
            return (e * e).mean()
        if measure == "phi3":
            return np.abs(e).sum() / (np.abs(y).sum() + np.abs(a * q).sum())
        return math.sqrt((e * e).mean()) / (math.sqrt((y * y).mean()) + math.sqrt(((a * q) ** 2).mean()))

    views = {s: [np.delete(d, i, 0).copy() for i in range(len(d))] for s, d in data.items()}
    left, chosen, found = [0, 1, 2], [], []
    for _ in range(n_terms):
        errors = {j: np.mean([np.mean([error(v[:, 0], v[:, 1 + j]) for v in vs]) for vs in views.values()]) for j in left}
        best = min(left, key=lambda j: (round(errors[j], 12), j))
        chosen.append(best)
        found.append(errors[best])
        left.remove(best)
        for vs in views.values():
            for v in vs:
                q = v[:, 1 + best].copy()
                for j in left:
                    v[:, 1 + j] -= q * (v[:, 1 + j] @ q) / (q @ q)
    return chosen, found


@pytest.mark.parametrize("measure", robust.MEASURES)
def test_robust_search_equals_its_definition(two, measure):
    data, psi = two
    chosen, errors = robust.robust_forward(psi, 3, 3, measure)
    want = plain_robust(data, 3, measure)
    assert chosen == want[0] and np.allclose(errors, want[1])
    assert robust.robust_forward(psi, 3, 3, measure, err_tol=0.0)[0] == want[0][:1]


def test_views_of_series_stay_apart_and_resample(two):
    data, psi = two
    assert robust.view_errors(psi, 3, []).count() == (14 + 11) * 3
    theta = robust.averaged_theta(psi, 3, [1, 2])
    fits = [[np.linalg.lstsq(np.delete(d[:, 2:], i, 0), np.delete(d[:, 0], i), rcond=None)[0] for i in range(len(d))] for d in data.values()]
    assert np.allclose(theta, np.mean([np.mean(f, 0) for f in fits], 0))
    drawn = robust.view_errors(psi, 3, [1], "mse", "bootstrap", subsets=7, size=9, seed=3)
    assert sorted((r.series_id, r.view, r.term) for r in drawn.collect()) == [(s, v, t) for s in (1, 2) for v in range(7) for t in (0, 2)]
    again = robust.view_errors(psi, 3, [1], "mse", "bootstrap", subsets=7, size=9, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    whole = {(r.series_id, r.term): r.error for r in robust.view_errors(psi, 3, [], "mse", None).collect()}
    d = data[2]
    assert np.isclose(whole[2, 0], ((d[:, 0] - d[:, 1] * (d[:, 0] @ d[:, 1]) / (d[:, 1] @ d[:, 1])) ** 2).mean())
    with pytest.raises(ValueError):
        robust.view_errors(psi, 3, [], "smape")


def test_information_and_entropic_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = np.sin(2 * x[:, 0]) + 0.05 * rng.normal(size=120)
    d = spark.createDataFrame([(1, k, float(b), *map(float, a), 1.0) for k, (a, b) in enumerate(zip(x, y))], "series_id long, k long, y double, t0 double, t1 double, t2 double")
    counts = robust.neighbour_counts(d, ["t0"], neighbours=2).orderBy("k").collect()
    from lagweave.functions.numerics import digamma

    want = digamma(np.array([2]))[0] + digamma(np.array([120]))[0] - np.mean([digamma(np.array([r.nx + 1, r.ny + 1])).sum() for r in counts])
    assert np.isclose(robust.mutual_information(x[:, 0], y), want)
    assert robust.mutual_information(x[:, 0], y) > 0.8 > 0.2 > robust.mutual_information(x[:, 1], y)
    assert [r.term for r in robust.entropic(d, 3, n_perm=20, constant=2).collect()] == [0]
    shifted = d.withColumn("y", F.col("y") + 3)
    assert {r.term for r in robust.entropic(shifted, 3, n_perm=20, constant=2).collect()} == {0, 2}


def test_swarm_finds_a_small_optimum():
    target = np.array([1, 0, 1, 1, 0, 0, 1, 0])
    first = swarm.Swarm(8, agents=30, rounds=1, norm=2, seed=1).run(lambda x: (np.abs(x - target).sum(1).astype(float), x))
    found = swarm.Swarm(8, agents=30, rounds=40, norm=2, seed=1).run(lambda x: (np.abs(x - target).sum(1).astype(float), x))
    assert found.best_value <= 1 and found.best_value <= first.best_value
    assert found.history == sorted(found.history, reverse=True) and np.abs(found.best - target).sum() == found.best_value


def test_swarm_search_of_the_known_system(spark, known):
    train, valid = swarm.tail(series.split(known, 0.2), "part", 2)
    terms = Polynomial(2).terms(COLS)
    chosen, theta, found = swarm.swarm_search(train, valid, COLS, terms, agents=10, rounds=12, seed=4)
    got = dict(zip((terms[i][0] for i in chosen), theta))
    assert np.isclose(got["x1_2"], 0.6, atol=0.05) and found.best_value < 0.3
    q = gram.gram(train, COLS, terms[1:])
    fit = estimate.least_squares(q)
    psi = np.array([[r[f"t{i}"] for i in range(14)] for r in lagging.regressors(train, COLS, terms[1:]).collect()])
    y = np.array([r.y for r in lagging.regressors(train, COLS, terms[1:]).collect()])
    noise = y + np.random.default_rng(0).normal(size=len(y))
    q2 = gram.Gram(psi.T @ psi, psi.T @ noise, noise @ noise, psi.sum(0), noise.sum(), len(y))
    fit = estimate.least_squares(q2)
    e = noise - psi @ fit
    t = fit / np.sqrt(np.diag(np.linalg.inv(psi.T @ psi)) * (e @ e) / (len(y) - 14))
    from lagweave.functions.numerics import t_tail

    assert np.allclose(swarm.t_test(q2, fit), [t_tail(abs(v), len(y) - 14) for v in t])
    miss, spread = ((y - noise) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    for loss in ("aic", "bic", "swarm"):
        assert np.isfinite(swarm.LOSSES[loss](miss, spread, len(y), 3, 15))
    assert swarm.LOSSES["swarm"](math.inf, spread, len(y), 3, 15) == 30.0 and swarm.LOSSES["aic"](math.nan, spread, len(y), 3, 15) == math.inf


def test_objectives_at_rest(spark, known):
    names = ["1", "y_1", "y_2", "x1_1", "x1_1*x1_1", "y_1*x1_2", "y_2*x1_2"]
    _, terms = basis.product_terms(names)
    kinds, mapping = affine.clusters(terms)
    assert kinds == [{}, {"y": 1}, {"x1": 1}, {"x1": 2}, {"x1": 1, "y": 1}] and mapping.sum(0).tolist() == [1] * 7 and mapping[1].tolist() == [0, 1, 1, 0, 0, 0, 0]
    rng = np.random.default_rng(1)
    rest = rng.uniform(0, 2, (20, 3))
    rest[3, 1] = 0.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in rest], "gain double, y double, x1 double")
    g, y, x = rest.T
    one = np.ones(20)
    q = np.column_stack([one, y, y, x, x * x, x * y, x * y])
    h = np.column_stack([0 * one, g, g, one, 2 * x, one + g, one + g])
    psi = lagging.regressors(known, ["y_1", "y_2", "x1_1", "x1_2"], terms)
    m = np.array([[r[f"t{i}"] for i in range(7)] for r in psi.collect()])
    target = np.array([r.y for r in psi.collect()])
    grid = [tuple(r) for r in affine.weights(spark, num=6).collect()]
    assert grid and all(np.isclose(sum(w), 1) for w in grid)
    found = affine.affine_least_squares(psi, terms, grid, df, df)
    errors = []
    for w, r in zip(grid, found):
        a = w[0] * m.T @ m + w[1] * q.T @ q + w[2] * h.T @ h
        b = w[0] * m.T @ target + w[1] * q.T @ y + w[2] * h.T @ g
        theta = np.linalg.lstsq(a, b, rcond=None)[0]
        errors.append([((v - p @ theta) ** 2).sum() for v, p in ((target, m), (y, q), (g, h))])
        assert np.allclose(r["theta"], theta, atol=1e-6)
    errors = np.array(errors)
    assert np.allclose([r["errors"] for r in found], errors / errors.max(0))
    norms = np.linalg.norm(errors, axis=1)
    assert np.allclose([r["norm"] for r in found], norms / norms.max())
    half = affine.weights(spark, gain=False, num=3).collect()
    assert len(half) == 3 and all(r.gain == 0 and np.isclose(r.dynamic + r.function, 1) for r in half)


def test_order_of_all_pairs_is_refused_for_long_series(spark, monkeypatch):
    from lagweave.operators import pieces

    d = spark.range(60).selectExpr("1L as series_id", "id as k", "cast(id as double) as y")
    with pytest.raises(ValueError):
        pieces.in_pieces(d, ["y"], lambda *a: iter(()), "i int", most=50)


def test_oscillating_search_leaves_a_greedy_trap():
    """A term like the sum of two others is taken first and keeps one of them out; a swing lets it go."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 400))
    y = a + b
    psi = np.column_stack([rng.normal(size=400), y + 0.5 * rng.normal(size=400), a, b])
    q = gram.Gram(psi.T @ psi, psi.T @ y, y @ y, psi.sum(0), y.sum(), 400)
    floating = select.Floating(q)
    greedy = floating.add(floating.add(()))
    assert greedy != (2, 3) and floating.score(greedy) < 0.99 and floating.oos(2, max_depth=2) == [2, 3]


def test_equations_in_all_styles():
    names = ["1", "y_1*x1_2*x1_2", "cos(2*y_1)", "Legendre2(x1_1)", "odd[y_1]"]
    theta = [0.5, -1.25, 2.0, 3.0, 1.0]
    assert equations.equation(names, theta, 2) == "y(k) = +0.50 -1.25 y(k-1) x1(k-2)^2 +2.00 cos(2 y(k-1)) +3.00 Legendre2(x1(k-1)) +1.00 odd[y(k-1)]"
    assert equations.equation(names[:3], theta[:3], 1, "latex") == r"y_{k} = +0.5 -1.2 \, y_{k-1} x1_{k-2}^{2} +2.0 \, \cos(2 y_{k-1})"
    assert equations.equation(names[1:4], theta[1:4], 1, "ascii") == "y[k] = -1.2*y[k-1]*x1[k-2]^2 +2.0*cos(2*y[k-1]) +3.0*Legendre2(x1[k-1])"
    equations.register("odd", lambda n, style: "ODD" if n.startswith("odd") else None)
    try:
        assert equations.render("odd[y_1]") == "ODD"
    finally:
        del equations.RENDERERS["odd"]
    assert equations.results(["y_1"], [0.5], [0.25], scientific=True) == [("y(k-1)", "5.0000E-01", "2.50000000E-01")]
    with pytest.raises(ValueError):
        equations.equation(names, theta, 2, "html")


def test_zero_denominators_of_metrics(spark):
    from lagweave.functions import metrics

    flat = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 2.0, 2.0), (2, 1, 2.0, 3.0), (2, 2, 2.0, 2.0)], "series_id long, k long, y double, yhat double")
    got = {r.series_id: r for r in flat.groupBy("series_id").agg(*(f().alias(n) for n, f in metrics.METRICS.items())).collect()}
    for name in ("normalized_root_mean_squared_error", "root_relative_squared_error"):
        assert got[1][name] == 0 and got[2][name] == math.inf
    assert got[1].r2_score == 1 and got[2].r2_score == 0 and got[1].explained_variance_score == 1 and got[2].explained_variance_score == 0
    scaled = {r.series_id: r.mase for r in metrics.mean_absolute_scaled_error(flat, flat).collect()}
    assert scaled == {1: 0.0, 2: math.inf}
    with pytest.raises(ValueError):
        metrics.mean_absolute_scaled_error(flat, flat, 0)


def test_logarithmic_error_of_groups_without_a_logarithm(spark):
    """A forecast below -1 in one series leaves the others their error."""
    from lagweave.functions import metrics

    rows = [("a", 1.0, 3.0), ("a", 0.0, 0.0), ("b", 1.0, -1.5), ("b", 0.0, 0.0), ("c", 1.0, -1.0), ("d", -2.0, 1.0), ("e", 1.0, None), ("e", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, y double, yhat double")
    got = {r.series_id: r.v for r in df.groupBy("series_id").agg(metrics.mean_squared_log_error().alias("v")).collect()}
    assert math.isclose(got["a"], math.log(2) ** 2 / 2) and math.isclose(got["e"], math.log(2) ** 2)
    assert math.isnan(got["b"]) and math.isnan(got["d"]) and got["c"] == math.inf


def test_minmax_of_values_that_differ_each_time_they_are_computed(spark):
    """As sums do in their last bits: the scaled values still run from exactly 0 to exactly 1, where Bernstein terms end."""
    jitter = F.udf(lambda v: v + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    d = spark.range(1, 201).select(F.lit(0).alias("series_id"), F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("v"))
    found = series.scale(d.withColumn("y", jitter("v")), ["y"], "minmax")
    r = found.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    assert (r.low, r.high) == (0.0, 1.0)


def test_online_updates_equal_the_batch_fold(spark, tmp_path):
    from lagweave.streaming.online import online_lms

    rng = np.random.default_rng(2)
    rows = [(s, k, float(v)) for s in (1, 2) for k, v in enumerate(rng.normal(size=30), 1)]
    df = spark.createDataFrame(rows, "series_id long, k long, y double")
    for low in (0, 10, 20):
        df.where(f"k > {low} and k <= {low + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = online_lms(stream, 1, 0.05).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = {(r.series_id, r.k): r.theta[0] for r in spark.table("online").collect()}
    for s in (1, 2):
        y, theta = [v for i, _, v in rows if i == s], 0.0
        for k in range(1, 30):
            theta += 2 * 0.05 * (y[k] - theta * y[k - 1]) * y[k - 1]
            assert np.isclose(got[s, k + 1], theta)


def test_free_runs_of_several_series_with_their_own_coefficients(spark):
    rows = [(s, k, float(s + k)) for s in (1, 2) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "series_id long, k long, y double")
    models = spark.createDataFrame([(1, [0.5]), (2, [2.0])], "series_id long, theta array<double>")
    got = {(r.series_id, r.k): r.yhat for r in predict.free_run(df, ["y_1"], [("y_1", "y_1")], None, models).collect()}
    assert got == {**{(1, k): 2.0 * 0.5 ** (k - 1) for k in range(1, 6)}, **{(2, k): 3.0 * 2.0 ** (k - 1) for k in range(1, 6)}}


def test_modulated_copies_equal_their_definition(two):
    data, psi = two
    for kind, options in (("bspline", {}), ("gaussian", {"sigma": 0.7}), ("custom", {"custom": lambda t, order: np.cos(t) ** order})):
        w, area = robust.kernel(1, 5, kind, **options)
        assert np.isclose(np.linalg.norm(w), 1) and (area == 1 or np.isclose(area * w.sum(), 1))
        q = robust.ultra_orthogonal(psi, 3, 1, support=5, kind=kind, **options)
        want = 0
        for d in data.values():
            n = len(d)
            smooth = np.array([w @ d[k : k + 5] for k in range(n - 4)]) * area * math.sqrt(n / (n - 4))
            want = want + d.T @ d + smooth.T @ smooth
        assert np.allclose(q.g, want[1:, 1:]) and np.allclose(q.b, want[1:, 0])
    for bad in (4, 1):
        with pytest.raises(ValueError):
            robust.kernel(1, bad)


def test_packed_sums_by_series_and_coefficients(spark, two):
    data, psi = two
    for r in gram.packed(psi, 3).collect():
        q = gram.unpack(r["values"], 3)
        d = data[r.series_id]
        assert np.allclose(q.g, d[:, 1:].T @ d[:, 1:]) and np.isclose(q.yy, d[:, 0] @ d[:, 0]) and q.n == len(d)
    spec = Spec(2, (), "NAR", Polynomial(1), n_terms=2)
    found = model.fit_by_series(psi.select("series_id", "k", "y"), spec)
    theta = {r.series_id: r.theta for r in model.coefficients(found, spec).collect()}
    for r in found.collect():
        assert theta[r.series_id][[n for n, _ in spec.candidates].index(r.term)] == r.theta
    assert all(sum(t != 0 for t in v) <= 2 for v in theta.values())


def test_order_of_a_robust_search_and_rank(known):
    terms = [basis.product((c,)) for c in COLS]
    psi = lagging.regressors(known, COLS, terms)
    rows = np.array([[r.y, r.t3, r.t1, r.t0, r.t2] for r in psi.collect()])
    y, n, values = rows[:, 0], len(rows), []
    for m in range(1, 5):
        e = y - rows[:, 1 : m + 1] @ np.linalg.lstsq(rows[:, 1 : m + 1], y, rcond=None)[0]
        values.append(n * math.log(e.var(ddof=1)) + m * math.log(n))
    first = next((m for m in range(1, 4) if values[m] > values[m - 1]), 4)
    assert robust.robust_order(psi, [3, 1, 0, 2], "bic") == first
    twice = gram.gram(known, COLS, [terms[0], terms[0]])
    with pytest.warns(UserWarning):
        estimate.check_rank(twice)
