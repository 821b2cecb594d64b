"""Methods that cut one long series into many tasks, against their plain forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.functions.compiled import next_output
from lagweave.functions import residuals
from lagweave.functions.basis import Basis, Polynomial, Vectorised
from lagweave.operators import adaptive, entropy, estimate, loo, near, predict, qr, ranges, robust, scan, select, swarm
from lagweave.operators.gram import Gram


@pytest.fixture(scope="module")
def noise(spark):
    """Two series, of 900 and 70 samples, with an input."""
    rng = np.random.default_rng(0)
    data = {s: rng.normal(size=(n, 2)) for s, n in (("a", 900), ("b", 70))}
    rows = [(s, k + 1, float(y), float(x)) for s, d in data.items() for k, (y, x) in enumerate(d)]
    return data, spark.createDataFrame(rows, "series_id string, k long, y double, x1 double").cache()


def plain_lms(rule, y, p, mu):
    theta, eps = np.zeros(p.shape[1]), 2.220446049250313e-16
    for v, x in zip(y[p.shape[1] :], p[p.shape[1] :]):
        e, n = v - theta @ x, eps + x @ x
        theta = np.array([adaptive.RULES[rule](float(t), float(a), float(e), mu, float(n), 0.2, 0.02) for t, a in zip(theta, x)])
    return theta


@pytest.mark.parametrize("rule", adaptive.AFFINE)
def test_affine_rules_by_stretches(noise, rule):
    data, d = noise
    psi = d.select("series_id", "k", "y", (F.col("x1") * 0.5).alias("t0"), (F.col("x1") * 0.3 + F.col("y") * 0.1).alias("t1"))
    for length in (None, 100):
        for r in adaptive.lms(psi, 2, rule, mu=0.01, length=length).collect():
            y, x = data[r.series_id].T
            assert np.allclose(r.theta, plain_lms(rule, y, np.column_stack([0.5 * x, 0.3 * x + 0.1 * y]), 0.01), rtol=0, atol=1e-9)


def test_rls_by_stretches(noise):
    data, d = noise
    psi = d.select("series_id", "k", "y", F.col("x1").alias("t0"), (F.col("x1") * 0.3 + F.col("y") * 0.1).alias("t1"))
    found = {(r.series_id, r.k): r.theta for r in adaptive.rls(psi, 2, path=True, length=100).collect()}
    ends = {r.series_id: r.theta for r in adaptive.rls(psi, 2, length=100).collect()}
    for s, v in data.items():
        theta, cov = np.zeros(2), np.eye(2) / 0.01
        for k, (y, x) in enumerate(v, 1):
            if k > 2:
                p = np.array([x, 0.3 * x + 0.1 * y])
                gain = cov @ p / (0.98 + p @ cov @ p)
                theta, cov = theta + gain * (y - theta @ p), (cov - np.outer(gain, p @ cov)) / 0.98
            assert np.allclose(found[s, k], theta, rtol=0, atol=1e-9)
        assert np.allclose(ends[s], theta, rtol=0, atol=1e-9)


def test_free_run_by_stretches(noise):
    data, d = noise
    columns = ["y_1", "y_2", "x1_1"]
    terms = [("1", "1D"), ("y_1", "y_1"), ("y_2", "y_2"), ("y_1*x1_1", "y_1 * x1_1"), ("x1_1*x1_1", "x1_1 * x1_1"), ("cos", "cos(x1_1)")]
    theta = [0.1, 0.4, -0.2, 0.1, 0.3, 0.2]
    assert predict.affine_form(columns, [("y_1*y_2", "y_1 * y_2")], ["1D"]) is None
    assert predict.affine_form(columns, [("c", "cos(y_1)")], ["1D"]) is None
    for length in (None, 100):
        found = {(r.series_id, r.k): r.yhat for r in predict.free_run(d, columns, terms, theta, length=length).collect()}
        assert len(found) == 970
        for s, v in data.items():
            h = v[:2, 0].tolist()
            for i in range(2, len(v)):
                x = v[i - 1, 1]
                h.append(0.1 + 0.4 * h[-1] - 0.2 * h[-2] + 0.1 * h[-1] * x + 0.3 * x * x + 0.2 * math.cos(x))
            assert np.allclose([found[s, k + 1] for k in range(len(v))], h, rtol=0, atol=1e-9)


def test_one_long_series_uses_many_tasks(spark):
    d = spark.range(1, 20001).selectExpr("1L as series_id", "id as k", "sin(id) as y", "cos(id) as t0")
    rows, single = scan.placed(d)
    assert not single
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = scan._dealt(rows, ["y"]).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1 and rows.agg(F.max("stretch")).first()[0] == 4
    assert scan.placed(d.where("k < 100"))[1]


def test_divergent_runs_give_no_exception(spark):
    rows = [(s, k, 1.0 if k < 3 else None) for s in ("wild", "calm") for k in range(1, 31)]
    d = spark.createDataFrame(rows, "series_id string, k long, y double")
    models = spark.createDataFrame([("wild", [9.0, 1.0, 1.0]), ("calm", [0.1, 0.0, 0.0])], "series_id string, theta array<double>")
    terms = [("y_1*y_1", "y_1 * y_1"), ("c", "cos(y_1)"), ("q", "1D / (y_1 - y_1)")]
    found = {(r.series_id, r.k): r.yhat for r in predict.free_run(d, ["y_1"], terms[:2], None, models).collect()}
    assert len(found) == 60 and not math.isfinite(found["wild", 30]) and abs(found["calm", 30]) < 1e-6
    assert math.isnan(next_output(terms, ["y_1"])([1.0], (), [1.0, 1.0, 1.0]))
    one = predict.free_run(d, ["y_1"], [("y_1", "y_1")], [1e30]).where("k = 30").first()
    assert not math.isfinite(one.yhat)


@pytest.mark.parametrize("sql", ["(lambda: ().__class__)()", "y_1.real", "__import__('os')", "case when y_1 > 0 then 1 end", "[i for i in (1,)]", "'a'"])
def test_only_arithmetic_becomes_python(sql):
    with pytest.raises(ValueError, match="odd"):
        next_output([("odd", sql)], ["y_1"])


def test_qr_where_the_gram_matrix_fails(spark):
    rng = np.random.default_rng(1)
    u = np.linalg.qr(rng.normal(size=(4000, 4)))[0]
    a = u @ np.diag([1, 1e-3, 1e-6, 1e-9]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0].T * 50
    theta = np.array([1.0, -2, 3, 0.5])
    pdf = pd.DataFrame(a, columns=[f"t{i}" for i in range(4)]).assign(y=a @ theta, series_id=np.arange(4000) % 3, k=np.arange(4000) // 3 + 1)
    d = spark.createDataFrame(pdf).repartition(40).cache()
    assert np.abs(np.linalg.solve(a.T @ a, a.T @ (a @ theta)) - theta).max() > 0.1
    assert np.abs(qr.solve(qr.factor(d, 4)) - theta).max() < 1e-6
    found = qr.by_series(d, 4).collect()
    assert len(found) == 3 and all(np.abs(np.array(r.theta) - theta).max() < 1e-6 for r in found)
    twice = d.withColumn("t1", F.col("t0"))
    want = np.linalg.pinv(np.column_stack([a[:, 0], a[:, 0]])) @ (a @ theta)
    assert np.allclose(qr.solve(qr.factor(twice.select("t0", "t1", "y"), 2)), want)
    assert np.abs(qr.total(qr.factor(d, 4)) - theta).max() < 1e-6
    assert qr.solve(qr.factor(d.where("k < 0"), 4)).tolist() == [0.0] * 4


@pytest.mark.parametrize("damp", [0.0, 3.0])
def test_minimal_residual_needs_no_gram_matrix(spark, damp):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(500, 5)) @ np.diag([1, 10, 100, 0.01, 2])
    y = a @ np.arange(5.0) + rng.normal(size=500)
    d = spark.createDataFrame(pd.DataFrame(a, columns=[f"t{i}" for i in range(5)]).assign(y=y)).cache()
    theta, passes = qr.minimal_residual(d, 5, damp)
    want = np.linalg.lstsq(np.vstack([a, damp * np.eye(5)]), np.r_[y, np.zeros(5)], rcond=None)[0]
    assert passes <= 6 and np.abs(theta - want).max() < 1e-9 * np.abs(want).max()
    short, _ = qr.minimal_residual(d, 5, damp, steps=2)
    full = lambda t: np.linalg.norm(a.T @ (y - a @ t) - damp * damp * t)
    assert full(short) < full(np.zeros(5))
    assert qr.minimal_residual(d.withColumn("y", F.lit(0.0)), 5)[0].tolist() == [0.0] * 5


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.normal(size=500)))]
    d = spark.createDataFrame(rows, "g int, i int, v double")
    for few in (100_000, 0):
        ranges.FEW, kept = few, ranges.FEW
        try:
            found = {r.i: (r.s, r.n) for r in ranges.running(d, ["g"], ["v", "i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
        finally:
            ranges.FEW = kept
        for g in range(3):
            total = 0.0
            for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
                total += v
                assert found[i][1] == n and abs(found[i][0] - total) < 1e-9


@pytest.mark.parametrize("measure", robust.MEASURES)
def test_left_out_views_equal_the_views_themselves(spark, monkeypatch, measure):
    """Ties, zeros and a sample of full leverage included; stretches of a few samples."""
    rng = np.random.default_rng(4)
    data = {s: np.round(rng.normal(size=(n, 4)), 1) for s, n in ((1, 60), (2, 9))}
    data[1][:, 3] = 0.0
    data[1][7, 3] = 2.0
    rows = [(s, k + 1, *map(float, r)) for s, d in data.items() for k, r in enumerate(d)]
    psi = spark.createDataFrame(rows, "series_id long, k long, y double, t0 double, t1 double, t2 double").cache()
    monkeypatch.setattr(loo, "STRETCH", 16)
    for chosen in ([], [2]):
        found = {(r.series_id, r.view, r.term): r.error for r in robust.view_errors(psi, 3, chosen, measure).collect()}
        for s, d in data.items():
            for i in range(len(d)):
                v = np.delete(d, i, 0)
                for j in {0, 1, 2} - set(chosen):
                    q = v[:, 1 + j]
                    if chosen:
                        c = v[:, 3:4]
                        q = q - c @ (np.linalg.pinv(c) @ q)
                    fit = q * (v[:, 0] @ q) / max(q @ q, 1e-12)
                    e, y = v[:, 0] - fit, v[:, 0]
                    want = {"mae": np.abs(e).mean(), "mse": (e * e).mean(), "phi3": np.abs(e).sum() / (np.abs(y).sum() + np.abs(fit).sum()), "rmse_ratio": math.sqrt((e * e).mean()) / (math.sqrt((y * y).mean()) + math.sqrt((fit * fit).mean()))}[measure]
                    assert found[s, i + 1, j] == pytest.approx(want, abs=1e-9), (s, i, j)


def test_left_out_coefficients(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(size=(40, 3))
    d[:, 2] = 0.0
    d[5, 2] = 3.0
    psi = spark.createDataFrame([(1, k + 1, *map(float, r)) for k, r in enumerate(d)], "series_id long, k long, y double, t0 double, t1 double")
    found = [r.v for r in loo.coefficients(psi, 2, length=16).orderBy("i").collect()]
    want = np.mean([np.linalg.pinv(np.delete(d[:, 1:], i, 0)) @ np.delete(d[:, 0], i) for i in range(40)], 0)
    assert np.allclose(found, want)


def all_pairs(x, y, k):
    dx, dy = (np.abs(v[:, None] - v[None]).max(-1) for v in (x, y))
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    r = np.partition(both, k - 1, axis=1)[:, k - 1 : k]
    return np.maximum((dx < r).sum(1) - 1, 0), np.maximum((dy < r).sum(1) - 1, 0)


@pytest.mark.parametrize("columns,y", [(["u"], ["y"]), (["u", "v"], ["y"])])
def test_neighbours_in_cells_equal_all_pairs(spark, columns, y):
    """Many ties, a series of one cell, and one whose samples all come ten times."""
    rng = np.random.default_rng(0)
    data = {"a": np.round(rng.normal(size=(500, 3)), 2), "b": rng.normal(size=(40, 3)), "c": np.repeat(rng.normal(size=(20, 3)), 10, 0)}
    rows = [(s, k + 1, *map(float, r)) for s, d in data.items() for k, r in enumerate(d)]
    d = spark.createDataFrame(rows, "series_id string, k long, y double, u double, v double").cache()
    found = {(r.series_id, r.k): (r.nx, r.ny) for r in near.neighbour_counts(d, columns, y, 2, size=32).collect()}
    at = {"y": 0, "u": 1, "v": 2}
    for s, m in data.items():
        nx, ny = all_pairs(m[:, [at[c] for c in columns]], m[:, [at[c] for c in y]], 2)
        assert [found[s, k + 1] for k in range(len(m))] == list(zip(nx, ny))
    if columns == ["u"]:
        for r in near.information(d, columns, y, size=32).collect():
            m = data[r.series_id]
            assert np.isclose(r.value, robust.mutual_information(m[:, 1], m[:, 0]))
        for r in near.conditional_information(d, columns, y, ["v"], size=32).collect():
            m = data[r.series_id]
            assert np.isclose(r.value, robust.conditional_information(m[:, 1], m[:, 0], m[:, 2]))


def test_fewer_samples_than_neighbours(spark):
    d = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 1.0, 1.0)], "series_id string, k long, y double, u double")
    assert [r.r for r in near.radius(d, ["u", "y"], 2).collect()] == [math.inf, math.inf]
    assert [r.r for r in near.radius(d, ["u", "y"], 1).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("length,lags", [(1024, None), (None, 20), (1024, 1500)])
def test_lagged_products_of_stretches(spark, length, lags):
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(size=(3000, 2)), "b": rng.normal(size=(5, 2))}
    rows = [(s, k + 1, float(x), float(y)) for s, d in data.items() for k, (x, y) in enumerate(d)]
    d = spark.createDataFrame(rows, "series_id string, k long, a double, b double")
    found = {(r.series_id, r.lag): r.c for r in residuals.lagged_products(d, lags, length).collect()}
    assert len(found) == sum(min(len(v), (lags or 3000) + 1) for v in data.values())
    for s, v in data.items():
        want = np.correlate(v[:, 1], v[:, 0], "full")[len(v) - 1 :]
        assert all(abs(found[s, t] - want[t]) < 1e-8 for t in range(min(len(v), (lags or 3000) + 1)))


class Plain:
    """Floating searches with every set scored by a least-squares fit of its own."""

    def __init__(self, x, y):
        self.x, self.y, self.m = x, y, x.shape[1]

    def score(self, terms):
        fit = self.x[:, list(terms)] @ np.linalg.lstsq(self.x[:, list(terms)], self.y, rcond=None)[0] if terms else 0 * self.y
        return float(1 - ((self.y - fit) ** 2).sum() / (self.y @ self.y))

    def strongest(self, terms, pool):
        return max(sorted(pool), key=lambda j: round(self.score((*terms, j)), 11))

    def weakest(self, terms):
        return max(sorted(terms), key=lambda j: round(self.score([t for t in terms if t != j]), 11))

    def grow(self, base, count):
        best, kept, terms, pool = {0: self.score(base)}, {0: []}, [], set(range(self.m)) - set(base)
        while len(terms) < count and pool:
            new = self.strongest([*base, *terms], pool)
            size, score = len(terms) + 1, self.score([*base, *terms, new])
            if score > best.get(size, -1) + 1e-9:
                best[size], kept[size] = score, [*terms, new]
            terms, just = list(kept[size]), new
            pool -= set(terms)
            while terms and len(base) + len(terms) > 2:
                weak = self.weakest([*base, *terms])
                less = [t for t in terms if t != weak]
                if weak in base or weak == just or self.score([*base, *less]) <= best.get(len(less), -1) + 1e-9:
                    break
                terms, just = less, None
                best[len(less)], kept[len(less)] = self.score([*base, *less]), less
        return terms

    def shrink(self, terms, count):
        best, kept, left = {len(terms): self.score(terms)}, {len(terms): list(terms)}, list(terms)
        while len(terms) - len(left) < count:
            weak = self.weakest(left)
            less = [t for t in left if t != weak]
            if self.score(less) > best.get(len(less), -1) + 1e-9:
                best[len(less)], kept[len(less)] = self.score(less), less
            left, just = list(kept[len(less)]), weak
            while len(terms) - len(left) > 1:
                back = self.strongest(left, [t for t in terms if t not in left])
                if back == just or self.score([*left, back]) <= best.get(len(left) + 1, -1) + 1e-9:
                    break
                left, just = [*left, back], None
                best[len(left)], kept[len(left)] = self.score(left), list(left)
        return left

    def oos(self, k, limit):
        now, depth = [], 1
        while len(now) < k:
            now.append(self.strongest(now, set(range(self.m)) - set(now)))
        while depth <= limit:
            gained = False
            for up in (False, True):
                if up:
                    more = self.grow(now, depth)
                    after = self.shrink([*now, *more], depth) if len(more) == depth else now
                else:
                    left = self.shrink(now, depth)
                    more = self.grow(left, depth)
                    after = [*left, *more] if len(more) == depth else now
                if self.score(after) > self.score(now) + 1e-9:
                    now, gained = after, True
            depth = 1 if gained else depth + 1
        return sorted(now)


@pytest.mark.parametrize("seed", range(12))
def test_oscillating_search_equals_its_plain_form(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 14)) @ rng.normal(size=(14, 14))
    y = x[:, :6] @ rng.normal(size=6) + rng.normal(size=60)
    q = Gram(x.T @ x, x.T @ y, float(y @ y), x.sum(0), float(y.sum()), 60)
    search = select.Floating(q)
    plain = Plain(x, y)
    for depth in (1, 3, 4):
        found = search.oos(6, depth)
        assert found == plain.oos(6, depth)
    assert search.osf(6) == sorted(plain_osf(plain, 6))
    assert len(search.oif(6)) == 6
    greedy = select.forward(q, 6)[0]
    assert search.score(found) >= search.score(greedy) - 1e-9


def plain_osf(plain, k):
    best, kept, terms = {0: 0.0}, {0: []}, []
    while len(terms) < k:
        new = plain.strongest(terms, set(range(plain.m)) - set(terms))
        size, score = len(terms) + 1, plain.score([*terms, new])
        if score > best.get(size, -1) + 1e-9:
            best[size], kept[size] = score, [*terms, new]
        terms, just = list(kept[size]), new
        while len(terms) > 2:
            weak = plain.weakest(terms)
            less = [t for t in terms if t != weak]
            if weak == just or plain.score(less) <= best.get(len(less), -1) + 1e-9:
                break
            terms, just = less, None
            best[len(less)], kept[len(less)] = plain.score(less), less
    return terms


def test_accelerated_search_by_columns():
    """Terms by their projected contribution, each recomputed from the residual of a fit."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 12)) @ rng.normal(size=(12, 12))
    y = x[:, [2, 5, 9]] @ np.array([1.0, -2, 0.5]) + 0.3 * rng.normal(size=80)
    q = Gram(x.T @ x, x.T @ y, float(y @ y), x.sum(0), float(y.sum()), 80)
    for width in (1, 2):
        chosen: list[int] = []
        for _ in range(4):
            basis = np.linalg.qr(x[:, chosen])[0] if chosen else np.zeros((80, 0))
            left, rest = x - basis @ (basis.T @ x), y - basis @ (basis.T @ y)
            gain = [0 if j in chosen else (left[:, j] @ rest) ** 2 / (left[:, j] @ left[:, j]) for j in range(12)]
            chosen += np.argsort(gain)[::-1][:width].tolist()
        theta = np.linalg.lstsq(x[:, chosen], y, rcond=None)[0]
        chosen = [chosen[i] for i in np.argsort(-np.abs(theta))[:4]]
        found, fitted = select.accelerated(q, 4, width)
        assert found == sorted(chosen) and np.allclose(fitted, np.linalg.lstsq(x[:, found], y, rcond=None)[0])


@pytest.mark.parametrize("degree,bias", [(1, False), (2, True)])
def test_extended_least_squares_equals_its_definition(spark, degree, bias):
    """Residuals of the extended model, their lags through the basis, least norm where the basis repeats the constant."""
    rng = np.random.default_rng(8)
    nu = 0.3 * rng.normal(size=400)
    x, y = rng.uniform(-1, 1, 400), np.zeros(400)
    for k in range(2, 400):
        y[k] = 0.2 * y[k - 1] + 0.9 * x[k - 2] + nu[k] + 0.8 * nu[k - 1]
    d = spark.createDataFrame([(1, k + 1, float(b), float(a)) for k, (a, b) in enumerate(zip(x, y))], "series_id long, k long, y double, x1 double")
    columns = ["y_1", "x1_2"]
    terms = Polynomial(1, bias).terms(columns)
    basis = Polynomial(degree, bias)
    psi = np.column_stack([*([np.ones(398)] if bias else []), y[1:-1], x[:-2]])
    target = y[2:]
    e = target - psi @ np.linalg.lstsq(psi, target, rcond=None)[0]
    for _ in range(20):
        lag = np.column_stack([np.r_[np.zeros(j), e[:-j]] for j in (1, 2)])
        wide = [lag] if degree == 1 else [lag, lag[:, :1] ** 2, lag[:, :1] * lag[:, 1:], lag[:, 1:] ** 2]
        full = np.column_stack([psi, *([np.ones(398)] if bias else []), *wide])
        theta = np.linalg.lstsq(full, target, rcond=None)[0]
        e = target - full @ theta
    start = np.linalg.lstsq(psi, target, rcond=None)[0]
    found = estimate.unbiased(d, columns, terms, start, elag=2, basis=basis)
    assert np.abs(found - theta[: len(terms)]).max() < 1e-8
    if degree == 1:
        from lagweave.plans.model import Spec, fit

        held = fit(d, Spec([1], ([2],), basis=basis, search="all", elag=2, solver="qr"))
        assert np.abs(np.array(held.theta) - theta[: len(terms)]).max() < 1e-8


def test_agents_run_along_every_series(spark):
    """Sums of squares over three series, one of them too short to run, equal runs one by one."""
    rng = np.random.default_rng(9)
    data = {s: rng.normal(size=(n, 2)) for s, n in (("a", 30), ("b", 17), ("c", 2))}
    rows = [(s, k + 1, float(y), float(x)) for s, d in data.items() for k, (y, x) in enumerate(d)]
    d = spark.createDataFrame(rows, "series_id string, k long, y double, x1 double")
    columns, terms = ["y_1", "y_2", "x1_1"], [("1", "1D"), ("y_1*y_2", "y_1 * y_2"), ("x1_1", "x1_1"), ("cos", "cos(y_1)")]
    theta = rng.normal(size=(5, 4)) * 0.3
    theta[4] = 50.0
    from lagweave.operators.lagging import lagged

    held = lagged(d, ["x1_1"]).select("series_id", "k", "y", "x1_1").repartition("series_id").sortWithinPartitions("series_id", "k")
    found = swarm.simulated(held, columns, terms, theta)
    for a in range(5):
        miss = 0.0
        for v in data.values():
            h = v[:2, 0].tolist()
            for i in range(2, len(v)):
                t = theta[a]
                h.append(t[0] + t[1] * h[-1] * h[-2] + t[2] * v[i - 1, 1] + t[3] * math.cos(h[-1]) if math.isfinite(h[-1]) else math.nan)
                miss += (v[i, 0] - h[-1]) ** 2 if abs(h[-1]) < 1e150 else math.nan
        assert math.isclose(found[a], miss) if math.isfinite(miss) else not math.isfinite(found[a])
    train = d.where("series_id <> 'c'")
    chosen, _, held = swarm.swarm_search(train, d, columns, terms, agents=4, rounds=3, p_value=1.0)
    assert chosen and math.isfinite(held.best_value)
    with pytest.raises(ValueError):
        swarm.swarm_search(train, d.where("series_id = 'c'"), columns, terms, agents=4, rounds=2)


def test_entropic_search_as_tasks(spark):
    """The same search one by one, with the same permutations; long enough for several pieces and both waves."""
    rng = np.random.default_rng(2)
    series = {}
    for s, n in (("a", 70), ("b", 45)):
        t = rng.normal(size=(n, 3))
        y = np.sin(2 * t[:, 0]) + (t[:, 2] if s == "b" else 0) + 0.1 * rng.normal(size=n)
        series[s] = np.column_stack([y, t])
    rows = [(s, k + 1, *map(float, r)) for s, d in series.items() for k, r in enumerate(d)]
    d = spark.createDataFrame(rows, "series_id string, k long, y double, t0 double, t1 double, t2 double")
    kept = entropy.PIECE
    entropy.PIECE = 16
    try:
        found = sorted(map(tuple, robust.entropic(d, 3, n_perm=40, quantile=0.95).collect()))
    finally:
        entropy.PIECE = kept

    def search(y, t):
        chosen, free = [], [0, 1, 2]
        fit = lambda idx: t[:, idx] @ np.linalg.lstsq(t[:, idx], y, rcond=None)[0]

        def limit(x, z):
            return np.quantile([robust.conditional_information(np.random.default_rng([0, i]).permutation(x), y, z) for i in range(40)], 0.95)

        while len(chosen) < 3:
            z = fit(chosen) if chosen else None
            gain = {j: robust.conditional_information(fit([*chosen, j]), y, z) for j in free if j not in chosen}
            best = max(gain, key=lambda j: (gain[j], -j))
            if gain[best] <= limit(fit([*chosen, best]), z):
                break
            chosen.append(best)
        while len(chosen) > 1:
            loss = {j: robust.conditional_information(fit(chosen), y, fit([i for i in chosen if i != j])) for j in chosen}
            worst = min(loss, key=lambda j: (loss[j], j))
            if loss[worst] > limit(fit(chosen), fit([i for i in chosen if i != worst])):
                break
            chosen.remove(worst)
        return chosen

    assert found == sorted((s, j) for s, v in series.items() for j in search(v[:, 0], v[:, 1:])) and found
    with pytest.raises(ValueError):
        entropy.entropic(d, 3, robust.conditional_information, most=50)


def test_python_basis_equals_the_same_in_sql(spark, noise, tmp_path):
    from lagweave.plans import model

    # what this module defines is not there for the workers to import, what is made here travels whole
    class Waves(Basis):
        def terms(self, columns):
            a, b = columns
            return [("1", "1D"), ("s", f"sin({a})"), ("p", f"{a} * {b}"), ("c", f"cos({b})")]

    waves = lambda lags: np.column_stack([np.sin(lags[:, 0]), lags[:, 0] * lags[:, 1], np.cos(lags[:, 1])])
    _, d = noise
    made = Vectorised(function=waves, names=("s", "p", "c"))
    specs = [model.Spec(1, (1,), basis=b, search="frols", n_terms=3) for b in (made, Waves())]
    one, two = (model.fit(d, s) for s in specs)
    assert [n for n, _ in one.terms] == [n for n, _ in two.terms] and np.allclose(one.theta, two.theta)
    for steps in (1, 4, None):
        a, b = ({(r.series_id, r.k): r.yhat for r in m.predict(d, steps).collect()} for m in (one, two))
        assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)
    future = d.withColumn("k", F.col("k") + 900)
    a, b = ({(r.series_id, r.k): r.yhat for r in m.forecast(d, 5, future).collect()} for m in (one, two))
    assert a.keys() == b.keys() and a and all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)
    one.save(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="basis"):
        model.Model.load(spark, str(tmp_path / "m"))
    again = model.Model.load(spark, str(tmp_path / "m"), made)
    assert again.predict(d, 1).orderBy("series_id", "k").collect() == one.predict(d, 1).orderBy("series_id", "k").collect()
    per = [{(r.series_id, r.term): r.theta for r in model.fit_by_series(d, s).collect()} for s in specs]
    assert per[0].keys() == per[1].keys() and all(math.isclose(per[0][i], per[1][i], abs_tol=1e-9) for i in per[0])
    with pytest.raises(Exception, match="gave"):
        model.fit(d, model.Spec(1, (1,), basis=Vectorised(function=waves, names=("s", "p"))))
    with pytest.raises(ValueError):
        Vectorised(function=waves, names=("s", "s", "c")).terms(["y_1", "x1_1"])


def test_agents_take_the_next_samples_of_all_series_together(spark):
    """Rows may come by their place in the series first; a group of rows holds a series once at most and keeps its order."""
    rng = np.random.default_rng(4)
    rows = [(None if s == 40 else s, k, float(rng.normal()), k) for s in range(41) for k in range(1, 4 + s % 7)]
    d = spark.createDataFrame(rows, "series_id long, k long, y double, row long").repartition(3, "series_id").persist()
    columns, terms, theta = ["y_1", "y_2"], [("y_1", "y_1"), ("y_1*y_2", "y_1 * y_2")], rng.normal(size=(6, 2)) * 0.4
    by_series = swarm.simulated(d.sortWithinPartitions("series_id", "k"), columns, terms, theta)
    assert np.allclose(swarm.simulated(d.sortWithinPartitions("row", "series_id"), columns, terms, theta), by_series)
    turns = list(swarm._turns(np.array([7, 7, 3, 7, 3, 9])))
    assert [t.tolist() for t in turns] == [[0, 2, 5], [1, 4], [3]] and not list(swarm._turns(np.zeros(0, np.int64)))


@pytest.mark.parametrize("n", [3, 67, 300, 900])
def test_information_equals_all_pairs_without_comparing_them(n):
    """The estimate from near points equals that from all pairs, repeated values and constants included; a long series takes a small part of the pairs."""
    import time

    from lagweave.functions.numerics import digamma

    def plain(x, y, k):
        dx, dy = (np.abs(v[:, None] - v[None]).max(-1) for v in (x, y))
        r = np.sort(np.maximum(dx, dy), axis=1)[:, k]
        nx, ny = (np.maximum((d < r[:, None]).sum(1) - 1, 0) for d in (dx, dy))
        return float(digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - (digamma(nx + 1) + digamma(ny + 1)).mean())

    rng = np.random.default_rng(n)
    for width in (1, 2):
        x, y = rng.normal(size=(n, 1)), rng.normal(size=(n, width))
        for a, b in ((x, y), (np.round(x, 1), np.round(y, 1)), (np.repeat(x, 6, 0)[:n], np.repeat(y, 6, 0)[:n]), (np.zeros_like(x), y)):
            for k in (1, 2):
                assert np.isclose(robust.mutual_information(a, b, k), plain(a, b, k), rtol=1e-12, atol=1e-12)
    with pytest.raises(ValueError):
        robust.mutual_information(x, y, n)
    if n == 900:
        z = rng.normal(size=20_000)
        start = time.process_time()
        robust.mutual_information(rng.permutation(z), z)
        assert time.process_time() - start < 3
