"""The data-parallel network."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import neural
from lagweave.plans import model
from lagweave.functions.basis import Polynomial
from lagweave.sources import series

COLS = ["y_1", "y_2", "x1_1", "x1_2"]


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(42)
    x, y = rng.uniform(-1, 1, 800), np.zeros(800)
    for k in range(2, 800):
        y[k] = 0.2 * y[k - 1] ** 2 + 0.7 * y[k - 1] * x[k - 1] + 0.6 * x[k - 2] - 0.7 * y[k - 2] * x[k - 2] - 0.5 * y[k - 2]
    return spark.createDataFrame([(1, k + 1, float(b), float(a)) for k, (a, b) in enumerate(zip(x, y))], "series_id long, k long, y double, x1 double").cache()


@pytest.mark.parametrize("activation", neural.ACTIVATIONS)
def test_gradient_equals_finite_differences(activation):
    rng = np.random.default_rng(0)
    net = neural.Network((3, 5, 4, 1), activation, rng.normal(size=3), 1 + rng.random(3), 0.3, 1.7)
    w, lags, y = net.start(1) + 0.1 * rng.normal(size=net.size), rng.normal(size=(20, 3)), rng.normal(size=20)
    g, value = net.gradient(w, lags, y)
    assert math.isclose(value, (((net.outputs(w, lags) - y) / 1.7) ** 2).sum())
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.gradient(w + step, lags, y)[1] - net.gradient(w - step, lags, y)[1]) / 2e-6
        assert math.isclose(g[i], slope, rel_tol=1e-4, abs_tol=1e-5)


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(500, 3))], "y double, y_1 double, x1_1 double")
    net = neural.Network((2, 6, 1), "tanh", np.zeros(2), np.ones(2))
    w = net.start(0)
    one, four = (neural.summed(rows.repartition(n), ["y_1", "x1_1"], net, w, True) for n in (1, 4))
    assert np.allclose(one[0], four[0], rtol=0, atol=1e-9) and math.isclose(one[1], four[1]) and one[2] == four[2] == 500


def test_held_out_error_is_below_the_linear_models(spark, known):
    parts = series.split(known, 0.25)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'").withColumn("k", F.col("k") - 600)
    net = neural.train(train, COLS, test, hidden=(8,), rounds=60, rate=0.05)
    linear = model.fit(train, model.Spec(2, (2,), basis=Polynomial(1), search="all"))
    error = lambda m: m.predict(test, 1).where("k > 2").agg(F.avg((F.col("y") - F.col("yhat")) ** 2)).first()[0]
    assert error(net) < 0.5 * error(linear)
    held = [h for _, h in net.history]
    assert math.isclose(error(net), min(held) * net.network.y_width**2, rel_tol=1e-6)
    run = {r.k: r.yhat for r in net.predict(test).collect()}
    rows = sorted(test.select("k", "y", "x1").collect())
    h = [rows[0].y, rows[1].y]
    for i in range(2, 40):
        h.append(float(net.network.outputs(net.weights, np.array([[h[-1], h[-2], rows[i - 1].x1, rows[i - 2].x1]]))[0]))
    assert np.allclose([run[k] for k in range(1, 41)], h)


def test_early_end_and_bad_input(spark, known):
    flat = known.withColumn("y", F.lit(2.0))
    net = neural.train(flat, ["y_1", "x1_1"], hidden=(2,), rounds=30, patience=3, rate=1e-9)
    assert len(net.history) <= 30 and net.predict(flat, 1).count() == 800
    for wrong in ({"activation": "sine"}, {"hidden": (0,)}, {"rounds": 0}):
        with pytest.raises(ValueError):
            neural.train(known, ["y_1"], **wrong)
    with pytest.raises(ValueError):
        neural.train(known.where("k < 1"), ["y_1"])
    with pytest.raises(ValueError):
        neural.train(known.withColumn("y", F.lit(float("nan"))), ["y_1"])
