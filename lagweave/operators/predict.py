"""Prediction: one step (a projection), n steps (a fold in SQL for each block), free run and forecast (ordered folds).

Blocks restart from measured values and are parallel.  A free run or forecast carries the last max_lag outputs
along its series: where every term holds one output lag at most, the run is affine in them and a scan over stretches, so
that one long series uses many tasks; other models are folds, parallel over series.  Values that overflow are infinite or NaN.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Computed, Term, factors, max_lag
from ..functions.compiled import next_output
from . import scan
from .fold import ordered
from .lagging import expanded, lagged


def one_step(series: DataFrame, columns: list[str], terms: list[Term], theta: list[float], bucket: int | None = None) -> DataFrame:
    """(series_id, k, y, yhat); the first max_lag samples are the measured ones."""
    if any(isinstance(sql, Computed) for _, sql in terms):
        value = " + ".join(f"{float(t)!r}D * t{i}" for i, t in enumerate(theta)) or "0D"
        return expanded(lagged(series, columns, bucket), columns, terms).select("series_id", "k", "y", F.expr(f"if(k <= {max_lag(columns)}, y, {value})").alias("yhat"))
    value = " + ".join(f"{float(t)!r}D * ({sql})" for t, (_, sql) in zip(theta, terms)) or "0D"
    rows = lagged(series, columns, bucket)
    return rows.select("series_id", "k", "y", F.expr(f"if(k <= {max_lag(columns)}, y, {value})").alias("yhat"))


def one_step_by_series(series: DataFrame, columns: list[str], terms: list[Term], models: DataFrame, column: str = "theta") -> DataFrame:
    """As ``one_step`` with an array of coefficients for each series in models (series_id, theta)."""
    value = " + ".join(f"{column}[{i}] * t{i}" for i in range(len(terms))) or "0D"
    rows = expanded(lagged(series, columns), columns, terms).join(models, "series_id")
    return rows.select("series_id", "k", "y", F.expr(f"if(k <= {max_lag(columns)}, y, {value})").alias("yhat"))


def _step(columns: list[str], terms: list[Term], theta: list[str]) -> str:
    """SQL of the next output: y lags from the accumulator, input lags from the row."""
    def fill(sql: str) -> str:
        sql = re.sub(r"\by_(\d+)\b", lambda m: f"element_at(a.h, -{m[1]})", sql)
        return re.sub(r"\b(x\d+_\d+)\b", r"b.\1", sql)

    return " + ".join(f"{t} * ({fill(sql)})" for t, (_, sql) in zip(theta, terms)) or "0D"


def n_steps(series: DataFrame, columns: list[str], terms: list[Term], theta: list[float] | None, steps: int | None, models: DataFrame | None = None) -> DataFrame:
    """(series_id, k, y, yhat): blocks of ``steps`` samples, each started from measured values; None: one block, a free run.

    Coefficients are given as ``theta`` or, one array a series, as models (series_id, theta).  A block is folded in one SQL row.
    """
    if steps is None:
        return free_run(series, columns, terms, theta, models)
    if isinstance(steps, bool) or steps < 1:
        raise ValueError("steps must be an integer from 1")
    p = max_lag(columns)
    inputs = [c for c in columns if not c.startswith("y_")]
    if any(isinstance(sql, Computed) for _, sql in terms):
        return _blocks(series, columns, terms, theta, steps, models)
    rows = lagged(series, [*inputs, *(f"y_{i}" for i in range(1, p + 1))])
    names = [f"theta[{i}]" for i in range(len(terms))] if models is not None else [f"{float(t)!r}D" for t in theta or []]
    start = f"array({', '.join(f'y_{i}' for i in range(p, 0, -1))})"
    rows = rows.withColumn("start", F.expr(start))
    head = rows.where(f"k <= {p}").select("series_id", "k", "y", F.col("y").alias("yhat"))
    tail = rows.where(f"k > {p}").withColumn("block", F.expr(f"(k - 1 - {p}) div {steps}"))
    folded = tail.groupBy("series_id", "block").agg(F.array_sort(F.collect_list(F.struct("k", "y", *inputs, "start"))).alias("r"))
    if models is not None:
        folded = folded.join(models.select("series_id", "theta"), "series_id")
    nxt = f"transform(array({_step(columns, terms, names)}), v -> struct(array_append(slice(a.h, 2, {p}), v) as h, array_append(a.o, v) as o))[0]"
    fold = f"aggregate(r, struct(r[0].start as h, cast(array() as array<double>) as o), (a, b) -> {nxt}, a -> a.o)"
    out = folded.select("series_id", "r", F.expr(fold).alias("o")).select("series_id", F.explode(F.arrays_zip("r", "o")).alias("z"))
    return head.unionByName(out.select("series_id", "z.r.k", "z.r.y", F.col("z.o").alias("yhat")))


def _blocks(series: DataFrame, columns: list[str], terms: list[Term], theta: list[float] | None, steps: int, models: DataFrame | None) -> DataFrame:
    """``n_steps`` of terms that are Python functions: a fold for each series that starts anew from the measured outputs."""
    p = max_lag(columns)
    inputs = [c for c in columns if not c.startswith("y_")]
    step_of, fixed = next_output(terms, columns), None if models is not None else [float(t) for t in theta or []]
    rows = lagged(series, inputs).select("series_id", "k", F.col("y").cast("double").alias("y"), *inputs)
    if models is not None:
        rows = rows.join(models.select("series_id", "theta"), "series_id")

    def step(state: dict, k: int, y: float, *row) -> float:
        out = y
        if state["n"] >= p:
            if (state["n"] - p) % steps == 0:
                state["h"] = list(state["y"])
            x, coefficients = (row, fixed) if fixed is not None else (row[:-1], row[-1])
            out = step_of(state["h"], x, coefficients)
            state["h"] = [*state["h"][1:], out]
        state["n"] += 1
        state["y"] = [*state["y"][1:], y]
        return out

    out = ordered(rows, ["y", *inputs, *(["theta"] if models is not None else [])], lambda *row: {"h": [0.0] * p, "y": [0.0] * p, "n": 0}, step, "double")
    return out.join(series.select("series_id", F.col("k").cast("long").alias("k"), "y"), ["series_id", "k"]).select("series_id", "k", "y", F.col("value").alias("yhat"))


def affine_form(columns: list[str], terms: list[Term], theta: list[str]) -> tuple[list[str], str] | None:
    """(SQL of the factor of each output lag 1..max_lag, SQL of the rest), or None if the next output is not affine in them."""
    lags: list[list[str]] = [[] for _ in range(max_lag(columns))]
    rest: list[str] = []
    if any(isinstance(sql, Computed) for _, sql in terms):
        return None
    for value, (name, sql) in zip(theta, terms):
        parts = factors(name)
        if all(f in columns for f in parts):
            outputs = [f for f in parts if f.startswith("y_")]
            if len(outputs) > 1:
                return None
            others = [f for f in parts if not f.startswith("y_")]
            (lags[int(outputs[0][2:]) - 1] if outputs else rest).append(" * ".join([value, *others]))
        elif re.search(r"\by_\d+\b", sql):
            return None
        else:
            rest.append(f"{value} * ({sql})")
    return [" + ".join(x) or "0D" for x in lags], " + ".join(rest) or "0D"


def _companion(p: int):
    """Steps of the last p outputs, newest first, over rows (a1..ap, u, ..): y = a1 y1 + .. + ap yp + u."""

    def steps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros((len(data), p, p)), np.zeros((len(data), p, 1))
        a[:, 0] = data[:, :p]
        a[:, np.arange(1, p), np.arange(p - 1)] = 1.0
        b[:, 0, 0] = data[:, p]
        return a, b

    return steps


def _run(rows: DataFrame, columns: list[str], terms: list[Term], theta: list[float] | None, models: DataFrame | None, known: Column, single: bool) -> DataFrame:
    """(series_id, k, value): the outputs of rows (series_id, stretch, k, y, known, inputs), y where ``known`` holds (value null) and predicted from the outputs before elsewhere."""
    p = max_lag(columns)
    inputs = [c for c in columns if not c.startswith("y_")]
    if models is not None:
        rows = rows.join(models.select("series_id", "theta"), "series_id")
    names = [f"theta[{i}]" for i in range(len(terms))] if models is not None else [f"({float(t)!r}D)" for t in theta or []]
    rows = rows.withColumn("known", known)
    form = affine_form(columns, terms, names)
    if form is not None:
        lag = [F.when(F.col("known"), 0.0).otherwise(F.expr(sql)).alias(f"a{i}") for i, sql in enumerate(form[0])]
        whole = rows.select("series_id", "stretch", "k", *lag, F.when(F.col("known"), F.col("y")).otherwise(F.expr(form[1])).alias("u"), F.col("known").cast("double").alias("known"))
        value = lambda held, data: pa.array(held[:, 0, 0], mask=data[:, -1] > 0)
        return scan.run(whole, [*(f"a{i}" for i in range(p)), "u", "known"], (p, 1), _companion(p), value, "double", single)
    step_of = next_output(terms, columns)
    fixed = None if models is not None else [float(t) for t in theta or []]

    def step(state: dict, k: int, y: float | None, known: bool, *row) -> float | None:
        out = None
        if not known:
            x, coefficients = (row, fixed) if fixed is not None else (row[:-1], row[-1])
            out = y = step_of(state["h"], x, coefficients)
        state["h"].append(y)
        del state["h"][0]
        return out

    return ordered(rows, ["y", "known", *inputs, *(["theta"] if models is not None else [])], lambda *row: {"h": [0.0] * p}, step, "double")


def free_run(series: DataFrame, columns: list[str], terms: list[Term], theta: list[float] | None, models: DataFrame | None = None, length: int | None = None) -> DataFrame:
    """(series_id, k, y, yhat): the first max_lag outputs as measured, then predictions from predictions and the inputs.

    Where y is null beyond its start, as for samples to come of which only the inputs are known, it is not needed.  k is dense; ``length``: samples of a stretch.
    """
    p = max_lag(columns)
    inputs = [c for c in columns if not c.startswith("y_")]
    rows, single = scan.placed(series, length)
    # a long series is cut with a halo, so that it does not pass through one task
    rows = lagged(rows, inputs, None if single else max(p, length or scan.LEAST))
    missing = F.raise_error(F.lit(f"the first {p} outputs of a series must be known"))
    known = F.col("row") <= p
    out = _run(rows.withColumn("y", F.when(known & F.col("y").isNull(), missing.cast("double")).otherwise(F.col("y"))), columns, terms, theta, models, known, single)
    both = out.join(series.select("series_id", F.col("k").cast("long").alias("k"), "y"), ["series_id", "k"])
    return both.select("series_id", "k", "y", F.coalesce("value", "y").alias("yhat"))


def forecast(series: DataFrame, columns: list[str], terms: list[Term], theta: list[float] | None, horizon: int, models: DataFrame | None = None, future: DataFrame | None = None) -> DataFrame:
    """(series_id, k, yhat): ``horizon`` samples after the end of each series, from its last outputs on.

    A model with inputs needs ``future`` (series_id, k, x1..) with their values after the end; a series is forecast
    as far as its future goes, ``horizon`` samples at most.
    """
    if isinstance(horizon, bool) or horizon < 1:
        raise ValueError("horizon must be an integer from 1")
    p = max_lag(columns)
    inputs = sorted({c.rpartition("_")[0] for c in columns if not c.startswith("y_")})
    if inputs and future is None:
        raise ValueError("a model with inputs needs their future values")
    last = series.groupBy("series_id").agg(F.max("k").alias("n"))
    tail = series.join(last, "series_id").where(f"k > n - {p}").select("series_id", "n", F.col("k").cast("long").alias("k"), "y", *inputs)
    if future is None:
        future = last.select("series_id", F.explode(F.expr(f"sequence(n + 1, n + {horizon})")).alias("k"))
    ahead = future.join(last, "series_id").where(f"k > n and k <= n + {horizon}").select("series_id", "n", F.col("k").cast("long").alias("k"), F.lit(None).cast("double").alias("y"), *inputs)
    short = tail.unionByName(ahead)
    # a series under max_lag samples counts from zeros, as lags do
    rows = lagged(short, [c for c in columns if not c.startswith("y_")]).withColumn("stretch", F.lit(0).cast("long"))
    out = _run(rows, columns, terms, theta, models, F.col("y").isNotNull(), True)
    return out.where("value is not null").select("series_id", "k", F.col("value").alias("yhat"))
