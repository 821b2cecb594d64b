"""Leave-one-out views at a cost that is linear in the samples.

The squared errors of all views follow from the Gram matrix of the whole series and one row each: leaving a
sample out is a rank-one downdate, and the downdated inverse is known from the leverage of the row.  The absolute errors of
a single term are the value of one convex piecewise-linear function, sum |y - theta v|, at as many points as there are
views; its breakpoints y / v and the points are sorted together, and running sums give them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import packed
from .ranges import attach, running
from .scan import placed

#: Samples of a series that one task works on.
STRETCH = 1 << 16
#: Below this, 1 - leverage has too few digits and the view's inverse is computed anew.
LEAST = 1e-9


def _with_gram(psi: DataFrame, m: int, work: Callable, schema: str, length: int) -> DataFrame:
    """(series_id, ..): what ``work(full, k, y, t)`` gives for pieces of every series; full: its sums of products over [t0..tm-1, y, 1]."""
    names = [*(f"t{i}" for i in range(m)), "y"]
    kind = psi.schema["series_id"].dataType.simpleString()
    rows, _ = placed(psi.select("series_id", F.col("k").cast("long").alias("k"), *(F.col(c).cast("double").alias(c) for c in names)), length)
    # the first row of a stretch, without a k, brings the sums along
    heads = rows.select("series_id", "stretch").distinct().join(packed(psi, m), "series_id")
    both = rows.select("series_id", "stretch", "k", *names, F.lit(None).cast("binary").alias("values"))
    both = both.unionByName(heads, allowMissingColumns=True).repartition("series_id", "stretch").sortWithinPartitions("series_id", "stretch", "k")
    out_names = ["series_id", *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = None
        for batch in batches:
            head = np.flatnonzero(np.asarray(batch["k"].is_null()))
            for a, b in zip([0, *(head + 1).tolist()], [*head.tolist(), batch.num_rows]):
                if b > a:
                    part = batch.slice(a, b - a)
                    t = np.column_stack([np.asarray(part[f"t{i}"]) for i in range(m)])
                    with np.errstate(all="ignore"):
                        out = work(full, np.asarray(part["k"]), np.asarray(part["y"]), t)
                    n = len(next(iter(out.values())))
                    ids = part["series_id"].take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in out.values())], out_names)
                if b < batch.num_rows:
                    full = np.frombuffer(batch["values"][b].as_py()).reshape(m + 2, m + 2)

    return both.mapInArrow(run, f"series_id {kind}, {schema}")


def _inverse(g: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(g, rcond=1e-12, hermitian=True)


def left_out(full: np.ndarray, y: np.ndarray, t: np.ndarray, chosen: list[int], rest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(products with y, sums of squares), samples by ``rest``, of the rest's terms in each sample's view, after what the chosen terms explain of them there is taken away."""
    m = len(full) - 2
    q = t[:, rest]
    num = full[rest, m] - q * y[:, None]
    den = full[rest, rest] - q * q
    if not chosen:
        return num, den
    c, g = t[:, chosen], full[np.ix_(chosen, chosen)]
    cq, cy = full[np.ix_(chosen, rest)], full[chosen, m]
    inverse = _inverse(g)
    z = c @ inverse
    h = np.einsum("ij,ij->i", z, c)
    p, py = z @ cq, z @ cy
    away = 1 - h
    gain = 1 / np.where(away > LEAST, away, 1.0)
    right, left = p - q * h[:, None], py - y * h
    power = np.einsum("ij,ij->j", cq, inverse @ cq) - 2 * q * p + q * q * h[:, None] + gain[:, None] * right * right
    cross = cy @ inverse @ cq - y[:, None] * p - q * py[:, None] + y[:, None] * q * h[:, None] + gain[:, None] * left[:, None] * right
    for i in np.flatnonzero(away <= LEAST):
        back = _inverse(g - np.outer(c[i], c[i])) @ (cq - np.outer(c[i], q[i]))
        power[i] = np.einsum("ij,ij->j", cq - np.outer(c[i], q[i]), back)
        cross[i] = (cy - c[i] * y[i]) @ back
    return num - cross, den - power


def squared_errors(psi: DataFrame, m: int, chosen: list[int], measure: str, eps: float = 1e-12, length: int = STRETCH) -> DataFrame:
    """(series_id, view, term, error) as ``robust.view_errors`` defines them, for the measures mse and rmse_ratio."""
    rest = [i for i in range(m) if i not in chosen]

    def work(full: np.ndarray, k: np.ndarray, y: np.ndarray, t: np.ndarray) -> dict:
        num, den = left_out(full, y, t, chosen, rest)
        n, total = full[-1, -1] - 1, (full[m, m] - y * y)[:, None]
        theta = num / np.where(den < eps, eps, den)
        sse, fit = np.maximum(total - 2 * theta * num + theta * theta * den, 0), np.maximum(theta * theta * den, 0)
        error = sse / n
        if measure == "rmse_ratio":
            bottom = np.sqrt(np.maximum(total, 0) / n) + np.sqrt(fit / n)
            error = np.sqrt(error) / np.where(bottom < eps, eps, bottom)
        return {"view": np.repeat(k, len(rest)), "term": np.tile(np.array(rest, np.int32), len(k)), "error": error.ravel()}

    return _with_gram(psi, m, work, "view long, term int, error double", length)


def coefficients(psi: DataFrame, m: int, length: int = STRETCH) -> DataFrame:
    """(series_id, i, v): the mean over the views of a series of the least-squares coefficients of t0..tm-1."""

    def work(full: np.ndarray, k: np.ndarray, y: np.ndarray, t: np.ndarray) -> dict:
        g, b = full[:m, :m], full[:m, m]
        inverse = _inverse(g)
        theta = inverse @ b
        z = t @ inverse
        away = 1 - np.einsum("ij,ij->i", z, t)
        fine = away > LEAST
        change = z * ((y - t @ theta) / np.where(fine, away, 1.0))[:, None]
        sums = len(y) * theta - change[fine].sum(0) - (~fine).sum() * theta
        for i in np.flatnonzero(~fine):
            sums = sums + _inverse(g - np.outer(t[i], t[i])) @ (b - t[i] * y[i])
        return {"i": np.arange(m, dtype=np.int32), "v": sums, "n": np.full(m, len(y), np.int64)}

    out = _with_gram(psi, m, work, "i int, v double, n long", length).groupBy("series_id", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return out.select("series_id", "i", (F.col("v") / F.col("n")).alias("v"))


def absolute_errors(psi: DataFrame, m: int, measure: str, eps: float = 1e-12) -> DataFrame:
    """(series_id, view, term, error) of all terms alone, for the measures mae and phi3: n log n by sorted breakpoints."""
    item = F.explode(F.array(*(F.struct(F.lit(i).alias("term"), F.col(f"t{i}").cast("double").alias("v")) for i in range(m))))
    rows = psi.select("series_id", F.col("k").cast("long").alias("k"), F.col("y").cast("double").alias("y"), item.alias("of")).select("series_id", "k", "y", "of.*")
    by = ["series_id", "term"]
    y, v = F.col("y"), F.col("v")
    still = F.when(v == 0, F.abs(y)).otherwise(0.0)
    totals = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(v * y).alias("b"), F.sum(v * v).alias("g"), F.sum(F.abs(y)).alias("ya"), F.sum(F.abs(v)).alias("w_all"), F.sum(y * F.signum(v)).alias("s_all"), F.sum(still).alias("y0"))
    power = F.col("g") - v * v
    # a view is a point of the function, a sample one of its breakpoints; both in one order, points after equal breakpoints
    views = attach(rows, totals, by).withColumn("x", (F.col("b") - v * y) / F.when(power < eps, eps).otherwise(power))
    breaks = rows.where("v <> 0").select(*by, "k", (y / v).alias("x"), F.abs(v).alias("w"), (y * F.signum(v)).alias("s"), F.lit(0).alias("kind"))
    points = views.select(*by, "k", "x", F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(1).alias("kind"), "y", "v", "n", "ya", "w_all", "s_all", "y0")
    both = breaks.unionByName(points, allowMissingColumns=True)
    held = running(both, by, ["x", "kind", "k"], {"wu": F.col("w"), "su": F.col("s")}, "breakpoints").where("kind = 1")
    theta = F.col("x")
    top = theta * (2 * F.col("wu") - F.col("w_all")) - (2 * F.col("su") - F.col("s_all")) + F.col("y0") - F.abs(y - theta * v)
    if measure == "mae":
        error = top / F.nullif(F.col("n") - 1, F.lit(0))
    else:
        bottom = F.col("ya") - F.abs(y) + F.abs(theta) * (F.col("w_all") - F.abs(v))
        error = top / F.when(bottom < eps, eps).otherwise(bottom)
    return held.select("series_id", F.col("k").alias("view"), "term", error.alias("error"))
