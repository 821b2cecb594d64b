"""Residual analysis: auto- and cross-correlation by lag, any number of lags at about the same cost.

The lagged sums of products come from fast Fourier transforms of stretches.  Two stretches that lie d apart hold products
of the lags around d times their length; the spectra of all pairs at the same distance are added up and transformed back once.  Means and
squares over the first or last samples are running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.near import groups
from ..operators.ranges import attach, running
from ..sources.scratch import materialize

#: Samples in one row while stretches are dealt out, least samples of a stretch, distances between stretches, and pairs of one distance that a task takes.
PIECE = 1024
LEAST = 4096
MOST = 32
PAIRS = 32


def residues(pred: DataFrame) -> DataFrame:
    return pred.select("series_id", "k", (F.col("y") - F.col("yhat")).alias("e"))


def lagged_products(pair: DataFrame, lags: int | None = None, length: int | None = None) -> DataFrame:
    """(series_id, lag, c): the sum of a(k) b(k + lag) for lag 0..lags (None: all) of pair (series_id, k, a, b), k from 1; a missing sample counts as 0.

    ``length``: samples of a stretch, by default a part of the lags wanted.
    """
    kind = pair.schema["series_id"].dataType.simpleString()
    pair = pair.select("series_id", F.col("k").cast("long").alias("k"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    ends = materialize(pair.groupBy("series_id").agg(F.max("k").alias("last")), "series-ends")
    top = ends.agg(F.max("last")).first()[0] or 1
    most = top - 1 if lags is None else max(0, min(lags, top - 1))
    length = length or max(LEAST, -(-most // MOST))
    length = -(-length // PIECE) * PIECE
    rows = pair.groupBy("series_id", F.expr(f"(k - 1) div {PIECE}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("r"))
    rows = attach(rows, ends, ["series_id"]).withColumn("p", F.expr(f"piece * {PIECE} div {length}")).withColumn("last_p", F.expr(f"(last - 1) div {length}"))
    far = most // length + 1
    at = F.transform("r", lambda r: (r["k"] - 1 - F.col("piece") * PIECE).cast("int"))
    sides = []
    for role, value, distances in ((0, "a", f"sequence(0L, least({far}L, last_p - p))"), (1, "b", f"sequence(0L, least({far}L, p))")):
        side = rows.select("series_id", "p", "piece", at.alias("at"), F.expr(f"r.{value}").alias("v"), F.lit(role).alias("role"), F.explode(F.expr(distances)).alias("d"))
        sides.append(side.withColumn("p", F.col("p") - role * F.col("d")))
    both = sides[0].unionByName(sides[1])
    # pairs of one distance stay together, some at a time
    both = both.withColumn("group", F.expr(f"p div {PAIRS}")).withColumn("cell", F.expr("d * 4294967296 + p"))
    both = both.repartition("series_id", "d", "group").sortWithinPartitions("series_id", "d", "group", "p", "role", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spectrum, ids = run, None, None

        def flush() -> pa.RecordBatch:
            c = np.fft.irfft(spectrum, 2 * length)
            lag = key[1] * length + np.r_[np.arange(length), np.arange(-length, 0)]
            keep = np.flatnonzero((lag >= 0) & (lag <= most))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.zeros(len(keep), np.int64))), pa.array(lag[keep]), pa.array(c[keep])], ["series_id", "lag", "c"])

        for series, cell, part in groups(batches):
            now = (series, cell >> 32)
            if now != key:
                if key is not run:
                    yield flush()
                key, spectrum, ids = now, np.zeros(length + 1, complex), part["series_id"].combine_chunks().slice(0, 1)
            sides = np.zeros((2, length))
            start = part["piece"].to_numpy() * PIECE % length
            for i, role in enumerate(part["role"].to_pylist()):
                where = start[i] + part["at"][i].values.to_numpy()
                sides[role, where] = part["v"][i].values.to_numpy(zero_copy_only=False)
            left, right = np.fft.rfft(np.nan_to_num(sides), 2 * length)
            spectrum += np.conj(left) * right
        if key is not run:
            yield flush()

    out = both.select("series_id", "cell", "piece", "role", "at", "v").mapInArrow(run, f"series_id {kind}, lag long, c double")
    out = out.groupBy("series_id", "lag").agg(F.sum("c").alias("c"))
    return attach(out, ends, ["series_id"]).where("lag < last").select("series_id", "lag", "c")


def autocorrelation(e: DataFrame, lags: int | None = None) -> DataFrame:
    """(series_id, lag, acf, bound) of residuals (series_id, k, e), k dense from 1, for lag 0..lags (None: all): lagged products without their mean over the
    product at lag 0; bound 1.96 / sqrt(2n - 1)."""
    c = materialize(lagged_products(e.select("series_id", "k", F.col("e").alias("a"), F.col("e").alias("b")), lags), "lagged-products")
    zero = c.where("lag = 0").select("series_id", F.col("c").alias("c0"))
    zero = zero.join(e.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    return attach(c, materialize(zero, "series-power"), ["series_id"]).select("series_id", "lag", (F.col("c") / F.nullif(F.col("c0"), F.lit(0.0))).alias("acf"), (1.96 / F.sqrt(2 * F.col("n") - 1)).alias("bound"))


def cross_correlation(pair: DataFrame, lags: int | None = None) -> DataFrame:
    """(series_id, lag, ccf, bound) of (series_id, k, a, b), k dense from 1, for lag 0..lags (None: all), under half the samples.

    At lag t the means are those of a's first t and of b's samples after the first t; the sums run
    over a without its last t samples and b without its first t; at lag 0 over all samples and means.
    """
    means = materialize(pair.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb")), "series-means")
    # about their means, which changes nothing but the digits that are left
    rows = attach(pair.select("series_id", F.col("k").cast("long").alias("k"), "a", "b"), means, ["series_id"])
    rows = materialize(rows.select("series_id", "k", "n", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b")), "centred")
    if lags is None:
        lags = (means.agg(F.max("n")).first()[0] or 0) // 2
    c = lagged_products(rows, lags)
    c = attach(c, means.select("series_id", "n"), ["series_id"]).where("lag < greatest(1, floor(n / 2))")
    upto = running(rows, ["series_id"], ["k"], {"sa": F.col("a"), "saa": F.col("a") * F.col("a"), "sb": F.col("b"), "sbb": F.col("b") * F.col("b")}, "running-moments")
    upto = materialize(upto.select("series_id", "k", "sa", "saa", "sb", "sbb"), "moments")
    head = upto.select("series_id", F.col("k").alias("lag"), F.col("sa").alias("head_a"), F.col("sb").alias("head_b"), F.col("sbb").alias("head_bb"))
    tail = upto.select("series_id", F.col("k").alias("upto"), F.col("sa").alias("su"), F.col("saa").alias("suu"))
    every = upto.join(means.select("series_id", F.col("n").alias("k")), ["series_id", "k"]).select("series_id", F.col("sb").alias("all_b"), F.col("sbb").alias("all_bb"))
    both = attach(c, materialize(every, "whole-moments"), ["series_id"]).withColumn("upto", F.col("n") - F.col("lag"))
    both = both.join(tail, ["series_id", "upto"]).join(head, ["series_id", "lag"], "left")
    zero = F.lit(0.0)
    m, t = F.col("upto").cast("double"), F.col("lag")
    su, suu = F.col("su"), F.col("suu")
    sv, svv = F.col("all_b") - F.coalesce("head_b", zero), F.col("all_bb") - F.coalesce("head_bb", zero)
    x, z = F.when(t == 0, zero).otherwise(F.col("head_a") / F.nullif(t, F.lit(0).cast("long"))), F.when(t == 0, zero).otherwise(sv / m)
    uv = F.col("c") - z * su - x * sv + m * x * z
    uu, vv = suu - 2 * x * su + m * x * x, svv - 2 * z * sv + m * z * z
    power = F.sqrt(F.greatest(uu, zero) * F.greatest(vv, zero))
    return both.select("series_id", "lag", (uv / F.nullif(power, zero)).alias("ccf"), (1.96 / F.sqrt(2 * F.col("n") - 1)).alias("bound"))
