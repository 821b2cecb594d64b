"""Lag projection: one window for all lags of a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basis import Computed, Term, computed, max_lag


def shift(column: str, lag: int, window) -> F.Column:
    """The value ``lag`` samples before, 0 before the start."""
    if lag < 0:
        raise ValueError("lag must not be negative")
    return F.lag(column, lag, 0.0).over(window) if lag else F.col(column)


def lagged(series: DataFrame, columns: list[str], bucket: int | None = None) -> DataFrame:
    """series with lag columns (``y_1``, ``x1_2``) added, zeros before the start of each series.

    With ``bucket`` a long series is cut into stretches of that many samples; each receives the last samples of the
    one before, so that every stretch is a task of its own and the result is the same.
    """
    by = ["series_id"]
    if bucket:
        halo = max_lag(columns)
        if bucket < halo:
            raise ValueError("a bucket must hold at least max_lag samples")
        own = series.withColumn("_b", F.expr(f"(k - 1) div {bucket}")).withColumn("_own", F.lit(True))
        copy = own.where((F.col("k") - 1) % bucket >= bucket - halo).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
        series, by = own.unionByName(copy), ["series_id", "_b"]
    w = Window.partitionBy(*by).orderBy("k")
    out = series.select("*", *(shift(c.rpartition("_")[0], int(c.rpartition("_")[2]), w).alias(c) for c in columns))
    return out.where("_own").drop("_b", "_own") if bucket else out


def expanded(rows: DataFrame, columns: list[str], terms: list[Term]) -> DataFrame:
    """(series_id, k, y, t0..tm-1) of rows with lag columns: SQL terms as expressions, computed ones by their functions over Arrow batches."""
    sql = {i: F.expr(x).alias(f"t{i}") for i, (_, x) in enumerate(terms) if not isinstance(x, Computed)}
    if len(sql) == len(terms):
        return rows.select("series_id", "k", "y", *sql.values())
    ready = rows.select("series_id", "k", F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in columns), *(F.expr(terms[i][1]).cast("double").alias(f"t{i}") for i in sql))
    schema = ready.select("series_id", "k", "y").schema
    for i in range(len(terms)):
        schema = schema.add(f"t{i}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lags = np.column_stack([np.asarray(batch[c]) for c in columns]) if columns else np.zeros((batch.num_rows, 0))
            made = computed(terms, columns, lags)
            yield pa.RecordBatch.from_arrays([batch["series_id"], batch["k"], batch["y"], *(pa.array(made[i]) if i in made else batch[f"t{i}"] for i in range(len(terms)))], schema.names)

    return ready.mapInArrow(run, schema)


def regressors(series: DataFrame, columns: list[str], terms: list[Term], bucket: int | None = None) -> DataFrame:
    """(series_id, k, y, t0..tm-1): the term columns, without the first max_lag samples of each series."""
    return expanded(lagged(series, columns, bucket).where(F.col("k") > max_lag(columns)), columns, terms)
