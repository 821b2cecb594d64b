"""Gram aggregation: everything the batch estimators and the structure searches need, in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term
from .lagging import regressors


@dataclass(frozen=True)
class Gram:
    """G = Psi'Psi, b = Psi'y, y'y, column sums, sum of y and n."""

    g: np.ndarray
    b: np.ndarray
    yy: float
    sums: np.ndarray
    y_sum: float
    n: int

    def sub(self, idx) -> Gram:
        idx = np.asarray(idx, int)
        return Gram(self.g[np.ix_(idx, idx)], self.b[idx], self.yy, self.sums[idx], self.y_sum, self.n)

    def sse(self, theta: np.ndarray) -> float:
        return float(self.yy - 2 * theta @ self.b + theta @ self.g @ theta)

    def residual_variance(self, theta: np.ndarray, ddof: int = 1) -> float:
        mean = (self.y_sum - self.sums @ theta) / self.n
        return max(0.0, self.sse(theta) - self.n * mean * mean) / (self.n - ddof)


def gram_rows(psi: DataFrame, m: int) -> DataFrame:
    """(i, j, g) for i <= j over [t0..tm-1, y, 1]: partial products in NumPy, summed by Spark."""
    names = [*(f"t{i}" for i in range(m)), "y"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 2, m + 2))
        for batch in batches:
            x = np.column_stack([*(np.asarray(batch[c], float) for c in names), np.ones(batch.num_rows)])
            total += x.T @ x
        i, j = np.triu_indices(m + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    return psi.select(*(F.col(c).cast("double") for c in names)).mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by block of (block, values), values the bytes of doubles: added up by Spark, each block in one task."""

    def run(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, float) for v in group["values"].to_pylist())
        return pa.table([group["block"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "values"])

    return {r["block"]: np.frombuffer(r["values"], float) for r in parts.groupBy("block").applyInArrow(run, "block int, values binary").collect()}


#: Rows of the Gram matrix that are sent together, and terms up to which it is summed in SQL.
BLOCK = 64
NARROW = 10


def gram_of(psi: DataFrame, m: int) -> Gram:
    """Collect the Gram matrix: (m + 2)^2 numbers, whatever the data; of few terms as SQL sums, else in blocks of rows."""
    names = [*(f"t{i}" for i in range(m)), "y"]
    if m <= NARROW:
        # a null spoils the sums, as it does in NumPy
        x = [*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names), F.lit(1.0)]
        sums = psi.agg(*(F.sum(x[i] * x[j]) for i in range(m + 2) for j in range(i, m + 2))).first()
        full = np.zeros((m + 2, m + 2))
        full[np.triu_indices(m + 2)] = [v or 0.0 for v in sums]
        full += np.triu(full, 1).T
        return Gram(full[:m, :m], full[:m, m], float(full[m, m]), full[:m, m + 1], float(full[m, m + 1]), int(round(full[m + 1, m + 1])))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 2, m + 2))
        for batch in batches:
            x = np.column_stack([*(np.asarray(batch[c], float) for c in names), np.ones(batch.num_rows)])
            total += x.T @ x
        blocks = range(0, m + 2, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], ["block", "values"])

    blocks = add_up(psi.select(*(F.col(c).cast("double") for c in names)).mapInArrow(partial, "block int, values binary"))
    full = np.concatenate([blocks[a] for a in sorted(blocks)]).reshape(m + 2, m + 2) if blocks else np.zeros((m + 2, m + 2))
    return Gram(full[:m, :m], full[:m, m], float(full[m, m]), full[:m, m + 1], float(full[m, m + 1]), int(round(np.nan_to_num(full[m + 1, m + 1]))))


def gram(series: DataFrame, columns: list[str], terms: list[Term], bucket: int | None = None) -> Gram:
    return gram_of(regressors(series, columns, terms, bucket), len(terms))


def grouped(psi: DataFrame, m: int, by: str = "series_id") -> DataFrame:
    """One row for each group: n, yy, ys, arrays s (sums), b and g (row by row), as SQL sums; for narrow models over many series."""
    t = [F.col(f"t{i}") for i in range(m)]
    return psi.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("ys"), F.array(*(F.sum(a) for a in t)).alias("s"), F.array(*(F.sum(a * F.col("y")) for a in t)).alias("b"), F.array(*(F.sum(a * c) for a in t for c in t)).alias("g"))


def packed(psi: DataFrame, m: int) -> DataFrame:
    """(series_id, values): for each series the bytes of its (m + 2)^2 sums of products over [t0..tm-1, y, 1].

    A task keeps one matrix while the series stays the same and sends it when it changes.
    """
    names = [*(f"t{i}" for i in range(m)), "y"]
    kind = psi.schema["series_id"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, total = None, None
        for batch in batches:
            x = np.column_stack([*(np.asarray(batch[c], float) for c in names), np.ones(batch.num_rows)])
            coded = batch["series_id"].dictionary_encode()
            code, ids = np.asarray(coded.indices.fill_null(-1)), [*coded.dictionary.to_pylist(), None]
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else [0]
            done = ([], [])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if total is None or ids[code[a]] != series:
                    if total is not None:
                        done[0].append(series)
                        done[1].append(total.tobytes())
                    series, total = ids[code[a]], np.zeros((m + 2, m + 2))
                total += x[a:b].T @ x[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(done[0], batch["series_id"].type), pa.array(done[1], pa.binary())], ["series_id", "values"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([series], batch["series_id"].type), pa.array([total.tobytes()], pa.binary())], ["series_id", "values"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, float) for v in group["values"].to_pylist())
        return pa.table([group["series_id"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["series_id", "values"])

    parts = psi.select("series_id", *(F.col(c).cast("double") for c in names)).mapInArrow(partial, f"series_id {kind}, values binary")
    return parts.groupBy("series_id").applyInArrow(add, f"series_id {kind}, values binary")


def unpack(values: bytes, m: int) -> Gram:
    full = np.frombuffer(values, float).reshape(m + 2, m + 2)
    return Gram(full[:m, :m], full[:m, m], float(full[m, m]), full[:m, m + 1], float(full[m, m + 1]), int(round(np.nan_to_num(full[m + 1, m + 1]))))
