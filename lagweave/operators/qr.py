"""Least squares without the Gram matrix: a tree of R factors, and Golub-Kahan steps of one pass each.

The Gram matrix squares the condition number of the terms.  Here every task reduces its rows of [Psi y] to
one upper triangular factor, and factors are stacked and reduced again, a few at a time, until one is left: it holds all that
least squares, ridge and total least squares need, at the condition of Psi itself.  The damped
minimal residual is found by bidiagonalisation instead.  Its long vectors are never stored: each is
A w + c y for a short w, so that a step is one sum over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Factors that one task stacks.
FAN = 16
EPS = float(np.finfo(float).eps)


def _names(m: int) -> list[str]:
    return [*(f"t{i}" for i in range(m)), "y"]


def _reduced(rows: np.ndarray, width: int) -> np.ndarray:
    """R of the rows, padded with zeros to a square."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def factors(psi: DataFrame, m: int, by: str | None = None) -> DataFrame:
    """(key, r): the factor R of [t0..tm-1, y], m + 1 square, of all rows (key null) or of each value of ``by``; bytes of doubles, row by row."""
    width = m + 1
    kind = psi.schema[by].dataType.simpleString() if by else "long"
    names = ["key", "node", "r"]
    rows = psi.select((F.col(by) if by else F.lit(None).cast("long")).alias("key"), F.spark_partition_id().cast("long").alias("node"), *(F.col(c).cast("double") for c in _names(m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.column_stack([np.asarray(batch[c]) for c in _names(m)])
            ids = batch["key"].dictionary_encode()
            code, values = np.asarray(ids.indices.fill_null(-1)), ids.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                key = values[code[order[a]]] if code[order[a]] >= 0 else None
                some = data[order[a:b]]
                held[key] = _reduced(np.vstack([held[key], some]) if key in held else some, width)
            # a task with very many keys passes its factors on
            if len(held) > 4096:
                yield out(held, batch)
                held = {}
            last = batch
        if held:
            yield out(held, last)

    def out(held: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch["node"][0].as_py()
        return pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field("key").type), pa.array([node] * len(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names)

    def merge(group: pa.Table) -> pa.Table:
        r = _reduced(np.vstack([np.frombuffer(v).reshape(width, width) for v in group["r"].to_pylist()]), width)
        return pa.table([group["key"].slice(0, 1), group["node"].slice(0, 1), pa.array([r.tobytes()], pa.binary())], names)

    schema = f"key {kind}, node long, r binary"
    parts = materialize(rows.mapInArrow(run, schema), "r-factors")
    step = 1
    while True:
        most = parts.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts.select("key", "r")
        step *= FAN
        parts = parts.groupBy("key", F.expr(f"node div {step}").alias("of")).applyInArrow(merge, schema)
        parts = materialize(parts, "r-factors")


def factor(psi: DataFrame, m: int) -> np.ndarray:
    """R of all rows: (m + 1)^2 numbers, whatever the data."""
    row = factors(psi, m).first()
    return np.frombuffer(row["r"]).reshape(m + 1, m + 1) if row else np.zeros((m + 1, m + 1))


def solve(r: np.ndarray, ridge: float = 0.0, rcond: float = EPS) -> np.ndarray:
    """Least squares from R, of least norm where the terms are dependent; columns are scaled to unit length first unless ridge is positive."""
    a, b = r[:-1, :-1], r[:-1, -1]
    if ridge < 0:
        raise ValueError("ridge must not be negative")
    if ridge > 0:
        a, b = np.vstack([a, np.sqrt(ridge) * np.eye(len(b))]), np.r_[b, np.zeros(len(b))]
        return np.linalg.lstsq(a, b, rcond=None)[0]
    scale = np.linalg.norm(a, axis=0)
    scale[scale == 0] = 1.0
    u, s, v = np.linalg.svd(a / scale)
    if not len(s) or s[-1] > rcond * len(s) * s[0]:
        return v.T @ ((u.T @ b) / s) / scale if len(s) else b
    return np.linalg.pinv(a, rcond=rcond * max(1, len(s))) @ b


def total(r: np.ndarray) -> np.ndarray:
    """Total least squares: from the last right singular vector of R."""
    v = np.linalg.svd(r)[2][-1]
    if abs(v[-1]) < 1e-15:
        raise ValueError("no total least squares solution")
    return -v[:-1] / v[-1]


def by_series(psi: DataFrame, m: int, ridge: float = 0.0) -> DataFrame:
    """(series_id, theta): least squares of every series from its own factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            theta = [solve(np.frombuffer(v).reshape(m + 1, m + 1), ridge).tolist() for v in batch["r"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(theta, pa.list_(pa.float64()))], ["series_id", "theta"])

    kind = psi.schema["series_id"].dataType.simpleString()
    return factors(psi, m, "series_id").mapInArrow(run, f"series_id {kind}, theta array<double>")


def _image(psi: DataFrame, m: int, w: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """(A'u, u'u) of u = A w + c y, in one pass; each task sends m + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(m + 1)
        for batch in batches:
            a = np.column_stack([np.asarray(batch[f"t{i}"]) for i in range(m)])
            u = a @ w + c * np.asarray(batch["y"])
            sums += np.r_[a.T @ u, u @ u]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m + 1, dtype=np.int32)), pa.array(sums)], ["i", "v"])

    sums = psi.select(*(F.col(x).cast("double") for x in _names(m))).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(m + 1)
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out[:m], float(out[m])


def minimal_residual(psi: DataFrame, m: int, damp: float = 0.0, steps: int | None = None, tolerance: float = 1e-14) -> tuple[np.ndarray, int]:
    """(theta, passes): min |Psi theta - y|^2 + damp^2 |theta|^2 with the least |A'r| in each Krylov space, without a Gram matrix.

    After ``steps`` (m by default) the space is full; it ends earlier when a further direction vanishes or |A'r| falls below ``tolerance``
    of what it was.
    """
    if m == 0:
        return np.zeros(0), 0
    g, s = _image(psi, m, np.zeros(m), 1.0)
    beta, passes = [np.sqrt(s)], 1
    if not s or not np.linalg.norm(g):
        return np.zeros(m), passes
    w, c = np.zeros(m), 1 / beta[0]
    v = g / beta[0]
    alpha = [np.linalg.norm(v)]
    basis = [v / alpha[0]]
    first = alpha[0] * beta[0]
    theta = np.zeros(m)
    for k in range(1, min(steps or m, m) + 1):
        # u_(k+1) = (A v_k - alpha_k u_k) / beta_(k+1), kept as A w + c y
        w, c = basis[-1] - alpha[-1] * w, -alpha[-1] * c
        g, s = _image(psi, m, w, c)
        passes += 1
        beta.append(np.sqrt(s))
        last = beta[-1] <= EPS * first
        if not last:
            w, c = w / beta[-1], c / beta[-1]
            v = g / beta[-1] - beta[-1] * basis[-1]
            for _ in range(2):
                for x in basis:
                    v = v - (x @ v) * x
            alpha.append(np.linalg.norm(v))
            last = alpha[-1] <= EPS * alpha[0]
        b = np.zeros((k + 1, k))
        b[np.arange(k), np.arange(k)] = alpha[:k]
        b[np.arange(1, k + 1), np.arange(k)] = beta[1 : k + 1]
        r = np.linalg.qr(np.vstack([b, damp * np.eye(k)]), mode="r")
        rest = 0.0 if last else alpha[k] * beta[k]
        tail = np.zeros((1, k))
        tail[0, -1] = rest / r[-1, -1] if r[-1, -1] else 0.0
        t = np.linalg.lstsq(np.vstack([r.T, tail]), np.r_[first, np.zeros(k)], rcond=None)[0]
        y = np.linalg.solve(r, t) if abs(np.diag(r)).min() > 0 else np.linalg.lstsq(r, t, rcond=None)[0]
        theta = np.array(basis[:k]).T @ y
        gap = np.linalg.norm(np.r_[r.T @ t - np.r_[first, np.zeros(k - 1)], tail[0] @ t])
        if last or gap <= tolerance * first:
            break
        basis.append(v / alpha[-1])
    return theta, passes
