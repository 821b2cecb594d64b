"""Ordered recurrences that are affine in their state, as an associative scan over stretches of a series.

A step x -> A x + b with A and b taken from the row alone can be combined with the next one before the state is
known: (A2, b2) after (A1, b1) is (A2 A1, A2 b1 + b2).  x and b are m by d matrices, most often with one column.  So a series is cut into stretches, every stretch is summed up as one
such pair wherever it lies, the pairs of a series are combined in order, which gives the state at the start of each stretch, and where
every state is wanted the stretches are replayed from there.  One long series thus uses as many tasks as it has
stretches; what meets in a task is a pair for each stretch, about the square root of the length in all.

Inside a batch the rows of all stretches advance together, in lanes of ``LANE`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one lane takes one after the other, least length of a stretch, numbers of the step matrices held at a time.
LANE = 64
LEAST = 4096
CELLS = 1 << 21
#: Series up to which their bounds are broadcast (32 bytes each).
FEW = 100_000

Steps = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def bounds(rows: DataFrame) -> DataFrame:
    """(series_id, first, last) of k."""
    return rows.groupBy("series_id").agg(F.min("k").cast("long").alias("first"), F.max("k").cast("long").alias("last"))


def placed(rows: DataFrame, length: int | None = None) -> tuple[DataFrame, bool]:
    """(rows with ``row``, its place in its series from 1, and its ``stretch``; whether every series has one stretch only).

    k is dense within a series.  Without a length it is the square root of the longest series, ``LEAST`` at least.
    """
    each = bounds(rows)
    top = each.agg(F.count("*").alias("n"), F.max(F.col("last") - F.col("first") + 1).alias("most")).first()
    length = length or max(LEAST, math.isqrt(top["most"] or 0))
    if top["n"] <= FEW:
        joined = rows.join(F.broadcast(each), "series_id")
    else:
        # a long series among very many: its rows meet copies of its bounds in several tasks
        copies = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = rows.withColumn("salt", F.expr(f"cast(((k - 1) div {length}) % 16 as int)")).join(copies, ["series_id", "salt"]).drop("salt")
    out = joined.withColumn("row", (F.col("k") - F.col("first") + 1).cast("long")).withColumn("stretch", F.expr(f"(row - 1) div {length}"))
    return out.drop("first", "last"), (top["most"] or 0) <= length


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, segment) of each lane, longer lanes first, for segments of the given sizes that follow each other."""
    per = -(-sizes // LANE)
    segment = np.repeat(np.arange(len(sizes)), per)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(per) - per, per)
    first = (np.cumsum(sizes) - sizes)[segment] + at * LANE
    rows = np.minimum(LANE, sizes[segment] - at * LANE)
    return first, rows, segment


def _lane_maps(a: np.ndarray, b: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = b.shape[1]
    total = np.broadcast_to(np.eye(m), (len(first), m, m)).copy()
    shift = np.zeros((len(first), *b.shape[1:]))
    for t in range(int(rows.max(initial=0))):
        on = np.flatnonzero(rows > t)
        step = a[first[on] + t]
        total[on] = step @ total[on]
        shift[on] = step @ shift[on] + b[first[on] + t]
    return total, shift


def combined(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair (A, b) of each of the segments that follow each other in the steps a (n, m, m) and b (n, m, d)."""
    m = b.shape[1]
    first, rows, segment = _lanes(sizes)
    total, shift = _lane_maps(a, b, first, rows)
    out, add = np.broadcast_to(np.eye(m), (len(sizes), m, m)).copy(), np.zeros((len(sizes), *b.shape[1:]))
    for lane, s in enumerate(segment.tolist()):
        out[s], add[s] = total[lane] @ out[s], total[lane] @ add[s] + shift[lane]
    return out, add


def states(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state after every row, each segment from its own start."""
    first, rows, segment = _lanes(sizes)
    total, shift = _lane_maps(a, b, first, rows)
    now, at = start.copy(), np.empty((len(first), *b.shape[1:]))
    for lane, s in enumerate(segment.tolist()):
        at[lane] = now[s]
        now[s] = total[lane] @ now[s] + shift[lane]
    out = np.empty_like(b)
    for t in range(int(rows.max(initial=0))):
        on = np.flatnonzero(rows > t)
        at[on] = a[first[on] + t] @ at[on] + b[first[on] + t]
        out[first[on] + t] = at[on]
    return out


def _segments(batches: Iterator[pa.RecordBatch], columns: list[str], shape: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int], list[tuple]]]:
    """Pieces of the batches with their columns as a matrix, the places where a (series, stretch) begins, and these pairs."""
    m, d = shape
    step = max(LANE, CELLS // max(1, m * (m + d)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            data = np.column_stack([np.asarray(part[c].cast(pa.float64())) for c in columns]) if columns else np.zeros((part.num_rows, 0))
            series, stretch = part["series_id"].dictionary_encode(), np.asarray(part["stretch"])
            code = np.asarray(series.indices.fill_null(-1))
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])])
            values = series.dictionary.to_pylist()
            yield part, data, new.tolist(), [(values[code[i]] if code[i] >= 0 else None, int(stretch[i])) for i in new]


def _dealt(rows: DataFrame, columns: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    return rows.select("series_id", "stretch", F.col("k").cast("long").alias("k"), *columns, *extra).repartition("series_id", "stretch").sortWithinPartitions("series_id", "stretch", "k")


def summaries(rows: DataFrame, columns: list[str], shape: tuple[int, int], steps: Steps) -> DataFrame:
    """(series_id, stretch, pair): for every stretch of rows (series_id, stretch, k, columns) the bytes of [A | b], m by m + d doubles.

    shape: (m, d).  ``steps(data)``: (n, m, m) and (n, m, d) doubles for n rows of the columns.
    """
    kind = rows.schema["series_id"].dataType.simpleString()
    names = ["series_id", "stretch", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, series = run, None, None
        for part, data, new, keys in _segments(batches, columns, shape):
            with np.errstate(all="ignore"):
                a, b = combined(*steps(data), np.diff([*new, part.num_rows]))
                series = part["series_id"].type
                done = ([], [], [])
                for i, own in enumerate(keys):
                    if own == key:
                        held = (a[i] @ held[0], a[i] @ held[1] + b[i])
                        continue
                    if key is not run:
                        for c, v in zip(done, (*key, np.hstack(held).tobytes())):
                            c.append(v)
                    key, held = own, (a[i], b[i])
            yield pa.RecordBatch.from_arrays([pa.array(done[0], series), pa.array(done[1], pa.int64()), pa.array(done[2], pa.binary())], names)
        if key is not run:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], series), pa.array([key[1]], pa.int64()), pa.array([np.hstack(held).tobytes()], pa.binary())], names)

    return _dealt(rows, columns).mapInArrow(run, f"series_id {kind}, stretch long, pair binary")


def starts(pairs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(series_id, stretch, start, stop): the state before and after each stretch, row by row; zeros before the first."""
    kind = pairs.schema["series_id"].dataType.simpleString()
    m, d = shape

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("stretch")
        now, before, after = np.zeros((m, d)), [], []
        with np.errstate(all="ignore"):
            for pair in group["pair"].to_pylist():
                pair = np.frombuffer(pair).reshape(m, m + d)
                before.append(now.ravel().tolist())
                now = pair[:, :m] @ now + pair[:, m:]
                after.append(now.ravel().tolist())
        return pa.table([group["series_id"], group["stretch"], pa.array(before, pa.list_(pa.float64())), pa.array(after, pa.list_(pa.float64()))], ["series_id", "stretch", "start", "stop"])

    return pairs.groupBy("series_id").applyInArrow(run, f"series_id {kind}, stretch long, start array<double>, stop array<double>")


def final(rows: DataFrame, columns: list[str], shape: tuple[int, int], steps: Steps, single: bool = False) -> DataFrame:
    """(series_id, value): the state after the last row of each series, from zeros; ``single``: no series has a second stretch."""
    pairs = summaries(rows, columns, shape, steps)
    if not single:
        return starts(pairs, shape).groupBy("series_id").agg(F.max_by("stop", "stretch").alias("value"))
    m, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [np.frombuffer(v).reshape(m, m + d)[:, m:].ravel().tolist() for v in batch["pair"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["series_id"], pa.array(value, pa.list_(pa.float64()))], ["series_id", "value"])

    return pairs.mapInArrow(run, f"series_id {rows.schema['series_id'].dataType.simpleString()}, value array<double>")


def replay(rows: DataFrame, begin: DataFrame | None, columns: list[str], shape: tuple[int, int], steps: Steps, value: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str) -> DataFrame:
    """(series_id, k, value) of every row: ``value(states, data)`` of the states after the rows, each stretch from its ``start`` in
    begin (series_id, stretch, start), or from zeros where there is none."""
    by = rows.schema["series_id"].dataType.simpleString()
    both = rows.select("series_id", "stretch", F.col("k").cast("long").alias("k"), *(F.col(c).cast("double").alias(c) for c in columns), F.lit(None).cast("array<double>").alias("start"))
    if begin is not None:
        # the first row of a stretch, without a k, brings its start along
        both = both.unionByName(begin.select("series_id", "stretch", F.lit(None).cast("long").alias("k"), *(F.lit(None).cast("double").alias(c) for c in columns), "start"))
    m, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = run, None
        for part, data, new, keys in _segments(batches, columns, shape):
            k = part["k"]
            head = np.asarray(k.is_null())
            own = np.zeros((len(keys), m, d))
            for i, (at, pair) in enumerate(zip(new, keys)):
                if head[at]:
                    own[i] = np.reshape(part["start"][at].as_py(), (m, d))
                elif key == pair:
                    own[i] = now
            with np.errstate(all="ignore"):
                a, b = steps(np.where(head[:, None], 0.0, data))
                a[head], b[head] = np.eye(m), 0.0
                out = states(a, b, np.diff([*new, part.num_rows]), own)
                key, now = keys[-1], out[-1]
                keep = np.flatnonzero(~head)
                found = value(out[keep], data[keep])
            yield pa.RecordBatch.from_arrays([part["series_id"].take(pa.array(keep)), k.take(pa.array(keep)), found], ["series_id", "k", "value"])

    return _dealt(both, columns, ("start",)).mapInArrow(run, f"series_id {by}, k long, value {kind}")


def run(rows: DataFrame, columns: list[str], shape: tuple[int, int], steps: Steps, value: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str, single: bool = False) -> DataFrame:
    """(series_id, k, value) of every row of rows (series_id, stretch, k, columns), all series from zeros."""
    begin = None if single else starts(summaries(rows, columns, shape, steps), shape)
    return replay(rows, begin, columns, shape, steps, value, kind)
