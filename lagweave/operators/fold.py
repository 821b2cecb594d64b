"""Folds over ordered series: a few numbers of state, carried from batch to batch.

Rows are dealt by series and sorted within the partitions, so a series of any length passes through
one task in constant memory, and series run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(rows: DataFrame, columns: list[str], start: Callable, step: Callable, value: str, last_only: bool = False) -> DataFrame:
    """(series_id, k, value): ``step(state, k, *columns)`` for every row of every series, in order of k, or for its last row.

    ``start(*columns)`` makes the state at the first row of a series; ``value`` is the SQL type of what ``step`` returns.
    """
    by = rows.schema["series_id"].dataType.simpleString()
    rows = rows.select("series_id", F.col("k").cast("long").alias("k"), *columns).repartition("series_id").sortWithinPartitions("series_id", "k")
    names = ["series_id", "k", "value"]
    kind = pa.float64() if value == "double" else pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state, held = run, None, None
        for batch in batches:
            out = ([], [], [])
            for s, k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if s != series:
                    if last_only and held:
                        for c, v in zip(out, held):
                            c.append(v)
                    series, state = s, start(*row)
                held = (s, k, step(state, k, *row))
                if not last_only:
                    for c, v in zip(out, held):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema[0].type), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names)
        if last_only and held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], batch.schema[0].type), pa.array([held[1]], pa.int64()), pa.array([held[2]], kind)], names)

    return rows.mapInArrow(run, f"series_id {by}, k long, value {value}")
