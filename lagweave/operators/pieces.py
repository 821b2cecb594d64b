"""Work on all pairs of a short series' samples, in pieces.

A method that compares every sample with every other costs the square of the series' length
whatever the engine; here each series is packed once and its samples are dealt in pieces, so that
the pieces of all series run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a packed series may have; the work grows with their square.
MOST = 50_000


def in_pieces(rows: DataFrame, columns: list[str], work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[dict]], schema: str, size: int = 64, most: int = MOST) -> DataFrame:
    """(series_id, ..): what ``work(k, data, piece)`` yields for every piece of every series.

    data: the columns of the whole series as a matrix ordered by ``k``; piece: places in it.  A series
    over ``most`` samples is an error.
    """
    by = rows.schema["series_id"].dataType.simpleString()
    item = F.struct(F.col("k").cast("long").alias("k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    count = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    worst = count.agg(F.max("n")).first()[0] or 0
    if worst > most:
        raise ValueError(f"a series has {worst} samples; a method on all their pairs takes {most} at most")
    packed = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    packed = packed.select("series_id", F.col("r.k").alias("k"), F.flatten("r.v").alias("v"))
    dealt = count.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(size).cast("long"))).alias("start"))
    joined = dealt.repartition("series_id", "start").join(packed, "series_id")
    names = ["series_id", *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (s, start) in enumerate(zip(batch["series_id"].to_pylist(), batch["start"].to_pylist())):
                k = batch["k"][i].values.to_numpy(zero_copy_only=False)
                data = batch["v"][i].values.to_numpy(zero_copy_only=False).reshape(len(k), len(columns))
                for out in work(k, data, np.arange(start, min(start + size, len(k)))):
                    n = len(next(iter(out.values())))
                    yield pa.RecordBatch.from_arrays([pa.array([s] * n, batch.schema.field("series_id").type), *(pa.array(x) for x in out.values())], names)

    return joined.mapInArrow(run, f"series_id {by}, {schema}")
