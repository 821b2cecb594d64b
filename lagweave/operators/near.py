"""Nearest neighbours and range counts of a series' samples without comparing all pairs.

The samples of a series are dealt in cells of about equal size, by ranges of the first coordinate and, inside
these, of the second.  The k-th nearest distance is first found inside a sample's own cell, which bounds it; the sample then visits
those other cells whose box lies nearer than that, and the least of all distances found decide.  Counts of
samples within a radius take a cell as a whole where its box lies inside, leave it out where it lies outside, and visit
it otherwise.  Boxes are few, whatever the data: cells grow once there would be over ``BOXES`` of them.

Distances are the largest difference of a coordinate, and all comparisons are those of the differences themselves, so that ties come out as in the definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import digamma
from ..sources.scratch import materialize
from .ranges import attach, running

#: Least samples of a cell; cells of which the boxes are sent to all tasks, (2 d + 2) doubles each; rows compared at a time.
CELL = 1024
BOXES = 1 << 17
STEP = 128


def cells(points: DataFrame, dims: list[str], size: int = CELL) -> DataFrame:
    """points (series_id, k, dims, ..) with ``cell``, numbered from 0 in each series, and ``cells``, how many the series has."""
    count = materialize(points.groupBy("series_id").agg(F.count("*").alias("_n")), "series-counts")
    total = count.agg(F.sum("_n")).first()[0] or 0
    size = max(size, -(-total // BOXES))
    many = count.withColumn("cells", F.ceil(F.col("_n") / size).cast("long"))
    one = attach(points, many, ["series_id"])
    small = one.where("cells = 1").withColumn("cell", F.lit(0).cast("long"))
    large = one.where("cells > 1")
    if not many.where("cells > 1").take(1):
        return small.drop("_n")
    ranked = running(large, ["series_id"], [dims[0], "k"], {"_rank": F.lit(1).cast("long")}, "sample-ranks")
    if len(dims) == 1:
        ranked = ranked.withColumn("cell", F.expr("(_rank - 1) * cells div _n"))
    else:
        # slabs by the first coordinate, cells by the second inside each
        slabs = F.ceil(F.sqrt("cells")).cast("long")
        ranked = ranked.withColumn("_slabs", slabs).withColumn("_slab", F.expr("(_rank - 1) * _slabs div _n"))
        w = Window.partitionBy("series_id", "_slab")
        ranked = ranked.withColumn("_in", F.row_number().over(w.orderBy(dims[1], "k"))).withColumn("_of", F.count("*").over(w))
        per = F.expr("greatest(1, cast(ceil(cells / cast(_slabs as double)) as bigint))")
        ranked = ranked.withColumn("_per", per).withColumn("cell", F.expr("_slab * _per + (_in - 1) * _per div _of"))
    return small.unionByName(ranked.select(*small.columns)).drop("_n")


class _Boxes:
    """Boxes of the series with several cells: by series, (cell, least, largest, samples) as arrays."""

    def __init__(self, dealt: DataFrame, dims: list[str]):
        each = dealt.where("cells > 1").groupBy("series_id", "cell").agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"))
        rows = each.toArrow()  # about 2 x BOXES at most
        self.by: dict = {}
        ids = rows["series_id"].to_pylist()
        cell, n = np.asarray(rows["cell"]), np.asarray(rows["n"])
        low, high = (np.column_stack([np.asarray(rows[f"{x}{i}"]) for i in range(len(dims))]) if len(ids) else np.zeros((0, len(dims))) for x in ("lo", "hi"))
        places: dict = {}
        for i, s in enumerate(ids):
            places.setdefault(s, []).append(i)
        for s, at in places.items():
            self.by[s] = (cell[at], low[at], high[at], n[at])


def _apart(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of every row of x from every box; 0 inside."""
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        v = x[:, d, None]
        np.maximum(out, np.maximum(np.where(low[None, :, d] > v, low[None, :, d] - v, 0.0), np.where(high[None, :, d] < v, v - high[None, :, d], 0.0)), out=out)
    return out


def _farthest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest distance of every row of x from a point of every box."""
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        v = x[:, d, None]
        np.maximum(out, np.maximum(np.abs(high[None, :, d] - v), np.abs(v - low[None, :, d])), out=out)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.abs(x[:, 0, None] - y[None, :, 0])
    for d in range(1, x.shape[1]):
        np.maximum(out, np.abs(x[:, d, None] - y[None, :, d]), out=out)
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, pa.Table]]:
    """(series, cell, rows) of batches sorted by series and cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch["series_id"].dictionary_encode()
        code, names = np.asarray(coded.indices.fill_null(-1)), [*coded.dictionary.to_pylist(), None]
        cell = np.asarray(batch["cell"])
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = (names[code[a]], int(cell[a]))
            if held and now != last:
                yield *last, pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield *last, pa.Table.from_batches(held)


def _matrix(rows: pa.Table, dims: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(rows[c]) for c in dims])


def _by_cell(rows: DataFrame, *last: str) -> DataFrame:
    return rows.repartition("series_id", "cell").sortWithinPartitions("series_id", "cell", *last)


def radius(points: DataFrame, dims: list[str], neighbours: int, size: int = CELL) -> DataFrame:
    """(series_id, k, r): distance of every sample from its ``neighbours``-th nearest other one in its series; infinite if it has fewer."""
    size = max(size, 4 * neighbours)
    kind = points.schema["series_id"].dataType.simpleString()
    item = F.struct(*(F.col(c).cast("double").alias(c) for c in dims))
    dealt = materialize(cells(points.select("series_id", F.col("k").cast("long").alias("k"), item.alias("p")).select("series_id", "k", "p.*"), dims, size), "sample-cells")
    boxes = points.sparkSession.sparkContext.broadcast(_Boxes(dealt, dims).by)
    schema = f"series_id {kind}, cell long, k long, best array<double>, {', '.join(f'{c} double' for c in dims)}, r double"
    names = ["series_id", "cell", "k", "best", *dims, "r"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each sample the least distances in its cell, and a row for each cell it has to visit."""
        for series, cell, rows in groups(batches):
            x, k, ids = _matrix(rows, dims), np.asarray(rows["k"]), rows["series_id"].combine_chunks()
            for a in range(0, len(x), STEP):
                some = x[a : a + STEP]
                d = _distances(some, x)
                d[np.arange(len(some)), np.arange(a, a + len(some))] = np.inf
                kept = min(neighbours, len(x))
                best = np.sort(np.partition(d, kept - 1, axis=1)[:, :kept], axis=1)
                r = best[:, -1] if kept == neighbours else np.full(len(some), np.inf)
                lists = pa.array(best.tolist(), pa.list_(pa.float64()))
                none = [pa.nulls(len(some), pa.float64())] * (len(dims) + 1)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(some)), pa.nulls(len(some), pa.int64()), pa.array(k[a : a + STEP]), lists, *none], names)
                if series in boxes.value:
                    number, low, high, _ = boxes.value[series]
                    reach = np.flatnonzero((number != cell) & (_apart_box(some, r, low, high)))
                    i, j = np.nonzero(_apart(some, low[reach], high[reach]) < r[:, None])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i)), pa.array(number[reach[j]]), pa.array(k[a + i]), pa.nulls(len(i), pa.list_(pa.float64())), *(pa.array(some[i, c]) for c in range(len(dims))), pa.array(r[i])], names)

    found = materialize(_by_cell(dealt, "k").select("series_id", "cell", "k", *dims).mapInArrow(own, schema), "near-in-cells")
    here = dealt.where("cells > 1").select("series_id", "cell", "k", *dims, F.lit(None).cast("double").alias("r"), F.lit(0).alias("role"))
    visits = here.unionByName(found.where("cell is not null").select("series_id", "cell", "k", *dims, "r", F.lit(1).alias("role")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in groups(batches):
            cut = int(np.searchsorted(np.asarray(rows["role"]), 1))
            x, q = _matrix(rows.slice(0, cut), dims), _matrix(rows.slice(cut), dims)
            for a in range(0, len(q), STEP):
                d = _distances(q[a : a + STEP], x)
                kept = min(neighbours, len(x))
                best = np.partition(d, kept - 1, axis=1)[:, :kept]
                part = rows.slice(cut + a, len(best))
                yield pa.RecordBatch.from_arrays([part["series_id"].combine_chunks(), part["k"].combine_chunks(), pa.array(best.tolist(), pa.list_(pa.float64()))], ["series_id", "k", "best"])

    more = _by_cell(visits, "role").select("series_id", "cell", "role", *dims, "k").mapInArrow(visit, f"series_id {kind}, k long, best array<double>")
    every = found.where("cell is null").select("series_id", "k", "best").unionByName(more)
    least = F.array_sort(F.flatten(F.collect_list("best")))
    return every.groupBy("series_id", "k").agg(least.alias("best")).select("series_id", "k", F.coalesce(F.get("best", F.lit(neighbours - 1)), F.lit(float("inf"))).alias("r"))


def _apart_box(x: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which boxes the samples, together and with the largest of their radii, may reach."""
    most = r.max()
    return ((low - x.max(0) <= most) & (x.min(0) - high <= most)).all(1)


def within(points: DataFrame, dims: list[str], size: int = CELL) -> DataFrame:
    """(series_id, k, n): how many samples of its series, itself included, lie nearer to each of points (series_id, k, dims, r) than its r."""
    kind = points.schema["series_id"].dataType.simpleString()
    dealt = materialize(cells(points.select("series_id", "k", *dims, "r"), dims, size), "counted-cells")
    boxes = points.sparkSession.sparkContext.broadcast(_Boxes(dealt, dims).by)
    schema = f"series_id {kind}, cell long, k long, n long, {', '.join(f'{c} double' for c in dims)}, r double"
    names = ["series_id", "cell", "k", "n", *dims, "r"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each sample the sum over the cells inside its radius, and a row for each cell on its edge."""
        for series, _, rows in groups(batches):
            x, k, r, ids = _matrix(rows, dims), np.asarray(rows["k"]), np.asarray(rows["r"]), rows["series_id"].combine_chunks()
            for a in range(0, len(x), STEP):
                some, near = x[a : a + STEP], r[a : a + STEP]
                if series in boxes.value:
                    number, low, high, n = boxes.value[series]
                    reach = np.flatnonzero(_apart_box(some, near, low, high))
                    inside = _farthest(some, low[reach], high[reach]) < near[:, None]
                    total = inside @ n[reach]
                    i, j = np.nonzero(~inside & (_apart(some, low[reach], high[reach]) < near[:, None]))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i)), pa.array(number[reach[j]]), pa.array(k[a + i]), pa.nulls(len(i), pa.int64()), *(pa.array(some[i, c]) for c in range(len(dims))), pa.array(near[i])], names)
                else:
                    total = (_distances(some, x) < near[:, None]).sum(1)
                none = [pa.nulls(len(some), pa.float64())] * (len(dims) + 1)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(some)), pa.nulls(len(some), pa.int64()), pa.array(k[a : a + STEP]), pa.array(total.astype(np.int64)), *none], names)

    found = materialize(_by_cell(dealt, "k").select("series_id", "cell", "k", *dims, "r").mapInArrow(whole, schema), "counted")
    here = dealt.where("cells > 1").select("series_id", "cell", "k", *dims, F.lit(None).cast("double").alias("r"), F.lit(0).alias("role"))
    visits = here.unionByName(found.where("cell is not null").select("series_id", "cell", "k", *dims, "r", F.lit(1).alias("role")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in groups(batches):
            cut = int(np.searchsorted(np.asarray(rows["role"]), 1))
            x, q, r = _matrix(rows.slice(0, cut), dims), _matrix(rows.slice(cut), dims), np.asarray(rows["r"])[cut:]
            for a in range(0, len(q), STEP):
                n = (_distances(q[a : a + STEP], x) < r[a : a + STEP, None]).sum(1)
                part = rows.slice(cut + a, len(n))
                yield pa.RecordBatch.from_arrays([part["series_id"].combine_chunks(), part["k"].combine_chunks(), pa.array(n.astype(np.int64))], ["series_id", "k", "n"])

    more = _by_cell(visits, "role").select("series_id", "cell", "role", *dims, "r", "k").mapInArrow(visit, f"series_id {kind}, k long, n long")
    return found.where("cell is null").select("series_id", "k", "n").unionByName(more).groupBy("series_id", "k").agg(F.sum("n").alias("n"))


def neighbour_counts(rows: DataFrame, columns: list[str], y: list[str], neighbours: int = 2, size: int = CELL) -> DataFrame:
    """(series_id, k, nx, ny): for every sample, how many others of its series lie nearer than its ``neighbours``-th nearest one in x (``columns``)
    and y together, in x alone and in y alone."""
    names = [f"x{i}" for i in range(len(columns))], [f"y{i}" for i in range(len(y))]
    points = rows.select("series_id", F.col("k").cast("long").alias("k"), *(F.col(c).cast("double").alias(n) for c, n in zip([*columns, *y], [*names[0], *names[1]])))
    points = materialize(points, "samples")
    reach = radius(points, [names[1][0], *names[0], *names[1][1:]], neighbours, size)
    both = materialize(points.join(reach, ["series_id", "k"]), "sample-radii")
    nx, ny = (within(both, dims, size).select("series_id", "k", F.greatest(F.col("n") - 1, F.lit(0).cast("long")).alias(n)) for dims, n in zip(names, ("nx", "ny")))
    return nx.join(ny, ["series_id", "k"])


def information(rows: DataFrame, columns: list[str], y: list[str], neighbours: int = 2, size: int = CELL) -> DataFrame:
    """(series_id, value): mutual information of x (``columns``) and y by nearest neighbours, for every series."""
    kind = rows.schema["series_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = digamma(np.asarray(batch["nx"]) + 1.0) + digamma(np.asarray(batch["ny"]) + 1.0)
            yield pa.RecordBatch.from_arrays([batch["series_id"], pa.array(v)], ["series_id", "v"])

    sums = neighbour_counts(rows, columns, y, neighbours, size).mapInArrow(terms, f"series_id {kind}, v double").groupBy("series_id").agg(F.avg("v").alias("v"), F.count("*").alias("n"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = digamma(np.array([float(neighbours)]))[0] + digamma(np.asarray(batch["n"]).astype(float)) - np.asarray(batch["v"])
            yield pa.RecordBatch.from_arrays([batch["series_id"], pa.array(v)], ["series_id", "value"])

    return sums.select("series_id", "n", "v").mapInArrow(close, f"series_id {kind}, value double")


def conditional_information(rows: DataFrame, columns: list[str], y: list[str], given: list[str], neighbours: int = 2, size: int = CELL) -> DataFrame:
    """(series_id, value): I(x; y | z) as I(x; (y, z)) - I(x; z), z the columns ``given``."""
    if not given:
        return information(rows, columns, y, neighbours, size)
    less = information(rows, columns, given, neighbours, size).select("series_id", F.col("value").alias("less"))
    return information(rows, columns, [*y, *given], neighbours, size).join(less, "series_id").select("series_id", (F.col("value") - F.col("less")).alias("value"))
