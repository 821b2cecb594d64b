"""Hard-negative mining by a full sort of the scores of each anchor.

Vectors are quantised to integers, a score is an integer inner product.  The anchors are dealt in blocks
and the rows in blocks, and each pair of blocks is a cell that one task works on: it computes the scores of
the cell, orders them for each anchor by score and then by id, finds each positive's upper limit in that order by
binary search, and reads on from there while the scores reach the lower limit.  What a cell finds first
is merged over the cells of an anchor, which gives the first of all rows, as every cell keeps its own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, materialize

#: Anchors and rows of a cell: what a task holds.
ANCHORS = 1024
ROWS = 16_384
#: Anchors whose scores are held at a time.
STEP = 32


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of rows (vec_id, label, embedding) that have all of them, finite in every component; v: floor(scale * x).

    A vec_id that comes more than once counts once, with its least (label, v).
    """
    item = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    full = rows.where("vec_id is not null and label is not null and embedding is not null").where(whole)
    full = full.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), item.alias("v"))
    return full.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def ordered(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling score, ties by smaller id."""
    return np.lexsort((ids, -scores))


def first_positives(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchor: int, label: int, most: int) -> np.ndarray:
    """Places of the first ``most`` other rows of the anchor's label."""
    same = np.flatnonzero((labels == label) & (ids != anchor))
    return same[ordered(ids[same], score[same])[:most]]


def read_negatives(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, label: int, positives: np.ndarray, low: int, high: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(which positive, places of the first ``most`` rows of other labels with low p <= 100 s <= high p), p the positive's score."""
    order = ordered(ids, score)
    order = order[labels[order] != label]
    falling = -100 * score[order]
    for i, p in enumerate(positives.tolist()):
        start = int(np.searchsorted(falling, -high * p, "left"))
        stop = int(np.searchsorted(falling, -low * p, "right"))
        yield i, order[start : min(stop, start + most)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, in integers beyond."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _cells(rows: DataFrame, anchors: DataFrame, work: Callable, schema: str, sizes: tuple[int, int]) -> DataFrame:
    """What ``work(anchor rows, rows)`` yields for every cell; both are dicts of arrays.  Vectors of another length than the anchors' do not meet them."""
    n_rows, n_anchors = rows.count(), anchors.count()
    across, down = max(1, -(-n_anchors // sizes[0])), max(1, -(-n_rows // sizes[1]))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    extra = [c for c in anchors.columns if c not in rows.columns]
    fields = {c: anchors.schema[c].dataType for c in extra}
    left = anchors.select("*", F.size("v").alias("width"), F.lit(0).cast("byte").alias("role"), block(across, 1).alias("i")).withColumn("j", every(down))
    right = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in fields.items()), F.size("v").alias("width"), F.lit(1).cast("byte").alias("role"), block(down, 2).alias("j")).withColumn("i", every(across))
    both = left.unionByName(right).repartition("i", "j", "width").sortWithinPartitions("i", "j", "width", "role", "vec_id")
    columns = ["i", "j", "width", "role", "vec_id", "label", "v", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["i", "j", "width"]):
            cut = int(np.searchsorted(np.asarray(cell["role"]), 1))
            if 0 < cut < cell.num_rows:
                sides = [{"id": np.asarray(part["vec_id"]), "label": np.asarray(part["label"]), "v": _matrix(part["v"])} | {c: part[c] for c in extra} for part in (cell.slice(0, cut), cell.slice(cut))]
                yield from work(*sides)

    return both.select(*columns).mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, sizes: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding).

    For each anchor (a row where ``is_anchor`` holds, an expression of vec_id and label) its first ``positives`` other rows of its label, and for each of these the first
    ``negatives`` rows of other labels whose score s satisfies low p <= 100 s <= high p, p the positive's score; first: by
    falling score, ties by smaller vec_id.  Rows without an id, a label or a whole finite vector take no part; a repeated vec_id
    counts once; vectors of different lengths do not meet; other columns are ignored; no anchors, no rows.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("needs a positive and a negative at least")
    full = materialize(quantised(rows, scale), "quantised-vectors")
    anchors = full.where(is_anchor)

    def near(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        out = ([], [], [])
        for at in range(0, len(a["id"]), STEP):
            scores = _scores(a["v"][at : at + STEP], b["v"])
            for k, score in enumerate(scores, at):
                some = first_positives(score, b["id"], b["label"], a["id"][k], a["label"][k], positives)
                for x, y in zip(out, (np.full(len(some), a["id"][k]), b["id"][some], score[some])):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor_id", "positive_id", "positive_score"])

    found = _cells(full, anchors, near, "anchor_id long, positive_id long, positive_score long", sizes)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = materialize(found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives), "positives")
    wanted = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_score", "positive_id"))).alias("p"))
    wanted = anchors.join(wanted, "vec_id").select("vec_id", "label", "v", F.col("p.positive_id").alias("p_id"), F.col("p.positive_score").alias("p_score"))

    def hard(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a["id"]), STEP):
            out = ([], [], [], [], [])
            scores = _scores(a["v"][at : at + STEP], b["v"])
            for k, score in enumerate(scores, at):
                p_id, p_score = (np.asarray(a[c][k].values) for c in ("p_id", "p_score"))
                for i, some in read_negatives(score, b["id"], b["label"], a["label"][k], p_score, low, high, negatives):
                    for x, y in zip(out, (np.full(len(some), a["id"][k]), np.full(len(some), p_id[i]), b["id"][some], np.full(len(some), p_score[i]), score[some])):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    out = _cells(full, materialize(wanted, "anchors"), hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", sizes)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
