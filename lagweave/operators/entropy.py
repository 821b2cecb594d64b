"""Entropic regression of many series, its candidates and permutations dealt out as tasks.

In a round every series that is not done measures each term it may take or drop, and the term that stands out is
tested against permutations.  A measurement and some permutations are a task each, so that one series uses as many tasks as
it has of these; its samples are packed once, and a few copies are dealt with the work.  A test ends after its first
permutations where these already decide it.  The state of the search is a table of one row a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .near import groups
from .pieces import MOST

#: Samples in one row, copies of a series' samples that the work is dealt to, permutations of a task, permutations of the first wave.
PIECE = 1024
COPIES = 16
CHUNK = 8
FIRST = 32
FORWARD, BACKWARD, DONE = range(3)


def _packed(psi: DataFrame, m: int, most: int) -> DataFrame:
    """(series_id, piece, v): the samples in order, some in a row, y and the terms one after the other."""
    worst = psi.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    if worst > most:
        raise ValueError(f"a series has {worst} samples; a method on all their pairs takes {most} at most")
    item = F.struct(F.col("k").cast("long").alias("k"), F.array(F.col("y").cast("double"), *(F.col(f"t{i}").cast("double") for i in range(m))).alias("v"))
    rows = psi.groupBy("series_id", F.expr(f"k div {PIECE}").alias("piece")).agg(F.array_sort(F.collect_list(item)).alias("r"))
    return materialize(rows.select("series_id", "piece", F.flatten(F.col("r.v")).alias("v")), "packed-series")


def _worked(packed: DataFrame, items: DataFrame, m: int, work: Callable) -> DataFrame:
    """items (series_id, item, chosen, phase, term) with ``value``: what ``work(y, t, chosen, phase, term, item)`` gives, an array of doubles."""
    by = packed.schema["series_id"].dataType.simpleString()
    dealt = items.withColumn("cell", F.pmod("item", F.lit(COPIES)).cast("long"))
    needed = dealt.select("series_id", "cell").distinct()
    data = packed.join(needed, "series_id").select("series_id", "cell", F.lit(0).alias("role"), "piece", "v")
    both = data.unionByName(dealt.select("series_id", "cell", F.lit(1).alias("role"), F.col("item").alias("piece"), "chosen", "phase", "term"), allowMissingColumns=True)
    both = both.repartition("series_id", "cell").sortWithinPartitions("series_id", "cell", "role", "piece")
    names = ["series_id", "item", "chosen", "phase", "term", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in groups(batches):
            cut = int(np.searchsorted(np.asarray(rows["role"]), 1))
            data = np.asarray(rows["v"].slice(0, cut).combine_chunks().flatten()).reshape(-1, m + 1)
            part = rows.slice(cut).combine_chunks()
            asked = zip(part["chosen"].to_pylist(), part["phase"].to_pylist(), part["term"].to_pylist(), part["piece"].to_pylist())
            value = [work(data[:, 0], data[:, 1:], *of) for of in asked]
            columns = [part[c].combine_chunks() for c in ("series_id", "piece", "chosen", "phase", "term")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, pa.list_(pa.float64()))], names)

    columns = ["series_id", "cell", "role", "piece", "v", "chosen", "phase", "term"]
    return both.select(*columns).mapInArrow(run, f"series_id {by}, item long, chosen array<int>, phase int, term int, value array<double>")


def _sides(y: np.ndarray, t: np.ndarray, chosen: list[int], phase: int, term: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(fit with the term, fit without it or None): what a measurement compares."""

    def fit(idx: list[int]) -> np.ndarray:
        return t[:, idx] @ np.linalg.lstsq(t[:, idx], y, rcond=None)[0]

    if phase == FORWARD:
        return fit([*chosen, term]), fit(chosen) if chosen else None
    return fit(chosen), fit([i for i in chosen if i != term])


def entropic(psi: DataFrame, m: int, information: Callable, k: int = 2, n_perm: int = 200, quantile: float = 0.99, seed: int = 0, constant: int | None = None, least: float = 0.01, most: int = MOST) -> DataFrame:
    """(series_id, term) as ``robust.entropic`` describes; information(x, y, z, k): that of x and y given z."""
    packed = _packed(psi, m, most)
    free = [j for j in range(m) if j != constant]
    state = packed.select("series_id").distinct().select("series_id", F.expr("cast(array() as array<int>)").alias("chosen"), F.lit(FORWARD).alias("phase"))
    state = materialize(state, "entropic-state")
    # so many permutations at or above the value put the quantile there, whatever the others give
    enough = n_perm - math.floor(quantile * (n_perm - 1))

    def measured(y, t, chosen, phase, term, item):
        x, z = _sides(y, t, chosen, phase, term)
        return [information(x, y, z, k)]

    def permuted(y, t, chosen, phase, term, item):
        x, z = _sides(y, t, chosen, phase, term)
        at = range(item * CHUNK, min((item + 1) * CHUNK, n_perm))
        return [information(np.random.default_rng([seed, i]).permutation(x), y, z, k) for i in at]

    def wave(asked: DataFrame, low: int, high: int) -> DataFrame:
        """Values of the permutations low..high-1 for every series in asked."""
        items = asked.withColumn("item", F.explode(F.sequence(F.lit(low // CHUNK).cast("long"), F.lit((high - 1) // CHUNK).cast("long"))))
        done = _worked(packed, items.select("series_id", "item", "chosen", "phase", "term"), m, permuted)
        return done.select("series_id", F.explode("value").alias("v"))

    all_free = F.array(*(F.lit(j) for j in free))
    first = min(FIRST, n_perm)  # a whole number of chunks, or all
    for _ in range(2 * m + 2):
        # nothing is left to take, or one term only is left to drop
        state = state.withColumn("phase", F.when((F.col("phase") == FORWARD) & (F.size("chosen") >= len(free)), BACKWARD).otherwise(F.col("phase")))
        state = materialize(state.withColumn("phase", F.when((F.col("phase") == BACKWARD) & (F.size("chosen") <= 1), DONE).otherwise(F.col("phase"))), "entropic-state")
        active = state.where(F.col("phase") < DONE)
        if not active.take(1):
            break
        may = F.when(F.col("phase") == FORWARD, F.array_except(all_free, "chosen")).otherwise(F.col("chosen"))
        items = active.withColumn("term", F.explode(may)).withColumn("item", F.col("term").cast("long"))
        found = _worked(packed, items.select("series_id", "item", "chosen", "phase", "term"), m, measured).withColumn("value", F.col("value")[0])
        # the largest gain, or the least loss; the first of equal ones
        order = Window.partitionBy("series_id").orderBy(F.when(F.col("phase") == FORWARD, -F.col("value")).otherwise(F.col("value")), "term")
        asked = found.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "item")
        asked = materialize(asked, "entropic-asked")
        early = materialize(wave(asked, 0, first), "entropic-permuted")
        above = early.join(asked.select("series_id", "value"), "series_id").groupBy("series_id").agg(F.count_if(F.col("v") >= F.col("value")).alias("above"))
        open_ = asked.join(above.where(F.col("above") < enough), "series_id", "left_semi")
        rest = wave(open_, first, n_perm) if first < n_perm else early.limit(0)
        limit = early.join(open_.select("series_id"), "series_id", "left_semi").unionByName(rest).groupBy("series_id").agg(F.percentile("v", F.lit(quantile)).alias("limit"))
        tested = materialize(asked.join(limit, "series_id", "left"), "entropic-tested")
        # without a limit the test ended early: the value does not exceed it
        exceeds = F.coalesce(F.col("value") > F.col("limit"), F.lit(False))
        forward = F.col("phase") == FORWARD
        chosen = F.when(forward & exceeds, F.array_append("chosen", F.col("term"))).when(~forward & ~exceeds, F.array_remove("chosen", F.col("term"))).otherwise(F.col("chosen"))
        phase = F.when(forward, F.when(exceeds, FORWARD).otherwise(BACKWARD)).otherwise(F.when(exceeds, DONE).otherwise(BACKWARD))
        moved = tested.select("series_id", chosen.alias("chosen"), phase.alias("phase"))
        state = state.where(F.col("phase") == DONE).unionByName(moved)
    if constant is not None:

        def weight(y, t, chosen, phase, term, item):
            return [abs(float(np.linalg.lstsq(t[:, [constant, *chosen]], y, rcond=None)[0][0]))]

        items = state.select("series_id", F.lit(0).cast("long").alias("item"), "chosen", "phase", F.lit(constant).alias("term"))
        state = _worked(packed, items, m, weight).select("series_id", F.when(F.col("value")[0] >= least, F.array_append("chosen", F.col("term"))).otherwise(F.col("chosen")).alias("chosen"))
    return state.select("series_id", F.explode("chosen").alias("term"))
