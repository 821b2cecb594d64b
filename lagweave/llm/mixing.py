"""Mixing sources to target weights by capped water-filling.

Sources share the words of the whole corpus in proportion to their weights, but none may
repeat its own words more than ``max_epochs`` times: sources above that are clamped and their
excess is shared out again by weight until none is above, each round one sum over the sources.  A source's whole epochs take every document;
its fractional epoch takes documents in a seeded hash order until the words are used up, the
last one in part.  The order is cut with 4,096 hash ranges per source, so no task sorts a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: str) -> Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with ``place``, from 0, in code point order, null last.  They are dealt by range; a task ranks one range."""
    dealt = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "source-ranges")
    # a row for each range
    ranges = dealt.groupBy("part").count().orderBy("part").collect()
    before, start = 0, []
    for r in ranges:
        start.append((r["part"], before))
        before += r["count"]
    starts = sources.sparkSession.createDataFrame(start, "part int, start long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("rank", rank).join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + F.col("rank") - 1).alias("place"))


def targets(sources: DataFrame, max_epochs: int = 3, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size) with ``target`` added.

    Weights repeat over the sources in code point order, null last.  The common level starts at the share of an
    uncapped mix; sources whose cap is below it are clamped and the level of the others rises until no more are.
    """
    if max_epochs < 1 or not weights or min(weights) <= 0:
        raise ValueError("needs one epoch at least and positive weights")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(_ranked(sources).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs)), "source-weights")
    sums = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("rest"), F.count("*").alias("n")).first()
    level, clamped = (sums["total"] / sums["rest"] if sums["n"] else 0.0), 0
    while sums["n"]:
        below = F.col("cap") < F.lit(level) * F.col("w")
        now = s.agg(F.count_if(below).alias("n"), F.sum(F.when(below, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(below, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if now["n"] == clamped:
            break
        clamped, level = now["n"], (sums["total"] - now["cap"]) / now["w"]
    return s.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, weights: Sequence[float] = WEIGHTS, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source and any more columns) with ``size``, ``source_size``, ``target`` and ``taken`` appended.

    size: words of the text (null: 0).  taken: words of the document in the mix, repeats
    counted, at most ``max_epochs`` times its size; a source's taken words add up to its rounded target.
    Reruns agree: the order is md5 of the seed and the id.  A null source is a source of its own; null ids
    and repeated rows are documents like others; sources without words get a target of 0.  Columns of docs
    with the name of an appended one are replaced; all others come back as they are, whatever their names.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c.lower() not in added]
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # the caller's columns travel in a struct, so that no name of theirs can meet one used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col("doc_id").alias("id"), "source", n_words("text").alias("size"), draw.alias("draw"))
    rows = rows.withColumn("part", F.substring("draw", 1, 3))
    parts = materialize(rows.groupBy("source", "part").agg(F.sum("size").alias("n")), "source-parts")
    sized = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), max_epochs, weights)
    quota = F.round("target").cast("long")
    sized = sized.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)))
    sized = materialize(sized.withColumn("more", quota - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of"), "source-quotas")
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = parts.withColumn("upto", F.sum("n").over(running)).join(sized.select("of", "more"), F.col("source").eqNullSafe(F.col("of")))
    # of each source one hash range, or none, is used in part, and those before it whole
    partly = (F.col("more") > F.col("upto") - F.col("n")) & (F.col("more") < F.col("upto"))
    cuts = upto.groupBy(F.col("of").alias("source_cut")).agg(
        F.min(F.when(partly, F.col("part"))).alias("cut"), F.min(F.when(partly, F.col("more") - F.col("upto") + F.col("n"))).alias("left_over"), F.max(F.when(F.col("upto") <= F.col("more"), F.col("part"))).alias("full")
    )
    sized = materialize(sized.join(cuts, F.col("of").eqNullSafe(F.col("source_cut"))).drop("source_cut"), "source-cuts")
    few = F.broadcast(sized) if sized.count() <= 100_000 else sized  # about 60 bytes a source
    joined = rows.join(few, F.col("source").eqNullSafe(F.col("of")))
    extra = F.when(F.col("part") <= F.col("full"), F.col("size")).otherwise(F.lit(0))
    plain = joined.where("cut is null or part <> cut").withColumn("extra", extra)
    order = Window.partitionBy("source", "part").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = joined.where("part = cut").withColumn("upto", F.sum("size").over(order))
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left_over") - F.col("upto") + F.col("size")))).drop("upto")
    taken = (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken")
    return plain.unionByName(cut).select(*(F.col("doc").getField(c).alias(c) for c in keep), "size", "source_size", "target", taken)
