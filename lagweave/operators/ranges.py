"""Running sums over an order that no task holds: ranges of it are summed on their own and carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Rows of a small side up to which it is broadcast, and copies that a larger one is dealt in.
FEW = 100_000
COPIES = 16


def attach(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of ``small``, which has one row of a few numbers for each value of ``on``.

    Beyond ``FEW`` rows it is joined in copies, so that a value which holds most of the rows is spread over tasks.
    """
    if small.count() <= FEW:
        return rows.join(F.broadcast(small), on)
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    salted = rows.withColumn("_copy", F.floor(F.rand(7) * COPIES).cast("int"))
    return salted.join(copies, [*on, "_copy"]).drop("_copy")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], name: str = "ranges") -> DataFrame:
    """rows with a column for each of ``sums``: its total over the rows of the same ``by`` up to this one, itself included, in
    ascending ``order``, which should tell all rows apart."""
    # written, so that totals and running sums see the same ranges
    dealt = materialize(rows.select("*", *(v.alias(f"_{c}") for c, v in sums.items())).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), name)
    each = dealt.groupBy(*by, "_part").agg(*(F.sum(f"_{c}").alias(f"_{c}_all") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*by, "_part", *(F.coalesce(F.sum(f"_{c}_all").over(earlier), F.lit(0)).alias(f"_{c}_before") for c in sums))
    upto = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.select("*", *(F.sum(f"_{c}").over(upto).alias(f"_{c}_upto") for c in sums))
    out = attach(inside, materialize(before, f"{name}-before"), [*by, "_part"])
    return out.select(*rows.columns, *((F.col(f"_{c}_before") + F.col(f"_{c}_upto")).alias(c) for c in sums))
