"""Series as DataFrames (series_id, k, y, x1..xm), k from 1 in each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fold import ordered
from .scratch import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user, y the event's value, by time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.row_number().over(w).cast("long").alias("k"), F.col("value").cast("double").alias("y"))


def _daily(df: DataFrame, day: str, *aggs) -> DataFrame:
    days = df.groupBy(F.col(day).cast("date").alias("day")).agg(*aggs)
    # a row for each day remains: the order is small, whatever the table
    k = F.row_number().over(Window.partitionBy("series_id").orderBy("day")).cast("long")
    return days.withColumn("series_id", F.lit(0).cast("long")).withColumn("k", k).drop("day")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value in millions and number of orders."""
    return _daily(read(spark, sf_dir, "orders"), "o_orderdate", (F.sum("o_totalprice") / 1e6).alias("y"), F.count("*").cast("double").alias("x1")).select("series_id", "k", "y", "x1")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped value, quantity and mean discount."""
    aggs = (F.sum("l_extendedprice") / 1e6).alias("y"), (F.sum("l_quantity") / 1e3).alias("x1"), F.avg("l_discount").alias("x2")
    return _daily(read(spark, sf_dir, "lineitem"), "l_shipdate", *aggs).select("series_id", "k", "y", "x1", "x2")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as series of equal length."""
    e = read(spark, sf_dir, "embeddings")
    v = e.select(F.col(e.columns[0]).alias("series_id"), F.posexplode("embedding").alias("k", "y"))
    return v.select("series_id", (F.col("k") + 1).cast("long").alias("k"), F.col("y").cast("double"))


def index_series(df: DataFrame, order: list[str], series: str | None = None) -> DataFrame:
    """Add k by the given order columns.  Without a series column the frame is one long series: it is
    range-partitioned and each partition counts on from those before it, so nothing meets in one task but the counts."""
    if series:
        return df.withColumn("k", F.row_number().over(Window.partitionBy(series).orderBy(*order)).cast("long"))
    # written, so that counts and ranks see the same ranges
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "series-ranges")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_rank", rank).join(counts.select("_part", before.alias("_before")), "_part").withColumn("k", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def split(series: DataFrame, test_size: float) -> DataFrame:
    """Add ``part``: 'train' for the first int(n (1 - test_size)) samples of each series, else 'test'."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    n = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    part = F.when(F.col("k") <= F.floor(F.col("_n") * (1 - test_size)), "train").otherwise("test")
    return series.join(n, "series_id").select(*series.columns, part.alias("part"))


def decimate(series: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th sample from the first, numbered anew."""
    if step < 1:
        raise ValueError("step must be at least 1")
    return series.where((F.col("k") - 1) % step == 0).withColumn("k", F.expr(f"(k - 1) div {step} + 1"))


def scale(series: DataFrame, columns: list[str], method: str, train: str | None = None) -> DataFrame:
    """Columns scaled by series with statistics of the rows where ``train`` holds: standard, minmax or maxabs; a zero spread leaves the centred value."""
    if method not in ("standard", "minmax", "maxabs"):
        raise ValueError(f"unknown method {method}")
    if method == "minmax":
        # a sum that is computed again may differ in its last bit, which would put the largest value past its own maximum
        series = materialize(series, "unscaled")
    stats = []
    for i, c in enumerate(columns):
        v = F.when(F.expr(train), F.col(c)) if train else F.col(c)
        centre, width = {
            "standard": (F.avg(v), F.stddev_pop(v)),
            "minmax": (F.min(v), F.max(v) - F.min(v)),
            "maxabs": (F.lit(0.0), F.max(F.abs(v))),
        }[method]
        stats += [centre.alias(f"_c{i}"), width.alias(f"_w{i}")]
    # sums by series, joined back: no series has to fit in a task
    joined = series.join(series.groupBy("series_id").agg(*stats), "series_id")
    scaled = {c: ((F.col(c) - F.col(f"_c{i}")) / F.when(F.col(f"_w{i}") == 0, 1.0).otherwise(F.col(f"_w{i}"))).alias(c) for i, c in enumerate(columns)}
    return joined.select(*(scaled.get(c, F.col(c)) for c in series.columns))


def check(series: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and for each column the number of null, NaN and infinite values."""
    bad = []
    for c in columns:
        v = F.col(c)
        bad += [F.count_if(v.isNull()).alias(f"{c}_null"), F.count_if(F.isnan(v)).alias(f"{c}_nan"), F.count_if(F.abs(v) == float("inf")).alias(f"{c}_inf")]
    return series.agg(F.count("*").alias("n"), *bad)


def validate(series: DataFrame, columns: list[str]) -> DataFrame:
    """The series itself, or an error if a value is null, NaN or infinite."""
    found = {k: v for k, v in check(series, columns).first().asDict().items() if k != "n" and v}
    if found:
        raise ValueError(f"not finite: {found}")
    return series


def _driven(spark: SparkSession, n: int, inputs: int, seed: int, sigma: float, colored: bool, n_series: int) -> DataFrame:
    df = spark.range(1, n_series + 1).select(F.col("id").alias("series_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("k"))
    for i in range(inputs):
        df = df.withColumn(f"x{i + 1}", F.rand(seed + i) * 2 - 1)
    df = df.withColumn("nu", F.randn(seed + 99) * sigma)
    w = Window.partitionBy("series_id").orderBy("k")
    return df.withColumn("e", 0.8 * F.lag("nu", 1, 0.0).over(w) + F.col("nu") if colored else F.col("nu"))


def _fold(df: DataFrame, step, inputs: list[str]) -> DataFrame:
    """y = step(y1, y2, x1, x2, ..) + e from the third sample on, for each input its last two values; 0 before."""

    def run(state: dict, k: int, e: float, *x: float) -> float:
        v = step(*state["y"], *(v for pair in zip(*state["x"]) for v in pair)) + e if k > 2 else 0.0
        state["y"] = [v, state["y"][0]]
        state["x"] = [list(x), state["x"][0]]
        return v

    out = ordered(df, ["e", *inputs], lambda e, *x: {"y": [0.0, 0.0], "x": [[0.0] * len(x)] * 2}, run, "double")
    return df.drop("e").join(out, ["series_id", "k"]).select("series_id", "k", *inputs, F.col("value").alias("y"))


def siso(spark: SparkSession, n: int = 1000, sigma: float = 0.0, colored: bool = False, seed: int = 42, n_series: int = 1) -> DataFrame:
    """y = 0.2 y1 + 0.1 y1 x1 + 0.9 x2 + e with x uniform on (-1, 1)."""
    return _fold(_driven(spark, n, 1, seed, sigma, colored, n_series), lambda y1, y2, x1, x2: 0.2 * y1 + 0.1 * y1 * x1 + 0.9 * x2, ["x1"])


def miso(spark: SparkSession, n: int = 1000, sigma: float = 0.0, colored: bool = False, seed: int = 42, n_series: int = 1) -> DataFrame:
    """y = 0.4 y1^2 + 0.1 y1 x1 + 0.6 x2 - 0.3 x1 x2(2) + e with two inputs."""

    def step(y1: float, y2: float, a1: float, a2: float, b1: float, b2: float) -> float:
        return 0.4 * y1 * y1 + 0.1 * y1 * a1 + 0.6 * b1 - 0.3 * a1 * b2

    return _fold(_driven(spark, n, 2, seed, sigma, colored, n_series), step, ["x1", "x2"])
