"""Forecast metrics as aggregate columns over y and yhat, so they work with any groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """0/0 is 0, v/0 infinite."""
    zero = F.when(num == 0, 0.0).otherwise(float("inf"))
    return F.when(den == 0, zero).otherwise(num / F.when(den == 0, 1.0).otherwise(den))


def _score(num: Column, den: Column) -> Column:
    """1 - num/den; 1 if both are 0, 0 if only the denominator is."""
    return F.when(den == 0, F.when(num == 0, 1.0).otherwise(0.0)).otherwise(1 - num / F.when(den == 0, 1.0).otherwise(den))


def forecast_error(y: str = "y", p: str = "yhat") -> Column:
    return F.col(y) - F.col(p)


def mean_forecast_error(y: str = "y", p: str = "yhat") -> Column:
    return F.avg(forecast_error(y, p))


def mean_squared_error(y: str = "y", p: str = "yhat") -> Column:
    return F.avg(forecast_error(y, p) * forecast_error(y, p))


def root_mean_squared_error(y: str = "y", p: str = "yhat") -> Column:
    return F.sqrt(mean_squared_error(y, p))


def normalized_root_mean_squared_error(y: str = "y", p: str = "yhat") -> Column:
    return _ratio(root_mean_squared_error(y, p), F.max(y) - F.min(y))


def _sst(y: str) -> Column:
    return F.var_pop(y) * F.count(y)


def _sse(y: str, p: str) -> Column:
    return F.sum(forecast_error(y, p) * forecast_error(y, p))


def root_relative_squared_error(y: str = "y", p: str = "yhat") -> Column:
    return F.sqrt(_ratio(_sse(y, p), _sst(y)))


def mean_absolute_error(y: str = "y", p: str = "yhat") -> Column:
    return F.avg(F.abs(forecast_error(y, p)))


def _log1p(c: str) -> Column:
    """As IEEE has it: NaN below -1, minus infinity at -1."""
    v = F.col(c)
    return F.when(v < -1, float("nan")).when(v == -1, float("-inf")).otherwise(F.log1p(v))


def mean_squared_log_error(y: str = "y", p: str = "yhat") -> Column:
    """NaN for a group with a value below -1, infinite for one that reaches -1; other groups keep their error."""
    d = _log1p(y) - _log1p(p)
    return F.avg(d * d)


def median_absolute_error(y: str = "y", p: str = "yhat") -> Column:
    return F.median(F.abs(forecast_error(y, p)))


def explained_variance_score(y: str = "y", p: str = "yhat") -> Column:
    return _score(F.var_pop(forecast_error(y, p)), F.var_pop(y))


def r2_score(y: str = "y", p: str = "yhat") -> Column:
    return _score(_sse(y, p), _sst(y))


def symmetric_mean_absolute_percentage_error(y: str = "y", p: str = "yhat") -> Column:
    den = F.abs(y) + F.abs(p)
    return F.avg(F.when(den == 0, 0.0).otherwise(200 * F.abs(forecast_error(y, p)) / F.when(den == 0, 1.0).otherwise(den)))


def mean_absolute_scaled_error(train: DataFrame, test: DataFrame, season: int = 1) -> DataFrame:
    """(series_id, mase): MAE on test (series_id, y, yhat) over the mean seasonal step of train (series_id, k, y)."""
    if season < 1:
        raise ValueError("season must be at least 1")
    step = F.abs(F.col("y") - F.lag("y", season).over(Window.partitionBy("series_id").orderBy("k")))
    scale = train.withColumn("s", step).groupBy("series_id").agg(F.avg("s").alias("scale"))
    mae = test.groupBy("series_id").agg(mean_absolute_error().alias("mae"))
    return mae.join(scale, "series_id").select("series_id", _ratio(F.col("mae"), F.col("scale")).alias("mase"))


#: Every metric that is an aggregate of y and yhat.
METRICS = {f.__name__: f for f in (mean_forecast_error, mean_squared_error, root_mean_squared_error, normalized_root_mean_squared_error, root_relative_squared_error, mean_absolute_error, mean_squared_log_error, median_absolute_error, explained_variance_score, r2_score, symmetric_mean_absolute_percentage_error)}
