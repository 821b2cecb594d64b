"""Time the headline queries and fits; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lagweave import catalog
from lagweave.functions.basis import Polynomial
from lagweave.operators import predict
from lagweave.plans import model
from lagweave.sources import series

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["ar2_one_step_rrse", "ar2_one_step", "ar2_n_step", "ar2_free_run", "gram_matrix", "err_round1", "adaptive_lms_ar1", "rls_ar1", "basis_polynomial", "residual_acf", "residual_ccf", "bic_by_order", "frols_terms", "aols_terms", "osf_terms", "oos_terms", "uofr_terms", "group_forecast", "group_frols", "lag_narmax_miso", "narmax_free_run", "simulate_model", "loo_overall_mae"]


def wide_fit(spark: SparkSession, n: int, search: str = "frols") -> None:
    """A search with 10 lags each way, degree 4: 10,626 candidates; forward regression takes ten terms by criterion, the accelerated one ten."""
    data = series.siso(spark, n, sigma=0.05)
    terms = {} if search == "frols" else {"n_terms": 10}
    model.fit(data, model.Spec(10, (10,), basis=Polynomial(4), search=search, n_info_values=10, bucket=max(100, n // int(CPUS)), **terms))


def many_forecasts(spark: SparkSession) -> None:
    """414 series of 900 samples, 24 lags, degree 1: fit each and forecast 48 samples."""
    data = spark.range(414).select(F.col("id").alias("series_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(900).cast("long"))).alias("k"))
    data = data.withColumn("y", F.sin(F.col("k") * 0.2618 + F.col("series_id")) * 10 + F.rand(7) + 20)
    spec = model.Spec(24, (), "NAR", Polynomial(1), n_info_values=25)
    theta = model.coefficients(model.fit_by_series(data, spec), spec)
    predict.forecast(data, spec.columns, spec.candidates, None, 48, theta).write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["ar2_one_step_rrse"](spark, SF_DIR).count()
    times = {}

    def clock(name, work) -> None:
        began = time.time()
        work()
        times[name] = round(time.time() - began, 3)

    for name in NAMES:
        clock(name, lambda: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    clock("frols_10626_terms_n1000", lambda: wide_fit(spark, 1000))
    clock("frols_10626_terms_n25000", lambda: wide_fit(spark, 25_000))
    clock("aols_10626_terms_n25000", lambda: wide_fit(spark, 25_000, "aols"))
    clock("nar24_414_series_forecast48", lambda: many_forecasts(spark))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
