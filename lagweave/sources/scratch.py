"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a local temporary one only for a local master without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-lagweave-"))
    return _LOCAL[0]


def folder(spark: SparkSession) -> str:
    """The folder of this application's tables; nothing else is kept there."""
    return f"{scratch_dir(spark)}/lagweave-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; DataFrames that read them are no longer of use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation past the table.  ``clear`` deletes all tables without a path of their own.
    """
    spark = df.sparkSession
    path = path or f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
