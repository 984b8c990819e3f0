"""Cutting lineage in loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="seriesloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one (as in tests) gets a temporary folder, any other
    an error, as its executors would share none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder, without the estimate of its size.

    A checkpoint keeps the estimate, which is a product at every join.  In a loop that joins a table with itself it has
    some four times the digits each round, and soon fills the driver.  Without one, joins follow the sizes met at run time.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    rows = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)
