"""Shuffle files of finished jobs."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results have been written.

    Spark removes them once the driver has collected the plans that made them, which an idle
    driver may put off for long; a job of many steps would meanwhile hold the files of all.
    The first round lets go of what the Python side held, the second one of what that kept.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
