"""Session settings that the operators expect."""

from __future__ import annotations

import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; on a cluster, leave master and partitions to spark-submit."""
    b = SparkSession.builder.appName("tarnwood").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("TARNWOOD_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


@contextmanager
def timed(what: str, tell=print):
    """Tell the seconds that a block takes; only Spark actions inside it take time."""
    began = time.perf_counter()
    try:
        yield
    finally:
        tell(f"{what}: {time.perf_counter() - began:.3f} s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
