"""Session settings shared by tests, bench and tools."""

import atexit
import os
import shutil
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(cpus="8", app="tidegauge"):
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """Folder every executor can read: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Where neither is set, a local session works in a folder of its own beside the
    warehouse, removed at the end; a cluster session is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.conf.get("spark.sql.warehouse.dir"))


@lru_cache(maxsize=1)
def _local_folder(warehouse):
    folder = f"{warehouse.removeprefix('file:')}/work-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)
    return folder


def materialize(df, partition_by=()):
    """Write a table that a job reads several times, and read it back."""
    path = f"{shared_folder(df.sparkSession)}/tidegauge/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
