"""Run a stream over the files that are there, and read what it wrote."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegauge.session import shared_folder


@contextmanager
def state_partitions(spark):
    """State partitions of a new stream: as configured, but at most twice the cores.

    A state store opens and commits files per partition and batch, so partitions
    beyond the cores cost time and bring none back. A query fixes its number at start.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(stream, mode="append", keys=None):
    """Process all available input and give the written rows as a frame.

    Append goes to a parquet sink; update and complete go through ``foreachBatch``,
    each batch written under its own id, so a replayed batch replaces itself. For
    update mode the last row of each key counts.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
    path = f"{root}/tidegauge/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/out")
    else:
        def save(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

        writer = writer.foreachBatch(save)
    with state_partitions(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/out"), query
    rows = spark.read.schema(StructType(stream.schema.fields + [StructField("batch", LongType())])).parquet(f"{path}/out")
    return latest(rows, keys or [], complete=mode == "complete"), query


def latest(rows, keys, complete):
    if complete:
        top = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(top), "batch").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return best.select(*keys, "v.*")
