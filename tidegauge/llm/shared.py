"""Session helpers of this subpackage."""

from __future__ import annotations

import os
import sys
import types
import uuid
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, only a local session gets one, in its checkpoint folder or else its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.startswith("local"):
        root = spark.conf.get("spark.sql.warehouse.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/llm/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table that is read several times, and read it back."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met_by_many(many: DataFrame, one: DataFrame, key: str, salt: str, rows: int, keys: DataFrame) -> DataFrame:
    """Inner join of many rows with a table of one row a key, without a task that holds all rows of a frequent key.

    Keys with more than ``rows`` rows, and more than one in a thousand of all, are salted by the column ``salt``:
    one row of ``one`` is copied for each ``rows`` rows. There are less than a thousand such keys. ``keys`` are the
    rows of ``many``, or a narrower table with the same keys, to be counted.
    """
    sizes = keys.groupBy(key).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c")).first()[0] or 0
    hot = {r[0]: -(-r.c // rows) for r in sizes.where(F.col("c") > max(rows, total // 1000)).collect()}
    if not hot:
        return many.join(one, key)
    of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col(key)), F.lit(1))
    salted = many.withColumn("salt_", F.pmod(F.xxhash64(salt), of).cast("int"))
    copied = one.withColumn("salt_", F.explode(F.sequence(F.lit(0), of - 1)))
    return salted.join(copied, [key, "salt_"]).drop("salt_")


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def kept_by_worker(name: str, make):
    """A value that lives as long as the Python worker, over several tasks."""
    holder = sys.modules.setdefault("llm_worker_state", types.ModuleType("llm_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


class Memory:
    """Values by key in two generations of at most half ``limit`` bytes before one batch's own.

    A full generation becomes the old one, from which keys met again are taken over.
    """

    #: Bytes of an entry besides the letters of its key and value.
    OVERHEAD = 170

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}
        self.size = self.counted = 0

    def missing(self, wanted: set, turn: bool = True) -> set:
        """The wanted keys without a value; all others are in ``now`` until the next turn."""
        if turn:
            self.size += self.OVERHEAD * (len(self.now) - self.counted) + sum(map(len, islice(self.now, self.counted, None)))
            if isinstance(next(iter(self.now.values()), None), bytes):
                self.size += sum(map(len, islice(self.now.values(), self.counted, None)))
            self.counted = len(self.now)
            if 2 * self.size > self.limit:
                self.old, self.now, self.size, self.counted = self.now, {}, 0, 0
        missing = wanted.difference(self.now)
        if self.old:
            # In the time of the smaller side: as a plain argument the dictionary would be walked whole.
            again = self.old.keys() & missing
            self.now.update(zip(again, map(self.old.__getitem__, again), strict=True))
            missing -= again
        return missing


def forget_worker_values() -> None:
    """Free what `kept_by_worker` holds, in a task that needs none of it."""
    sys.modules.pop("llm_worker_state", None)


def vocabulary(path: str) -> str:
    """Place of a vocabulary file: a path, or the name of a public one."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
