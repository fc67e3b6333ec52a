"""Weighted Count-Min Sketch as a table of (row, bucket) sums."""

from pyspark.sql import functions as F

from tidegauge.functions.hashing import derived_integer


def buckets(df, key, width, depth, seed):
    """One row per (input row, sketch row) with its bucket, drawn from ``seed:row:key``."""
    return df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn(
        "bucket", (derived_integer(seed, F.concat_ws(":", "row", F.col(key).cast("string"))) % F.lit(width)).cast("bigint")
    )


def build(df, key, weight, width=1024, depth=4, seed=0):
    """Sketch sums. Weights of a key are added first, so a hot key is one row."""
    per_key = df.groupBy(key).agg(F.sum(weight).alias("_w"))
    return buckets(per_key, key, width, depth, seed).groupBy("row", "bucket").agg(
        F.sum("_w").alias("total")
    )


def estimate(keys, sketch, key, width=1024, depth=4, seed=0):
    """Smallest bucket sum of each key; never below the true weight.

    The sketch has at most width x depth rows, so it is broadcast.
    """
    at = buckets(keys.select(key).distinct(), key, width, depth, seed)
    return at.join(F.broadcast(sketch), ["row", "bucket"]).groupBy(key).agg(
        F.min("total").alias("estimate")
    )


def error_report(df, key, weight, width=1024, depth=4, seed=0):
    """Exact weight against estimate per key."""
    exact = df.groupBy(key).agg(F.sum(weight).alias("exact"))
    found = estimate(exact, build(df, key, weight, width, depth, seed), key, width, depth, seed)
    return exact.join(found, key).withColumn("excess", F.col("estimate") - F.col("exact"))
