"""Right-closed windows, templates, scoring and trace sessions on streams."""

from pyspark.sql import functions as F

from tidegauge.functions.clock import window_end
from tidegauge.functions.text import mask_tokens
from tidegauge.operators import sketch


def with_window(points, period, drain):
    """Window end as the event-time column; the watermark is the drain time.

    The whole-number end stays the key: a window function on timestamps is
    left-closed and would misplace points on a border.
    """
    end = window_end(F.col("t"), period)
    return (
        points.withColumn("window_end", end)
        .withColumn("we", F.timestamp_micros(F.expr("window_end div 1000")))
        .withWatermark("we", drain)
    )


def last_in_window(points, keys, period, drain):
    """Last value and count per key and window; rows later than the drain are dropped
    and counted by the engine."""
    return (
        with_window(points, period, drain)
        .groupBy(*keys, "window_end", "we")
        .agg(
            F.max_by("value", F.struct("t", "seq")).alias("value"), F.count(F.lit(1)).alias("n"),
        )
        .drop("we")
    )


def template_counts(bodies, column):
    return bodies.select(mask_tokens(F.col(column)).alias("template")).groupBy("template").agg(
        F.count(F.lit(1)).alias("n")
    )


def sketch_counts(rows, key, weight, width, depth, seed):
    """Sketch cells of a stream: at most width x depth rows of state."""
    return sketch.buckets(rows, key, width, depth, seed).groupBy("row", "bucket").agg(
        F.sum(weight).alias("total")
    )


def score_with(points, fit, threshold):
    """Score each point with a frozen per-feature scaler: a stream-static join."""
    z = (F.col("value") - F.col("location")) / F.col("scale")
    return points.join(F.broadcast(fit), "feature").withColumn("score", F.abs(z)).withColumn(
        "alert", F.col("score") > threshold
    )


def closed_traces(spans, gap, delay, paths=False):
    """One row per trace once it has been quiet for ``gap``: spans, roots, last end.

    With ``paths``, the session also holds its span and parent ids, and tells whether it has one root and no parent
    from outside. That state grows with the spans of one open session, so it is for traces, which are short.
    """
    ts = F.timestamp_micros(F.expr("`end` div 1000"))
    facts = [
        F.count(F.lit(1)).alias("spans"),
        F.sum(F.when(F.col("parent").isNull(), 1).otherwise(0)).alias("roots"),
        F.max("end").alias("last_end"),
    ]
    if paths:
        facts += [F.collect_set("span").alias("_spans"), F.collect_set("parent").alias("_parents")]
    closed = spans.withColumn("ts", ts).withWatermark("ts", delay).groupBy("trace", F.session_window("ts", gap).alias("s")).agg(*facts).drop("s")
    if not paths:
        return closed
    inside = F.size(F.array_except("_parents", "_spans")) == 0
    return closed.withColumn("valid_path", (F.col("roots") == 1) & inside).drop("_spans", "_parents")
