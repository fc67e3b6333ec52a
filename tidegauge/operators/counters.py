"""Delta and cumulative metric streams to per-interval observations."""

from pyspark.sql import functions as F

from tidegauge.operators import skew


def delta_rate(points, value, start="start_t", t="t"):
    """Rate per second of a delta point; a missing or non-positive duration is a violation."""
    seconds = (F.col(t) - F.col(start)) / F.lit(1e9)
    bad = F.coalesce(seconds <= 0, F.lit(True))
    return points.withColumn("violation", bad).withColumn(
        "rate", F.when(~bad, F.col(value) / seconds)
    )


def cumulative_intervals(points, keys, fields, decreasing, order=("t", "seq")):
    """Differences of a cumulative stream against the previous valid point.

    A start-time change against the previous point, flagged or not, begins a new
    segment; a decrease against the previous valid point is a reset too. The point
    after a reset is a baseline only. Whole numbers are differenced as LONG.

    Adds ``prev_t``, ``d_<field>``, ``reset`` and ``emitted``; flagged rows are kept
    for their resets.
    """
    order = list(order)
    by = F.col("t")
    plan = skew.plan_split(points, keys, by)
    start = F.coalesce("start_t", F.lit(0))
    rows = skew.previous(
        points, keys, order, by, {"_ps": start, "_pt": F.col("t")}, plan=plan
    )
    rows = rows.withColumn(
        "_changed", F.coalesce(F.col("_ps") != start, F.lit(False))
    )
    rows = skew.running_sum(
        rows, keys, order, by, {"_seg": F.col("_changed").cast("bigint")}, plan=plan
    )
    valid = F.col("flags").bitwiseAND(1) == 0
    packed = F.when(valid, F.struct("_seg", F.col("t").alias("t"), *fields))
    tie = {"_pv": packed}
    rows = skew.previous_known(rows, keys, order, by, tie, plan=plan)
    same = valid & F.coalesce(F.col("_pv._seg") == F.col("_seg"), F.lit(False))
    drops = F.lit(False)
    for f in decreasing:
        drops = drops | (F.col(f) < F.col("_pv")[f])
    dropped = same & drops
    emitted = same & ~drops
    out = [F.when(emitted, F.col(f) - F.col("_pv")[f]).alias(f"d_{f}") for f in fields]
    return rows.select(
        *points.columns,
        F.when(emitted, F.col("_pv.t")).alias("prev_t"),
        *out,
        (F.col("_changed") | dropped).alias("reset"),
        emitted.alias("emitted"),
        F.coalesce(F.col("_pt") >= F.col("t"), F.lit(False)).alias("time_violation"),
    )
