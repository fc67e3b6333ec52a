"""Event-time windows: right-closed, last value wins, missing stays NULL."""

from pyspark.sql import functions as F

from tidegauge.functions.clock import window_end
from tidegauge.operators import skew

NO_RECORDED_VALUE = 1


def recorded(points):
    """Drop points flagged as carrying no value."""
    return points.where(F.col("flags").bitwiseAND(NO_RECORDED_VALUE) == 0)


def last_in_window(points, keys, period, value="value"):
    """Last value per key and right-closed window; later ``seq`` wins a time tie."""
    end = window_end(F.col("t"), period)
    return points.groupBy(*keys, end.alias("window_end")).agg(
        F.max_by(value, F.struct("t", "seq")).alias(value)
    )


def dense_grid(cells, run, feature, period, features, value="value"):
    """Every window from a run's first to its last end, for every declared feature."""
    ends = F.explode(F.sequence("_lo", "_hi", F.lit(period))).alias("window_end")
    spans = cells.groupBy(run).agg(
        F.min("window_end").alias("_lo"), F.max("window_end").alias("_hi")
    )
    grid = spans.select(run, ends).select(run, "window_end", _names(features).alias(feature))
    keys = [run, feature, "window_end"]
    return grid.join(cells.select(*keys, value), keys, "left").withColumn(
        "observed", F.col(value).isNotNull()
    )


def declared_features(points, features):
    """Per feature found: points, and whether it is in the declared list, as only those have a place in its grids."""
    declared = F.coalesce(F.col("feature").isin(*features), F.lit(False))
    return points.groupBy("feature").agg(F.count(F.lit(1)).alias("points")).withColumn("declared", declared)


def _names(features):
    return F.explode(F.array(*[F.lit(f) for f in features]))


def run_steps(points, end, period):
    """Every run with every window of the whole table: ``run, window_end, i``."""
    span = points.agg(F.min(end).alias("_lo"), F.max(end).alias("_hi"))
    ends = F.explode(F.sequence("_lo", "_hi", F.lit(period))).alias("window_end")
    runs = points.select("run").distinct().crossJoin(F.broadcast(span))
    return runs.select("run", "_lo", ends).select(
        "run", "window_end", F.expr(f"(window_end - _lo) div {period}").alias("i")
    )


def dense_activity(points, period, features):
    """Zero-filled event count and summed value per (run, window index, feature).

    ``features`` is the declared feature list. Values are summed as whole cents,
    so the result does not hang on the order of the sum.
    """
    end = window_end(F.col("t"), period)
    cents = F.round(F.col("value") * 100).cast("bigint")
    cells = points.groupBy("run", "feature", end.alias("window_end")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents")
    )
    grid = run_steps(points, end, period).select("*", _names(features).alias("feature"))
    return grid.join(cells, ["run", "feature", "window_end"], "left").select(
        "run", "i", "feature",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        (F.coalesce("cents", F.lit(0)).cast("double") / 100).alias("value"),
    )


def forward_fill(grid, keys, max_gap, reset=None):
    """Bounded forward fill on a dense grid that never crosses a reset.

    Adds ``filled``, ``imputed`` and ``violation`` (missing, and no value within
    ``max_gap`` windows since the last reset). A long series is filled in slots.
    """
    order, by = ["window_end"], F.col("window_end")
    plan = skew.plan_split(grid, keys, by)
    placed = skew.running_count(grid, keys, order, by, "_i", plan=plan)
    known = {"_last": F.when(F.col("observed"), F.col("value")), "_at": F.when(F.col("observed"), F.col("_i"))}
    if reset:
        known["_reset"] = F.when(F.col(reset), F.col("_i"))
    found = skew.last_known(placed, keys, order, by, known, plan=plan)
    near = F.coalesce(F.col("_i") - F.col("_at") <= max_gap, F.lit(False))
    if reset:
        near = near & (F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset")))
    return found.select(
        *grid.columns,
        F.when(F.col("observed") | near, F.col("_last")).alias("filled"),
        (~F.col("observed") & near).alias("imputed"),
        (~F.col("observed") & ~near).alias("violation"),
    )


def assign_index(records, raw, window_count):
    """Declared logical window index: ``window`` when an integer in range, else a violation."""
    index = F.expr(f"try_cast({raw} AS BIGINT)")
    ok = index.between(0, window_count - 1)
    return records.withColumn("window", F.when(ok, index)).withColumn(
        "violation", ~F.coalesce(ok, F.lit(False))
    )


def boundary_spans(metric_times):
    """Start, last window end and drain end of each run."""
    t = F.col("t")
    return metric_times.groupBy("run").agg(
        F.min(F.when(F.col("role") == "start", t)).alias("run_start"),
        F.max(F.when(F.col("role") == "window", t)).alias("last_end"),
        F.max(F.when(F.col("role") == "drain", t)).alias("drain_end"),
    )


def window_boundaries(metric_times):
    """One row per measured window ``(prev_end, end]`` of a run, numbered from 0."""
    ends = metric_times.where("role IN ('start', 'window')").select("run", "t").distinct()
    keys, order, by = ["run"], ["t"], F.col("t")
    plan = skew.plan_split(ends, keys, by)
    rows = skew.previous(ends, keys, order, by, {"prev_end": F.col("t")}, plan=plan)
    rows = skew.running_count(rows, keys, order, by, "_rn", plan=plan)
    return rows.where("prev_end IS NOT NULL").select(
        "run", (F.col("_rn") - 2).alias("i"), F.col("t").alias("end"), "prev_end"
    )


def place_by_boundaries(records, metric_times):
    """Place records into the measured, irregular windows ``(prev_end, end]`` of their run.

    ``metric_times``: run, t, role (start, window or drain). Adds ``window`` and
    ``status``: placed, drain or outside. A record's window is the number of ends
    before it: records and ends are merged in time order and counted in one
    split-safe scan, with no range join and no array of ends per run.
    """
    ends = metric_times.where("role = 'window'").select("run", "t", F.lit(1).alias("_end"))
    merged = records.withColumn("_end", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    counted = skew.running_sum(
        merged, ["run"], ["t", "_end"], F.col("t"), {"_before": F.col("_end").cast("bigint")}
    ).where("_end = 0")
    joined = counted.join(boundary_spans(metric_times), "run", "left")
    t = F.col("t")
    limit = F.coalesce("drain_end", "last_end")
    inside = F.coalesce((t >= F.col("run_start")) & (t <= limit), F.lit(False))
    status = F.when(~inside, "outside").when(t > F.col("last_end"), "drain").otherwise("placed")
    return joined.withColumn("status", status).withColumn(
        "window", F.when(F.col("status") == "placed", F.col("_before").cast("bigint"))
    ).select(*records.columns, "window", "status")


def boundary_violations(metric_times):
    per_time = metric_times.groupBy("run", "t").agg(
        F.count_distinct("role").alias("roles"),
        F.count_if(F.col("role") == "drain").alias("drains"),
    )
    return (
        per_time.groupBy("run")
        .agg(
            F.count_if(F.col("roles") > 1).alias("ambiguous_times"),
            F.sum("drains").alias("drains"),
        )
        .where((F.col("ambiguous_times") > 0) | (F.col("drains") > 1))
    )


def pool_blocks(series, keys, factor, value="value"):
    """Mean over blocks of ``factor`` steps; the last block may be short."""
    return series.groupBy(*keys, F.expr(f"i div {factor}").alias("block")).agg(
        F.avg(value).alias("pooled"), F.count(F.lit(1)).alias("steps")
    )
