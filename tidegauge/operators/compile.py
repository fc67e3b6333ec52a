"""OTLP points to compiled windows by a declared feature list."""

from functools import reduce

from pyspark.sql import functions as F

from tidegauge.functions.clock import window_end
from tidegauge.operators import counters

DELTA, CUMULATIVE = 1, 2


def match_features(points, spec):
    """Points with the feature they match; the declared list is folded into one column.

    ``spec``: list of dicts ``name, metric_name, statistic`` and optional
    ``resource`` and ``point`` attribute filters (JSON texts).
    """
    def cond(f):
        c = F.col("metric_name") == f["metric_name"]
        for side, column in (("resource", "resource_attributes"), ("point", "point_attributes")):
            for k, v in sorted(f.get(side, {}).items()):
                c = c & F.coalesce(F.element_at(column, k) == v, F.lit(False))
        return c

    hits = F.array_compact(F.array(*[
        F.when(cond(f), F.struct(F.lit(f["name"]).alias("feature"), F.lit(f["statistic"]).alias("statistic")))
        for f in spec
    ]))
    return points.withColumn("_f", F.explode(hits)).select("*", "_f.feature", "_f.statistic").drop("_f")


def unmatched_features(matched, spec, spark):
    names = spark.createDataFrame([(f["name"],) for f in spec], "feature string")
    return names.join(matched.select("feature").distinct(), "feature", "left_anti")


def shared_streams(matched, run="run"):
    """Features fed by more than one stream identity in a run."""
    identity = F.to_json(F.struct(
        "metric_name", "unit", "kind", "temporality", "monotonic", "scope_name", "scope_version",
        F.to_json("resource_attributes").alias("ra"), F.to_json("point_attributes").alias("pa"),
    ))
    return matched.groupBy(run, "feature").agg(F.count_distinct(identity).alias("streams")).where("streams > 1")


def observations(matched, run="run"):
    """Values and resets at point times: ``run, feature, t, seq, value, reset``."""
    number = F.coalesce(F.col("int_value").cast("double"), F.col("double_value"))
    valid = F.col("flags").bitwiseAND(1) == 0
    base = matched.withColumn("seq", F.coalesce("start_t", F.lit(0)))
    keep = [run, "feature", "t", "seq"]
    none = F.lit(False).alias("reset")
    gauge = base.where((F.col("statistic") == "gauge_last") & valid).select(
        *keep, number.alias("value"), none
    )
    seconds = (F.col("t") - F.col("start_t")) / F.lit(1e9)
    by_delta = {
        "sum_rate": number / seconds,
        "histogram_count_rate": F.col("hist_count") / seconds,
        "histogram_mean": F.col("hist_sum") / F.col("hist_count"),
    }
    value = reduce(
        lambda a, s: F.when(F.col("statistic") == s, by_delta[s]).otherwise(a), by_delta, F.lit(None)
    )
    delta = base.where((F.col("temporality") == DELTA) & (F.col("statistic") != "gauge_last") & valid)
    delta = delta.select(*keep, value.alias("value"), none)
    parts = [gauge, delta]
    cumulative = base.where((F.col("temporality") == CUMULATIVE) & (F.col("statistic") != "gauge_last"))
    for kind in ("int_value", "double_value", "hist"):
        if kind == "hist":
            rows = cumulative.where("kind = 'histogram'")
            fields = ["hist_count", "hist_sum"]
        else:
            rows = cumulative.where(f"kind = 'sum' AND {kind} IS NOT NULL")
            fields = [kind]
        done = counters.cumulative_intervals(
            rows.select(*keep, "statistic", "start_t", "flags", "monotonic", *fields),
            [run, "feature"], fields, fields,
        )
        elapsed = (F.col("t") - F.col("prev_t")) / F.lit(1e9)
        if kind == "hist":
            v = F.when(F.col("statistic") == "histogram_mean", F.col("d_hist_sum") / F.col("d_hist_count")).otherwise(
                F.col("d_hist_count") / elapsed
            )
        else:
            v = F.col(f"d_{kind}") / elapsed
        parts.append(done.where(F.col("emitted") | F.col("reset")).select(
            *keep, F.when(F.col("emitted"), v).alias("value"), "reset"
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def compile_windows(points, spec, period, run="run"):
    """Dense grid with last value, observed and reset marks per (run, window, feature).

    The grid runs from the first to the last window of any matched point.
    """
    matched = match_features(points, spec)
    obs = observations(matched, run).withColumn("window_end", window_end(F.col("t"), period))
    cells = obs.groupBy(run, "feature", "window_end").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("t", "seq"))).alias("value"),
        F.bool_or("reset").alias("reset"),
    )
    ends = matched.groupBy(run).agg(
        F.min(window_end(F.col("t"), period)).alias("_lo"), F.max(window_end(F.col("t"), period)).alias("_hi")
    ).select(run, F.explode(F.sequence("_lo", "_hi", F.lit(period))).alias("window_end"))
    names = F.explode(F.array(*[F.lit(f["name"]) for f in spec])).alias("feature")
    grid = ends.select(run, "window_end", names)
    return grid.join(cells, [run, "feature", "window_end"], "left").select(
        run, "feature", "window_end", "value", F.col("value").isNotNull().alias("observed"),
        F.coalesce("reset", F.lit(False)).alias("reset"),
    )


def quality(compiled, points):
    flagged = points.agg(F.count_if(F.col("flags").bitwiseAND(1) == 1).alias("flagged_points"))
    return flagged.crossJoin(compiled.agg(
        F.count_if("reset").alias("reset_points"), F.count_if(~F.col("observed")).alias("missing_cells")
    ))


