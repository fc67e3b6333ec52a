"""Projections from raw counts and gauges to model features."""

from functools import reduce

from pyspark.sql import Window, functions as F

from tidegauge.functions.numbers import snap_counts

# Raw gauges of an operational window that pass through unchanged.
STATE_GAUGES = [
    "request_latency_ms", "error_rate", "api_inflight_current", "api_inflight_peak",
    "api_concurrency_mean", "queue_depth", "queue_oldest_age_ms", "enqueue_event_age_ms",
    "dequeue_event_age_ms", "queue_residence_mean_ms", "worker_heartbeat_age_s",
    "worker_busy_age_max_ms", "worker_busy_fraction", "worker_processing_latency_ms",
    "redis_enqueue_latency_ms", "redis_enqueue_error_rate", "redis_dequeue_latency_ms",
    "redis_dequeue_error_rate", "postgresql_write_latency_ms",
    "postgresql_write_error_rate", "postgresql_write_event_age_ms",
]

# Raw names that become ratios, and their new names.
DEMAND_RATIOS = {
    "worker_rate": "worker_completion_ratio",
    "db_write_rate": "db_write_completion_ratio",
}
REPLICA_RATIOS = {
    "worker_active_count": "worker_active_ratio",
    "worker_busy_count": "worker_busy_ratio",
}

# Cumulative counters that an operational window differences.
COUNTERS = [
    "api_requests", "api_latency_us", "api_errors", "api_busy_us", "worker_processed",
    "worker_busy_us", "worker_processing_us", "redis_enqueue_count",
    "redis_enqueue_latency_us", "redis_enqueue_errors", "redis_dequeue_count",
    "redis_dequeue_latency_us", "redis_dequeue_errors", "queue_residence_count",
    "queue_residence_us", "postgresql_write_count", "postgresql_write_latency_us",
    "postgresql_write_errors", "database_rows",
]


def condition_on_demand(df, demand, ratios=None):
    """Throughput columns become ratios to demand; demand itself is dropped."""
    ratios = ratios or DEMAND_RATIOS
    kept = [c for c in df.columns if c not in ratios and c != demand]
    return df.select(*kept, *[(F.col(a) / F.col(demand)).alias(b) for a, b in ratios.items()])


def demand_violations(df, demand):
    return df.where(~F.coalesce(F.col(demand) > 0, F.lit(False)))


def remap_affected(df, feature, renames):
    """Rename affected features; those mapped to '' are dropped."""
    new = F.coalesce("_to", feature)
    return (
        df.join(F.broadcast(renames.withColumnRenamed("from", feature)
                            .withColumnRenamed("to", "_to")), feature, "left")
        .withColumn(feature, new).where(new != "").drop("_to")
    )


# Log features as (name, counts added, counts taken off, divisor). A
# divisor that is a count is at least one; ``request_demand`` divides as it is.
LOG_RATIOS = [
    ("checkout_completion_ratio", ["checkout_completed_count"], [], "checkout_accepted_count"),
    ("checkout_backlog_delta_ratio", ["checkout_accepted_count"], ["checkout_completed_count"], "request_demand"),
    ("checkout_rejection_rate", ["checkout_rejected_count"], [], "request_demand"),
    ("application_error_event_rate", ["error_event_count"], [], "request_demand"),
]
RICH_LOG_RATIOS = [
    ("queue_backlog_low_transition_rate", ["queue_backlog_low_transition_count"], [], "request_demand"),
    ("queue_backlog_elevated_transition_rate", ["queue_backlog_elevated_transition_count"], [], "request_demand"),
    ("queue_backlog_high_transition_rate", ["queue_backlog_high_transition_count"], [], "request_demand"),
    ("database_latency_fast_ratio", ["database_latency_fast_count"], [], "checkout_completed_count"),
    ("database_latency_normal_ratio", ["database_latency_normal_count"], [], "checkout_completed_count"),
    ("database_latency_slow_ratio", ["database_latency_slow_count"], [], "checkout_completed_count"),
    ("worker_busy_transition_rate", ["worker_busy_transition_count"], [], "request_demand"),
    ("worker_idle_transition_rate", ["worker_idle_transition_count"], [], "request_demand"),
]
PRESSURE_RATIOS = [
    ("checkout_completion_ratio", ["checkout_completed_count"], [], "checkout_accepted_count"),
    ("checkout_backlog_delta_ratio", ["checkout_accepted_count"], ["checkout_completed_count"], "request_demand"),
    ("checkout_rejection_rate", ["checkout_rejected_count"], [], "request_demand"),
    ("queue_pressure_transition_rate", ["queue_backlog_elevated_transition_count", "queue_backlog_high_transition_count"], [], "request_demand"),
    ("queue_high_transition_rate", ["queue_backlog_high_transition_count"], [], "request_demand"),
    ("postgresql_latency_pressure_ratio", ["postgresql_latency_elevated_count", "postgresql_latency_slow_count"], [], "checkout_completed_count"),
    ("postgresql_slow_or_error_ratio", ["postgresql_latency_slow_count", "postgresql_operation_error_count"], [], "checkout_completed_count"),
    ("worker_activation_rate", ["worker_busy_transition_count"], [], "request_demand"),
    ("redis_latency_pressure_rate", ["redis_latency_elevated_count", "redis_latency_slow_count"], [], "request_demand"),
    ("redis_slow_or_error_rate", ["redis_latency_slow_count", "redis_operation_error_count"], [], "request_demand"),
    ("checkout_queue_wait_pressure_ratio", ["checkout_queue_wait_elevated_count", "checkout_queue_wait_slow_count"], [], "checkout_completed_count"),
    ("checkout_queue_wait_slow_ratio", ["checkout_queue_wait_slow_count"], [], "checkout_completed_count"),
]


def _ratio(added, taken, divisor):
    """Column of one row of a table of log ratios."""
    count = lambda name: snap_counts(F.col(name).cast("double"))
    top = reduce(lambda a, b: a + b, map(count, added))
    top = reduce(lambda a, b: a - b, map(count, taken), top)
    return top / (F.col(divisor) if divisor == "request_demand" else F.greatest(count(divisor), F.lit(1.0)))


def log_residuals(df, rich=False):
    """Demand-residual log features from counts and ``request_demand``."""
    return {name: _ratio(*parts) for name, *parts in LOG_RATIOS + (RICH_LOG_RATIOS if rich else [])}


def dependency_pressure(df):
    """Dependency-pressure log features from counts and ``request_demand``."""
    return {name: _ratio(*parts) for name, *parts in PRESSURE_RATIOS}


def operational_state(df, keys):
    """Raw gauges to state columns; controls stay apart. Adds ``valid``."""
    raw = [*STATE_GAUGES, *DEMAND_RATIOS, *REPLICA_RATIOS]
    demand, replicas = F.col("request_demand"), F.col("worker_replicas")
    ok = (demand > 0) & (replicas >= 1)
    for name in raw:
        ok = ok & (F.col(name) >= 0) & (F.col(name) < float("inf"))
    return df.select(
        *keys, *STATE_GAUGES,
        *[(F.col(a) / demand).alias(b) for a, b in DEMAND_RATIOS.items()],
        *[(F.col(a) / replicas).alias(b) for a, b in REPLICA_RATIOS.items()],
        "request_demand", "worker_replicas", F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def counter_window(snapshots, run, order, period_seconds, replicas):
    """Differences of counter snapshots to per-window rates and means.

    A decreasing counter marks the row ``monotonic = false``.
    """
    w = Window.partitionBy(run).orderBy(order)
    d = {n: F.col(n) - F.lag(n).over(w) for n in COUNTERS}
    rows = snapshots.select(run, order, *[x.alias(n) for n, x in d.items()])
    rows = rows.where(F.col(COUNTERS[0]).isNotNull())
    monotonic = reduce(lambda a, b: a & b, [F.col(n) >= 0 for n in COUNTERS])

    def ratio(top, count, unit=1.0):
        return F.when(F.col(count) != 0, F.col(top) / F.col(count) / unit).otherwise(0.0)

    ms, us = 1_000.0, 1_000_000.0
    return rows.select(
        run, order, monotonic.alias("monotonic"),
        (F.col("api_requests") / period_seconds).alias("request_rate"),
        ratio("api_latency_us", "api_requests", ms).alias("request_latency_ms"),
        ratio("api_errors", "api_requests").alias("error_rate"),
        (F.col("api_busy_us") / (period_seconds * us)).alias("api_concurrency_mean"),
        ratio("queue_residence_us", "queue_residence_count", ms).alias("queue_residence_mean_ms"),
        (F.col("worker_processed") / period_seconds).alias("worker_rate"),
        (F.col("worker_busy_us") / (period_seconds * replicas * us)).alias("worker_busy_fraction"),
        ratio("worker_processing_us", "worker_processed", ms).alias("worker_processing_latency_ms"),
        ratio("redis_enqueue_latency_us", "redis_enqueue_count", ms).alias("redis_enqueue_latency_ms"),
        ratio("redis_enqueue_errors", "redis_enqueue_count").alias("redis_enqueue_error_rate"),
        ratio("redis_dequeue_latency_us", "redis_dequeue_count", ms).alias("redis_dequeue_latency_ms"),
        ratio("redis_dequeue_errors", "redis_dequeue_count").alias("redis_dequeue_error_rate"),
        (F.col("database_rows") / period_seconds).alias("db_write_rate"),
        ratio("postgresql_write_latency_us", "postgresql_write_count", ms)
        .alias("postgresql_write_latency_ms"),
        ratio("postgresql_write_errors", "postgresql_write_count")
        .alias("postgresql_write_error_rate"),
    )


def observable_summary(history):
    """Last, mean of the last four, and last - first of a history array."""
    last = F.element_at(history, -1)
    tail = F.slice(history, F.greatest(F.lit(1), F.size(history) - 3), 4)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return {"last": last, "recent_mean": mean, "change": last - F.element_at(history, 1)}
