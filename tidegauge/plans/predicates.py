"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from tidegauge.functions.attributes import numeric_attribute
from tidegauge.functions.clock import micros_of
from tidegauge.functions.numbers import fixed, snap_counts
from tidegauge.operators import features, frames, logs, skew
from tidegauge.plans.registry import query
from tidegauge.plans.views import ACT, PTS, TOTALS, WIDE
from tidegauge.plans.windows import LOG_SPEC, _logs


def _with_attributes(t):
    return t.events.select(
        "event_id", "event_type", "user_id",
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("event_type"), F.col("event_type")),
        ).alias("attributes"),
    )


@query("P1_attribute_containment", """
SELECT event_id, event_type FROM events
WHERE json_extract_string(props, '$.k') = '30' AND event_type = 'click'""")
def containment(t):
    expected = F.create_map(F.lit("k"), F.lit("30"), F.lit("event_type"), F.lit("click"))
    return _with_attributes(t).where(logs.contains(F.col("attributes"), expected)).select(
        "event_id", "event_type"
    )


FEATURE_SPEC = [
    ("clicks", {"event_type": "click"}), ("k30", {"k": "30"}),
    ("click_k30", {"event_type": "click", "k": "30"}), ("none", {"event_type": "absent"}),
]
SPEC_SQL = """f(feature, et, k) AS (VALUES ('clicks', 'click', NULL), ('k30', NULL, '30'),
  ('click_k30', 'click', '30'), ('none', 'absent', NULL))"""


@query("P2_feature_selection", f"""
WITH {SPEC_SQL} SELECT event_id, feature FROM events JOIN f
ON (et IS NULL OR et = event_type) AND (f.k IS NULL OR f.k = json_extract_string(props, '$.k'))""")
def selection(t):
    spec = t.spark.createDataFrame(FEATURE_SPEC, "feature string, filter map<string,string>")
    points = _with_attributes(t)
    return points.join(
        F.broadcast(spec), logs.contains(F.col("attributes"), F.col("filter"))
    ).select("event_id", "feature")


@query("P2_unmatched_features", f"""
WITH {SPEC_SQL} SELECT feature FROM f WHERE NOT EXISTS (SELECT 1 FROM events
WHERE (et IS NULL OR et = event_type) AND (f.k IS NULL OR f.k = json_extract_string(props, '$.k')))""")
def unmatched(t):
    spec = t.spark.createDataFrame(FEATURE_SPEC, "feature string, filter map<string,string>")
    return spec.select("feature").join(selection(t).select("feature").distinct(), "feature", "left_anti")


@query("P3_single_writer_guard", """
SELECT event_type AS feature, CAST(count(DISTINCT user_id % 7) AS BIGINT) AS streams
FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 7) > 1""")
def single_writer(t):
    identity = F.to_json(F.struct((F.col("user_id") % 7).alias("service"), "event_type"))
    return (
        t.events.select(F.col("event_type").alias("feature"), identity.alias("stream"))
        .groupBy("feature").agg(F.count_distinct("stream").alias("streams"))
        .where("streams > 1")
    )


@query("P4_log_feature_predicate", f"""
WITH {PTS}, l AS (SELECT seq, run, feature AS et, k % 24 + 1 AS sev FROM pts)
SELECT seq, 'errors' AS feature FROM l WHERE et = 'error'
UNION ALL SELECT seq, 'clicks' FROM l WHERE et = 'click'
UNION ALL SELECT seq, 'severe' FROM l WHERE sev >= 17
UNION ALL SELECT seq, 'severe_views' FROM l WHERE sev >= 17 AND et = 'view'""")
def log_predicate(t):
    hits = logs.matched_features(_logs(t), logs.feature_spec(t.spark, LOG_SPEC))
    return hits.select("seq", F.explode("features").alias("feature"))


@query("P5_canonical_order", f"""
WITH {PTS} SELECT seq, row_number() OVER (PARTITION BY run, feature ORDER BY t, seq) AS position
FROM pts""")
def canonical_order(t):
    return skew.running_count(
        t.points, ["run", "feature"], ["t", "seq"], F.col("t"), "position"
    ).select("seq", "position")


def daily_rates(t):
    """Orders (demand) and shipped quantity and lines per day."""
    demand = t.orders.groupBy(micros_of("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("request_rate")
    )
    work = t.lineitem.groupBy(micros_of("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("worker_rate"),
        F.count(F.lit(1)).alias("db_write_rate"),
    )
    return demand.join(work, "day")


RATES = """demand AS (SELECT epoch_us(o_orderdate) AS day, count(*) AS request_rate
  FROM orders GROUP BY 1),
work AS (SELECT epoch_us(l_shipdate) AS day, sum(l_quantity) AS worker_rate,
  count(*) AS db_write_rate FROM lineitem GROUP BY 1),
rates AS (SELECT * FROM demand JOIN work USING (day))"""


@query("P6_demand_conditioning", f"""
WITH {RATES} SELECT day, R6(worker_rate / request_rate) AS worker_completion_ratio,
  R6(db_write_rate / request_rate) AS db_write_completion_ratio FROM rates""")
def conditioned(t):
    out = features.condition_on_demand(daily_rates(t), "request_rate")
    return out.select("day", *[fixed(c).alias(c) for c in out.columns if c != "day"])


@query("P6_demand_violations", f"""
WITH {RATES} SELECT day, CAST(request_rate - 6 AS BIGINT) AS request_rate FROM rates
WHERE request_rate - 6 <= 0""")
def demand_violations(t):
    df = daily_rates(t).select("day", (F.col("request_rate") - 6).alias("request_rate"))
    return features.demand_violations(df, "request_rate")


@query("P7_affected_feature_remap", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'press'
  ELSE event_type END AS event_type FROM events WHERE event_type <> 'signup'""")
def remap(t):
    renames = t.spark.createDataFrame(
        [("view", "impression"), ("click", "press"), ("signup", "")], "from string, to string"
    )
    return features.remap_affected(t.events.select("event_id", "event_type"), "event_type", renames)


# How the five event types stand in for application log counts.
LOG_COUNTS = {
    "checkout_accepted_count": "view", "checkout_completed_count": "click",
    "checkout_rejected_count": "signup", "error_event_count": "error",
    "queue_backlog_low_transition_count": "view",
    "queue_backlog_elevated_transition_count": "click",
    "queue_backlog_high_transition_count": "error",
    "database_latency_fast_count": "view", "database_latency_normal_count": "signup",
    "database_latency_slow_count": "error", "worker_busy_transition_count": "click",
    "worker_idle_transition_count": "signup",
    "postgresql_latency_elevated_count": "view", "postgresql_latency_slow_count": "error",
    "postgresql_operation_error_count": "signup", "redis_latency_elevated_count": "click",
    "redis_latency_slow_count": "error", "redis_operation_error_count": "view",
    "checkout_queue_wait_elevated_count": "signup", "checkout_queue_wait_slow_count": "error",
}


def log_counts(t):
    return t.wide.select(
        "run", "i", (F.col("purchase") + 1).cast("double").alias("request_demand"),
        *[F.col(c).alias(n) for n, c in LOG_COUNTS.items()],
    )


@query("P8_demand_residual_log_features", f"""
WITH {WIDE}, w AS (SELECT *, purchase + 1.0::DOUBLE AS d, greatest(view, 1) AS av,
  greatest(click, 1) AS dn FROM wide)
SELECT run, i, R6(click / av) AS checkout_completion_ratio,
  R6((view - click) / d) AS checkout_backlog_delta_ratio, R6(signup / d) AS checkout_rejection_rate,
  R6(error / d) AS application_error_event_rate,
  R6(view / d) AS queue_backlog_low_transition_rate,
  R6(click / d) AS queue_backlog_elevated_transition_rate,
  R6(error / d) AS queue_backlog_high_transition_rate,
  R6(view / dn) AS database_latency_fast_ratio, R6(signup / dn) AS database_latency_normal_ratio,
  R6(error / dn) AS database_latency_slow_ratio, R6(click / d) AS worker_busy_transition_rate,
  R6(signup / d) AS worker_idle_transition_rate FROM w""")
def log_residuals(t):
    df = log_counts(t)
    out = features.log_residuals(df, rich=True)
    return df.select("run", "i", *[fixed(x).alias(n) for n, x in out.items()])


@query("P9_dependency_pressure_features", f"""
WITH {WIDE}, w AS (SELECT *, purchase + 1.0::DOUBLE AS d, greatest(view, 1) AS av,
  greatest(click, 1) AS dn FROM wide)
SELECT run, i, R6(click / av) AS checkout_completion_ratio,
  R6((view - click) / d) AS checkout_backlog_delta_ratio, R6(signup / d) AS checkout_rejection_rate,
  R6((click + error) / d) AS queue_pressure_transition_rate,
  R6(error / d) AS queue_high_transition_rate,
  R6((view + error) / dn) AS postgresql_latency_pressure_ratio,
  R6((error + signup) / dn) AS postgresql_slow_or_error_ratio,
  R6(click / d) AS worker_activation_rate,
  R6((click + error) / d) AS redis_latency_pressure_rate,
  R6((error + view) / d) AS redis_slow_or_error_rate,
  R6((signup + error) / dn) AS checkout_queue_wait_pressure_ratio,
  R6(error / dn) AS checkout_queue_wait_slow_ratio FROM w""")
def dependency(t):
    df = log_counts(t)
    return df.select(
        "run", "i", *[fixed(x).alias(n) for n, x in features.dependency_pressure(df).items()]
    )


def _gauge(j):
    """Stand-in raw gauge j as text that both engines read."""
    names = ["click", "error", "purchase", "signup", "view"]
    return f"({names[j % 5]} * {j + 1} + {names[(j + 2) % 5]})"


RAW_GAUGES = [*features.STATE_GAUGES, *features.DEMAND_RATIOS, *features.REPLICA_RATIOS]
_STATE_SQL = ", ".join(
    [f"CAST({_gauge(j)} AS DOUBLE) AS {n}" for j, n in enumerate(features.STATE_GAUGES)]
    + [
        f"R6({_gauge(j)} / {by}) AS {out}"
        for j, (out, by) in enumerate(
            [(o, "(purchase + 1)") for o in features.DEMAND_RATIOS.values()]
            + [(o, "(run % 3 + 1)") for o in features.REPLICA_RATIOS.values()],
            start=len(features.STATE_GAUGES),
        )
    ]
)


@query("P10_operational_state", f"""
WITH {WIDE} SELECT run, i, {_STATE_SQL}, CAST(purchase + 1 AS DOUBLE) AS request_demand,
  CAST(run % 3 + 1 AS BIGINT) AS worker_replicas, true AS valid FROM wide""")
def operational_state(t):
    raw = t.wide.select(
        "run", "i", (F.col("purchase") + 1).cast("double").alias("request_demand"),
        (F.col("run") % 3 + 1).alias("worker_replicas"),
        *[F.expr(_gauge(j)).cast("double").alias(n) for j, n in enumerate(RAW_GAUGES)],
    )
    out = features.operational_state(raw, ["run", "i"])
    ratios = [*features.DEMAND_RATIOS.values(), *features.REPLICA_RATIOS.values()]
    return out.withColumns({n: fixed(n) for n in ratios})


def _counter_expr(j, name):
    if name.endswith("_us"):
        return f"(hist_sum * {j + 3})"
    return f"(hist_count // {j})" if name.endswith("_errors") else "hist_count"


_D = {
    n: f"({_counter_expr(j + 2, n)} - lag({_counter_expr(j + 2, n)}) OVER w)"
    for j, n in enumerate(features.COUNTERS)
}


@query("P11_counter_snapshots_to_window", f"""
WITH {TOTALS}, d AS (SELECT run, t, {', '.join(f'{x} AS {n}' for n, x in _D.items())} FROM totals
  WINDOW w AS (PARTITION BY run ORDER BY t))
SELECT run, t, true AS monotonic, R6(api_requests / 2.0) AS request_rate,
  R6(api_latency_us / api_requests / 1000) AS request_latency_ms,
  R6(api_errors / api_requests) AS error_rate, R6(api_busy_us / 2000000.0) AS api_concurrency_mean,
  R6(queue_residence_us / queue_residence_count / 1000) AS queue_residence_mean_ms,
  R6(worker_processed / 2.0) AS worker_rate,
  R6(worker_busy_us / 8000000.0) AS worker_busy_fraction,
  R6(worker_processing_us / worker_processed / 1000) AS worker_processing_latency_ms,
  R6(redis_enqueue_latency_us / redis_enqueue_count / 1000) AS redis_enqueue_latency_ms,
  R6(redis_enqueue_errors / redis_enqueue_count) AS redis_enqueue_error_rate,
  R6(redis_dequeue_latency_us / redis_dequeue_count / 1000) AS redis_dequeue_latency_ms,
  R6(redis_dequeue_errors / redis_dequeue_count) AS redis_dequeue_error_rate,
  R6(database_rows / 2.0) AS db_write_rate,
  R6(postgresql_write_latency_us / postgresql_write_count / 1000) AS postgresql_write_latency_ms,
  R6(postgresql_write_errors / postgresql_write_count) AS postgresql_write_error_rate
FROM d WHERE api_requests IS NOT NULL""")
def counter_window(t):
    snaps = t.daily_totals.select(
        "run", "t",
        *[
            F.expr(_counter_expr(j + 2, n).replace("//", "div")).alias(n)
            for j, n in enumerate(features.COUNTERS)
        ],
    )
    out = features.counter_window(snaps, "run", "t", 2.0, 4)
    plain = {"run", "t", "monotonic"}
    return out.select(*[c if c in plain else fixed(c).alias(c) for c in out.columns])


@query("P12_snap_counts", """
SELECT event_id, CASE WHEN abs(value - round_even(value, 0)) <= 1e-12
  THEN round_even(value, 0) ELSE value END AS snapped FROM events""")
def snapped(t):
    return t.events.select("event_id", snap_counts(F.col("value")).alias("snapped"))


@query("P13_window_subset", f"""
WITH {ACT} SELECT run, i, feature, n, value FROM act
WHERE run IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 70)""")
def subset(t):
    chosen = t.events.groupBy(F.col("user_id").alias("run")).count().where("count > 70")
    return t.activity.join(chosen, "run", "left_semi").select("run", "i", "feature", "n", "value")


@query("P14_observable_summary", f"""
WITH {ACT}, a AS (SELECT run, feature, i, value, lag(value, 1) OVER w AS last,
  lag(value, 6) OVER w AS first,
  (lag(value, 1) OVER w + lag(value, 2) OVER w + lag(value, 3) OVER w + lag(value, 4) OVER w) / 4
    AS recent_mean FROM act WINDOW w AS (PARTITION BY run, feature ORDER BY i))
SELECT run, feature, i, last, R4(recent_mean) AS recent_mean, R4(last - first) AS change
FROM a WHERE first IS NOT NULL""")
def observable(t):
    f = frames.lookback_frames(t.activity, ["run", "feature"], 6)
    out = features.observable_summary(F.col("context"))
    return f.select(
        "run", "feature", "i", out["last"].alias("last"),
        fixed(out["recent_mean"], 4).alias("recent_mean"),
        fixed(out["change"], 4).alias("change"),
    )


@query("X6_numeric_attribute", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, true AS observed
FROM events""")
def numeric(t):
    v = numeric_attribute(F.col("props"), "$.k")
    return t.events.select("event_id", v.alias("value"), v.isNotNull().alias("observed"))
