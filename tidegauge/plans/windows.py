"""Event-time windows and series alignment over the events and lineitem tables."""

import hashlib
import uuid

from pyspark.sql import functions as F

from tidegauge.functions.clock import micros_of, window_end
from tidegauge.functions.numbers import fixed
from tidegauge.operators import counters, logs, windows
from tidegauge.plans.registry import query
from tidegauge.plans.views import ACT, CELLS, COUNTERS, DAY, FEATURES, GRID, PTS, TOTALS, WE
from tidegauge.session import shared_folder
from tidegauge.sources import matrices

HOUR = DAY // 24


@query("T1_right_closed_last_value", f"""
WITH {CELLS} SELECT run, feature, window_end, value FROM cells""")
def right_closed(t):
    return t.cells


@query("T2_undeclared_features", f"""
WITH {PTS} SELECT feature, count(*) AS points, coalesce(feature IN ('{"', '".join(FEATURES)}'), false) AS declared FROM pts GROUP BY feature""")
def undeclared_features(t):
    """Points of every feature in the table, and whether the grids hold that feature."""
    return windows.declared_features(t.points, FEATURES)


@query("T2_dense_window_grid", f"""
WITH {GRID} SELECT run, feature, window_end, value, observed FROM grid""")
def dense(t):
    return t.grid


@query("T3_gauge_last_hourly", f"""
WITH {PTS} SELECT feature, ((t + {HOUR} - 1) // {HOUR}) * {HOUR} AS window_end,
  arg_max(value, t * 100000000::HUGEINT + seq) AS value,
  CAST(count(*) AS BIGINT) AS points
FROM pts WHERE flags = 0 AND isfinite(value) GROUP BY ALL""")
def gauge_last(t):
    p = windows.recorded(t.points).where(F.abs("value") < float("inf"))
    return p.groupBy("feature", window_end(F.col("t"), HOUR).alias("window_end")).agg(
        F.max_by("value", F.struct("t", "seq")).alias("value"),
        F.count(F.lit(1)).alias("points"),
    )


@query("T4_delta_rate", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS value,
  epoch_us(l_shipdate) * 1000 AS t,
  epoch_us(l_shipdate) * 1000 - (CAST(l_quantity AS BIGINT) - 3) * 3600000000000 AS start_t
  FROM lineitem)
SELECT l_orderkey, l_linenumber, t <= start_t AS violation,
  CASE WHEN t > start_t THEN R6(value / (CAST(t - start_t AS DOUBLE) / 1e9)) END AS rate
FROM d""")
def delta(t):
    hours = F.col("l_quantity").cast("bigint") - 3
    p = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"),
        (micros_of("l_shipdate") * 1000).alias("t"),
        (micros_of("l_shipdate") * 1000 - hours * 3_600_000_000_000).alias("start_t"),
    )
    return counters.delta_rate(p, "value").select(
        "l_orderkey", "l_linenumber", "violation", fixed("rate").alias("rate")
    )


@query("T5_cumulative_rate_with_resets", f"""
WITH {COUNTERS}, a AS (
  SELECT *, lag(start_t) OVER w AS ps FROM counters WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
b AS (SELECT *, coalesce(ps <> start_t, false) AS changed,
  sum(CASE WHEN ps <> start_t THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, seq
    ROWS UNBOUNDED PRECEDING) AS seg FROM a),
v AS (SELECT *, lag(total) OVER w AS pv, lag(t) OVER w AS pt FROM b WHERE flags = 0
  WINDOW w AS (PARTITION BY run, seg ORDER BY t, seq)),
r AS (SELECT run, seq, t, CASE WHEN total >= pv THEN
    R9((total - pv) / (CAST(t - pt AS DOUBLE) / 1e9)) END AS rate,
    changed OR coalesce(total < pv, false) AS reset FROM v
  UNION ALL SELECT run, seq, t, NULL, changed FROM b WHERE flags = 1)
SELECT run, seq, rate, reset FROM r""")
def cumulative(t):
    done = counters.cumulative_intervals(t.counters, ["run"], ["total"], ["total"])
    seconds = (F.col("t") - F.col("prev_t")) / F.lit(1e9)
    return done.select(
        "run", "seq", fixed(F.col("d_total") / seconds, 9).alias("rate"), "reset"
    )


@query("T6_histogram_mean_and_count_rate", f"""
WITH {TOTALS}, l AS (SELECT run, t, hist_count - lag(hist_count) OVER w AS dc,
  hist_sum - lag(hist_sum) OVER w AS ds, t - lag(t) OVER w AS dt
  FROM totals WINDOW w AS (PARTITION BY run ORDER BY t))
SELECT run, t, R6(ds / dc) AS mean, R9(dc / (CAST(dt AS DOUBLE) / 1e9)) AS count_rate
FROM l WHERE dc > 0""")
def histogram(t):
    p = t.daily_totals.withColumn("start_t", F.lit(0)).withColumn("flags", F.lit(0))
    done = counters.cumulative_intervals(
        p, ["run"], ["hist_count", "hist_sum"], ["hist_count", "hist_sum"], order=["t"]
    ).where(F.col("emitted") & (F.col("d_hist_count") > 0))
    seconds = (F.col("t") - F.col("prev_t")) / F.lit(1e9)
    return done.select(
        "run", "t",
        fixed(F.col("d_hist_sum") / F.col("d_hist_count")).alias("mean"),
        fixed(F.col("d_hist_count") / seconds, 9).alias("count_rate"),
    )


@query("T7_bounded_forward_fill", f"""
WITH {GRID}, g AS (SELECT *, row_number() OVER w AS rn,
    CAST(((window_end // {DAY}) % 10 = 0) AS INT) AS reset FROM grid
    WINDOW w AS (PARTITION BY run, feature ORDER BY window_end)),
s AS (SELECT *, sum(reset) OVER (PARTITION BY run, feature ORDER BY window_end
    ROWS UNBOUNDED PRECEDING) AS seg FROM g),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS lv,
  max(CASE WHEN observed THEN rn END) OVER w AS seen FROM s
  WINDOW w AS (PARTITION BY run, feature, seg ORDER BY window_end ROWS UNBOUNDED PRECEDING))
SELECT run, feature, window_end,
  CASE WHEN observed OR coalesce(rn - seen <= 2, false) THEN lv END AS filled,
  NOT observed AND coalesce(rn - seen <= 2, false) AS imputed,
  NOT observed AND NOT coalesce(rn - seen <= 2, false) AS violation FROM f""")
def fill(t):
    grid = t.grid.withColumn("reset", F.expr(f"(window_end div {DAY}) % 10 = 0"))
    done = windows.forward_fill(grid, ["run", "feature"], 2, "reset")
    return done.select("run", "feature", "window_end", "filled", "imputed", "violation")


BOUNDS = f"""views AS (SELECT run, t, row_number() OVER (PARTITION BY run ORDER BY t) AS rn,
    count(*) OVER (PARTITION BY run) AS n FROM pts WHERE feature = 'view')"""


def _view_times(t):
    """Per run: first view = start, last = drain end, the others close windows."""
    views = t.points.where("feature = 'view'").select("run", "t")
    edge = views.groupBy("run").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    role = F.when(F.col("t") == F.col("_a"), "start").when(F.col("t") == F.col("_b"), "drain")
    return views.join(edge, "run").select("run", "t", role.otherwise("window").alias("role"))


@query("T8_measured_boundary_placement", f"""
WITH {PTS}, {BOUNDS}, b AS (
  SELECT run, t AS e, lag(t) OVER (PARTITION BY run ORDER BY t) AS p, rn - 2 AS i, rn, n FROM views),
lim AS (SELECT run, min(e) AS a, max(e) FILTER (rn < n) AS last_end, max(e) AS z FROM b GROUP BY run),
r AS (SELECT run, seq, t FROM pts WHERE feature = 'error')
SELECT r.run, r.seq, CASE WHEN NOT coalesce(r.t BETWEEN l.a AND l.z, false) THEN 'outside'
    WHEN r.t > l.last_end THEN 'drain' ELSE 'placed' END AS status,
  CASE WHEN r.t = l.a THEN 0 ELSE b.i END AS "window"
FROM r LEFT JOIN lim l USING (run)
LEFT JOIN b ON b.run = r.run AND r.t > b.p AND r.t <= b.e AND b.rn > 1 AND b.rn < b.n""")
def measured(t):
    errors = t.points.where("feature = 'error'").select("run", "seq", "t")
    return windows.place_by_boundaries(errors, _view_times(t)).select("run", "seq", "status", "window")


@query("T9_declared_index_placement", """
SELECT conv_id, turn, CASE WHEN turn BETWEEN 0 AND 5 THEN turn END AS "window",
  NOT turn BETWEEN 0 AND 5 AS violation FROM conversations""")
def declared(t):
    rows = t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("raw"))
    return windows.assign_index(rows, "raw", 6).select("conv_id", "turn", "window", "violation")


LOG_SPEC = [
    ("errors", {"event_type": "error"}, None),
    ("clicks", {"event_type": "click"}, None),
    ("severe", {}, 17),
    ("severe_views", {"event_type": "view"}, 17),
]

LOGS_SQL = f"""logs AS (SELECT run, feature AS event_type, {WE} AS window_end,
  k % 24 + 1 AS severity FROM pts),
hits AS (SELECT run, window_end, 'errors' AS feature FROM logs WHERE event_type = 'error'
  UNION ALL SELECT run, window_end, 'clicks' FROM logs WHERE event_type = 'click'
  UNION ALL SELECT run, window_end, 'severe' FROM logs WHERE severity >= 17
  UNION ALL SELECT run, window_end, 'severe_views' FROM logs
    WHERE severity >= 17 AND event_type = 'view')"""


def _logs(t):
    return t.points.select(
        "run", "seq",
        F.create_map(F.lit("event_type"), F.col("feature")).alias("attributes"),
        (F.col("k") % 24 + 1).alias("severity"),
        window_end(F.col("t"), DAY).alias("window_end"),
    )


@query("T10_dense_log_counts", f"""
WITH {PTS}, {LOGS_SQL}, lims AS (SELECT run, min(window_end) AS lo, max(window_end) AS hi
  FROM logs GROUP BY run),
ends AS (SELECT run, unnest(range(lo, hi + 1, {DAY})) AS window_end FROM lims)
SELECT e.run, e.window_end, f.feature, CAST(count(h.run) AS BIGINT) AS n
FROM ends e CROSS JOIN (VALUES ('errors'), ('clicks'), ('severe'), ('severe_views')) f(feature)
LEFT JOIN hits h ON h.run = e.run AND h.window_end = e.window_end AND h.feature = f.feature
GROUP BY ALL""")
def log_counts(t):
    records = _logs(t)
    spec = logs.feature_spec(t.spark, LOG_SPEC)
    return logs.dense_counts(records, spec, DAY)


@query("T10_log_match_totals", f"""
WITH {PTS}, {LOGS_SQL}
SELECT CAST(count(*) AS BIGINT) AS record_count,
  CAST(count(*) FILTER (event_type IN ('error', 'click') OR severity >= 17) AS BIGINT) AS matched,
  CAST(count(*) FILTER (NOT (event_type IN ('error', 'click') OR severity >= 17)) AS BIGINT) AS unmatched
FROM logs""")
def log_totals(t):
    return logs.match_totals(_logs(t), logs.feature_spec(t.spark, LOG_SPEC))


@query("T11_boundary_extraction", f"""
WITH {PTS}, {BOUNDS} SELECT run, rn - 2 AS i, t AS "end",
  lag(t) OVER (PARTITION BY run ORDER BY t) AS prev_end FROM views QUALIFY rn > 1 AND rn < n""")
def boundaries(t):
    return windows.window_boundaries(_view_times(t))


@query("T11_boundary_violations", f"""
WITH {PTS}, m AS (SELECT run, t, CASE WHEN feature = 'view' THEN 'drain' ELSE 'window' END AS role
  FROM pts)
SELECT run, CAST(count(*) FILTER (roles > 1) AS BIGINT) AS ambiguous_times,
  CAST(sum(drains) AS BIGINT) AS drains FROM (
  SELECT run, t, count(DISTINCT role) AS roles, count(*) FILTER (role = 'drain') AS drains
  FROM m GROUP BY ALL) GROUP BY run HAVING count(*) FILTER (roles > 1) > 0 OR sum(drains) > 1""")
def boundary_errors(t):
    role = F.when(F.col("feature") == "view", "drain").otherwise("window")
    return windows.boundary_violations(
        t.points.select("run", "t", role.alias("role"))
    )


@query("T12_trace_placement", """
WITH tr AS (SELECT conv_id AS trace, max(turn * 7 + len(text) % 5) AS last_end
  FROM conversations GROUP BY 1)
SELECT trace, last_end, CASE WHEN last_end <= 30 THEN ((last_end + 4) // 5) - 1 END AS "window",
  CASE WHEN last_end > 30 THEN 'drain' ELSE 'placed' END AS status FROM tr""")
def trace_placement(t):
    end = F.col("turn") * 7 + F.length("text") % 5
    traces = t.conversations.groupBy(F.col("conv_id").alias("trace")).agg(
        F.max(end).alias("last_end")
    )
    placed = F.col("last_end") <= 30
    return traces.select(
        "trace", F.col("last_end").cast("bigint").alias("last_end"),
        F.when(placed, F.expr("(last_end + 4) div 5 - 1")).alias("window"),
        F.when(placed, "placed").otherwise("drain").alias("status"),
    )


@query("T13_quality_counters", f"""
WITH {GRID} SELECT (SELECT count(*) FROM pts WHERE flags = 1) AS flagged_points,
  count(*) AS cells, count(*) FILTER (NOT observed) AS missing_cells FROM grid""")
def quality(t):
    flagged = t.points.agg(F.count_if(F.col("flags") == 1).alias("flagged_points"))
    cells = t.grid.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("observed")).alias("missing_cells")
    )
    return flagged.crossJoin(cells)


@query("T13_reset_windows", f"""
WITH {COUNTERS}, a AS (
  SELECT *, lag(start_t) OVER w AS ps FROM counters WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
b AS (SELECT *, coalesce(ps <> start_t, false) AS changed,
  sum(CASE WHEN ps <> start_t THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, seq
    ROWS UNBOUNDED PRECEDING) AS seg FROM a),
v AS (SELECT *, lag(total) OVER (PARTITION BY run, seg ORDER BY t, seq) AS pv FROM b WHERE flags = 0),
r AS (SELECT run, t FROM v WHERE total < pv UNION ALL SELECT run, t FROM b WHERE changed)
SELECT run, {WE} AS window_end FROM r GROUP BY ALL""")
def reset_windows(t):
    done = counters.cumulative_intervals(t.counters, ["run"], ["total"], ["total"])
    return done.where("reset").select(
        "run", window_end(F.col("t"), DAY).alias("window_end")
    ).distinct()


@query("T14_temporal_pooling", f"""
WITH {ACT} SELECT run, feature, i // 7 AS block, R6(avg(value)) AS pooled,
  CAST(count(*) AS BIGINT) AS steps FROM act GROUP BY ALL""")
def pooled(t):
    return windows.pool_blocks(t.activity, ["run", "feature"], 7).select(
        "run", "feature", "block", fixed("pooled").alias("pooled"), "steps"
    )


@query("S9_complete_aligned_series", f"""
WITH {PTS}, d AS (SELECT run, feature, t // {10 * DAY} AS slot, value, flags FROM pts),
m AS (SELECT run, feature, count(*) AS points, count(DISTINCT slot) AS times,
  count(*) FILTER (flags = 1) AS missing FROM d GROUP BY ALL)
SELECT run, feature, points FROM m WHERE times = 4 AND missing = 0""")
def complete_series(t):
    d = t.points.withColumn("slot", F.expr(f"t div {10 * DAY}"))
    m = d.groupBy("run", "feature").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("slot").alias("times"),
        F.count_if(F.col("flags") == 1).alias("missing"),
    )
    return m.where("times = 4 AND missing = 0").select("run", "feature", "points")


@query("S9_missing_required_series", f"""
WITH {PTS}, m AS (SELECT run, feature, count(*) FILTER (flags = 1) AS missing FROM pts GROUP BY ALL)
SELECT r.run, f.feature FROM (SELECT DISTINCT run FROM pts) r
CROSS JOIN (SELECT DISTINCT feature FROM pts) f
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run = r.run AND m.feature = f.feature AND missing = 0)""")
def missing_series(t):
    have = (
        t.points.groupBy("run", "feature")
        .agg(F.count_if(F.col("flags") == 1).alias("missing")).where("missing = 0")
    )
    need = t.points.select("run").distinct().crossJoin(t.points.select("feature").distinct())
    return need.join(have, ["run", "feature"], "left_anti")


@query("S10_compiled_matrix_export", f"""
WITH {GRID} SELECT run, window_end, CAST(count(*) AS BIGINT) AS features,
  CAST(count(value) AS BIGINT) AS observed, R4(coalesce(sum(value), 0)) AS total
FROM grid GROUP BY ALL""")
def compiled_matrix(t):
    return t.grid.groupBy("run", "window_end").agg(
        F.count(F.lit(1)).alias("features"), F.count("value").alias("observed"),
        fixed(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"),
    )


def rate_cells(t):
    """Last emitted counter rate and reset mark per (run, day)."""
    done = counters.cumulative_intervals(t.counters, ["run"], ["total"], ["total"])
    rate = fixed(F.col("d_total") / ((F.col("t") - F.col("prev_t")) / F.lit(1e9)), 9)
    rows = done.withColumns({"window_end": window_end(F.col("t"), DAY), "rate": F.when(F.col("emitted"), rate)})
    return rows.groupBy("run", "window_end").agg(
        F.max_by("rate", F.when(F.col("rate").isNotNull(), F.struct("t", "seq"))).alias("value"), F.bool_or("reset").alias("reset")
    )


@query("S10_compiled_matrix_round_trip", f"""
WITH {GRID}, counters AS (
  SELECT run, t, seq, flags, CAST(sum(k) OVER (PARTITION BY run, t // {7 * DAY} ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total,
         (t // {10 * DAY}) * {10 * DAY} AS start_t FROM pts),
a AS (SELECT *, lag(start_t) OVER w AS ps FROM counters WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
b AS (SELECT *, coalesce(ps <> start_t, false) AS changed,
  sum(CASE WHEN ps <> start_t THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg FROM a),
v AS (SELECT *, lag(total) OVER w AS pv, lag(t) OVER w AS pt FROM b WHERE flags = 0 WINDOW w AS (PARTITION BY run, seg ORDER BY t, seq)),
r AS (SELECT run, seq, t, CASE WHEN total >= pv THEN R9((total - pv) / (CAST(t - pt AS DOUBLE) / 1e9)) END AS rate,
    changed OR coalesce(total < pv, false) AS reset FROM v UNION ALL SELECT run, seq, t, NULL, changed FROM b WHERE flags = 1),
rates AS (SELECT run, {WE} AS window_end, arg_max(rate, t * 100000000::HUGEINT + seq) FILTER (rate IS NOT NULL AND isfinite(rate)) AS value, bool_or(reset) AS reset FROM r GROUP BY ALL),
m AS (SELECT run, window_end, feature, value, false AS reset FROM grid
  UNION ALL SELECT w.run, w.window_end, 'rate', value, coalesce(reset, false) FROM (SELECT DISTINCT run, window_end FROM grid) w LEFT JOIN rates USING (run, window_end))
SELECT run, feature, count(*) AS windows, count(value) AS observed, count(*) FILTER (reset) AS resets, R4(coalesce(sum(value), 0)) AS total,
  sha256('click,error,purchase,signup,view,rate') AS schema_id FROM m GROUP BY run, feature""")
def matrix_round_trip(t):
    """A compiled matrix of gauges and a counter rate, written, checked on loading and summed from what was read."""
    gauges = t.grid.select("run", "window_end", "feature", "value", F.lit(False).alias("reset"))
    places = t.grid.select("run", "window_end").distinct()
    rates = places.join(rate_cells(t), ["run", "window_end"], "left").select("run", "window_end", F.lit("rate").alias("feature"), "value", "reset")
    folder = f"{shared_folder(t.spark)}/tidegauge/matrix-{uuid.uuid4().hex}"
    names = [*FEATURES, "rate"]
    matrices.write(gauges.unionByName(rates), folder, names, hashlib.sha256(t.folder.encode()).hexdigest())
    cells, about = matrices.read(t.spark, folder)
    return cells.groupBy("run", "feature").agg(
        F.count(F.lit(1)).alias("windows"), F.count("value").alias("observed"), F.count_if("reset").alias("resets"),
        fixed(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.lit(about.schema_id).alias("schema_id"),
    )
