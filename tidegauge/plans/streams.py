"""Streaming forms on the events and conversations tables; each equals its batch row."""

from pyspark.sql import functions as F

from tidegauge.functions.numbers import fixed
from tidegauge.operators import frames
from tidegauge.plans.registry import query
from tidegauge.plans.sources_plans import folder_for, metric_lines
from tidegauge.plans.views import COUNTERS, DAY, PTS, WE
from tidegauge.session import materialize
from tidegauge.sources import otlp
from tidegauge.streaming import stateful, windows
from tidegauge.streaming.run import drain


def as_stream(t, df, name, files=4, closing=(), late=None):
    """Write a frame slice by slice in time order, and read the slices as micro-batches.

    File sources take files by age, so each slice is written after the one before,
    with as many files as one micro-batch takes. With ``closing`` columns, one more row
    holds in them a time far after all others and moves the watermark past all data.
    Its own window or session stays open, so it is in no result. Rows of ``late`` come after that.
    """
    path = folder_for(t, name)
    df = materialize(df)
    width = max(1, df.rdd.getNumPartitions())
    cuts = df.approxQuantile("t", [j / files for j in range(1, files)], 0.001)
    edges = [None, *[int(c) for c in cuts], None]
    for low, high in zip(edges, edges[1:]):
        part = df
        part = part if low is None else part.where(F.col("t") > low)
        part = part if high is None else part.where((F.col("t") <= high) | (F.col("t").isNull() & F.lit(low is None)))
        part.repartition(width).write.mode("append").parquet(path)
    if closing:
        far = df.agg(F.max("t").alias("t")).where("t IS NOT NULL").select(F.col("t") + 30 * DAY)
        marker = far.toDF("far").select(*[F.when(F.lit(f.name in closing), F.col("far")).cast(f.dataType).alias(f.name) for f in df.schema])
        marker.coalesce(1).write.mode("append").parquet(path)
    if late is not None:
        # Lateness is judged by the watermark of the batch before the last. A micro-batch takes ``width`` files, so
        # with twice as many marker files one of them is two batches ahead of the first late row.
        for _ in range(2 * width - 1):
            marker.coalesce(1).write.mode("append").parquet(path)
        late.repartition(width).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


@query("R1_streaming_otlp_scan", f"""
WITH {PTS} SELECT feature AS metric_name, t, value AS double_value, '"' || run || '"' AS run FROM pts""")
def streaming_scan(t):
    path = folder_for(t, "metrics")
    metric_lines(t).select("value").repartition(4).write.text(path)
    good, _ = otlp.metric_rows(otlp.stream_lines(t.spark, path, maxFilesPerTrigger=2))
    event = good.withColumn("ts", F.timestamp_micros(F.expr("t div 1000"))).withWatermark("ts", "1 hour")
    rows, _ = drain(event.select("metric_name", "t", "double_value", F.col("resource_attributes")["run"].alias("run")))
    return rows


WINDOWS_SQL = f"""
WITH {PTS} SELECT run, feature, {WE} AS window_end, arg_max(value, t * 100000000::HUGEINT + seq) AS value, count(*) AS n
FROM pts WHERE t IS NOT NULL GROUP BY ALL"""


def window_stream(t, late=None):
    points = t.points.select("run", "feature", "t", "seq", "value").where("t IS NOT NULL")
    return as_stream(t, points, "points", closing=("t",), late=late)


@query("R2_streaming_right_closed_windows", WINDOWS_SQL)
def streaming_windows(t):
    rows, _ = drain(windows.last_in_window(window_stream(t), ["run", "feature"], DAY, "1 day"))
    return rows


@query("R2_streaming_late_rows", f"""
WITH {PTS}, w AS (SELECT run, feature, {WE} AS window_end, count(*) AS n FROM pts WHERE t IS NOT NULL GROUP BY ALL)
SELECT (SELECT count(*) FROM w) AS windows, (SELECT sum(n)::BIGINT FROM w) AS points, (SELECT count(*) FROM pts WHERE t IS NOT NULL AND seq % 10 = 0) AS late_rows""")
def streaming_late_rows(t):
    """A tenth of the points arrives once more behind the watermark: no window changes, and each late row is counted.

    The engine's own number counts partial groups; rows are counted as those that came in less those that a window holds.
    """
    again = t.points.select("run", "feature", "t", "seq", "value").where("t IS NOT NULL AND seq % 10 = 0")
    source = window_stream(t, again).observe("arrived", F.count("run").alias("rows"))
    rows, progress = drain(windows.last_in_window(source, ["run", "feature"], DAY, "1 day"))
    arrived = sum(p.observedMetrics["arrived"]["rows"] for p in progress.recentProgress if "arrived" in p.observedMetrics)
    held = F.coalesce(F.sum("n"), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("windows"), held.cast("bigint").alias("points"), (F.lit(arrived) - held).cast("bigint").alias("late_rows"))


@query("R2_streaming_all_windows", WINDOWS_SQL)
def all_streaming_windows(t):
    """The windows of a finished input, those of its last day too."""
    return streaming_windows(t)


@query("R3_streaming_counter_rate", f"""
WITH {COUNTERS}, a AS (
  SELECT *, lag(start_t) OVER w AS ps FROM counters WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
b AS (SELECT *, coalesce(ps <> start_t, false) AS changed,
  sum(CASE WHEN ps <> start_t THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, seq
    ROWS UNBOUNDED PRECEDING) AS seg FROM a),
v AS (SELECT *, lag(total) OVER w AS pv, lag(t) OVER w AS pt FROM b WHERE flags = 0
  WINDOW w AS (PARTITION BY run, seg ORDER BY t, seq)),
r AS (SELECT run, seq, CASE WHEN total >= pv THEN R9((total - pv) / (CAST(t - pt AS DOUBLE) / 1e9)) END AS rate,
    changed OR coalesce(total < pv, false) AS reset FROM v UNION ALL SELECT run, seq, NULL, changed FROM b WHERE flags = 1)
SELECT run, seq, rate, reset FROM r""")
def streaming_counters(t):
    stateful.use_rocksdb(t.spark)
    rows, _ = drain(stateful.counter_rates(as_stream(t, t.counters, "counters")))
    return rows.select("run", "seq", fixed("rate", 9).alias("rate"), "reset")


@query("R4_streaming_latched_cusum", f"""
WITH {PTS}, c AS (SELECT run, seq, t, sum(value - 50) OVER (PARTITION BY run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS c FROM pts),
s AS (SELECT run, seq, t, R4(c - least(0, min(c) OVER (PARTITION BY run ORDER BY t, seq ROWS UNBOUNDED PRECEDING))) AS cusum FROM c),
f AS (SELECT run, arg_min(seq, t) AS first_seq FROM s WHERE cusum > 300 GROUP BY run)
SELECT run, seq, cusum, coalesce(seq = first_seq, false) AS alert FROM s LEFT JOIN f USING (run)""")
def streaming_cusum(t):
    stateful.use_rocksdb(t.spark)
    points = t.points.select("run", "t", "seq", (F.col("value") - 50).alias("increment"))
    rows, _ = drain(stateful.latched_cusum(as_stream(t, points, "evidence"), 300.0))
    return rows.select("run", "seq", fixed("cusum", 4).alias("cusum"), "alert")


@query("R5_streaming_template_counts", f"""
WITH {PTS} SELECT feature || ' by <*>' AS template, count(*) AS n FROM pts GROUP BY 1""")
def streaming_templates(t):
    bodies = t.points.select("t", F.concat_ws(" ", "feature", F.lit("by"), F.col("run").cast("string")).alias("body"))
    rows, _ = drain(windows.template_counts(as_stream(t, bodies, "bodies"), "body"), "update", ["template"])
    return rows


@query("R5_streaming_sketch_cells", f"""
WITH {PTS}, b AS (SELECT r AS row, ('0x' || substr(sha256('5:' || r || ':' || run), 1, 16))::UBIGINT % 256 AS bucket, value FROM pts, range(4) x(r))
SELECT CAST(row AS INT) AS row, CAST(bucket AS BIGINT) AS bucket, R4(sum(value)) AS total FROM b GROUP BY ALL""")
def streaming_sketch(t):
    rows = t.points.select("t", "run", "value")
    out, _ = drain(windows.sketch_counts(as_stream(t, rows, "weights"), "run", "value", 256, 4, 5), "update", ["row", "bucket"])
    return out.select("row", "bucket", fixed("total", 4).alias("total"))


@query("R6_streaming_scoring", f"""
WITH {PTS}, m AS (SELECT feature, median(value) AS loc FROM pts WHERE run % 5 <> 0 GROUP BY feature),
s AS (SELECT feature, any_value(loc) AS loc, 1.4826 * median(abs(value - loc)) AS sc FROM pts JOIN m USING (feature) WHERE run % 5 <> 0 GROUP BY feature)
SELECT seq, R5(abs(value - loc) / sc) AS score, abs(value - loc) / sc > 4 AS alert FROM pts JOIN s USING (feature)""")
def streaming_scoring(t):
    fit = frames.robust_scale(t.points.where("run % 5 <> 0"), ["feature"], "value")
    points = t.points.select("t", "seq", "feature", "value")
    rows, _ = drain(windows.score_with(as_stream(t, points, "scoring"), fit, 4.0))
    return rows.select("seq", fixed("score", 5).alias("score"), "alert")


SESSIONS_SQL = f"""
WITH {PTS}, g AS (SELECT run, t, seq, t - lag(t) OVER (PARTITION BY run ORDER BY t) >= {DAY // 2} OR lag(t) OVER (PARTITION BY run ORDER BY t) IS NULL AS fresh FROM pts WHERE t IS NOT NULL),
s AS (SELECT run, t, seq, sum(fresh::INT) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT run AS trace, count(*) AS spans, max(t) AS last_end"""


def session_spans(t):
    """Points as spans: every third has no parent, the others hang on the span before their own number."""
    parent = F.when(F.col("seq") % 3 > 0, (F.col("seq") - 1).cast("string"))
    points = t.points.where("t IS NOT NULL")
    return points.select("t", F.col("run").alias("trace"), F.col("t").alias("end"), F.col("seq").cast("string").alias("span"), parent.alias("parent"))


@query("R7_streaming_trace_sessions", SESSIONS_SQL + """,
  count(*) FILTER (seq % 3 = 0) AS roots, count(*) FILTER (seq % 3 = 0) = 1 AND count(*) FILTER (seq % 3 > 0 AND (seq - 1) NOT IN (SELECT seq FROM s p WHERE p.run = s.run AND p.s = s.s)) = 0 AS valid_path
FROM s GROUP BY run, s.s""")
def streaming_sessions(t):
    """Sessions of a finished input with their path validity: one root, and every parent is a span of the session."""
    rows, _ = drain(windows.closed_traces(as_stream(t, session_spans(t), "spans", closing=("t", "end")), "12 hours", "1 day", paths=True))
    return rows.select("trace", "spans", "last_end", "roots", "valid_path")


@query("R7_streaming_all_trace_sessions", SESSIONS_SQL + " FROM s GROUP BY run, s.s")
def all_streaming_sessions(t):
    """The sessions of a finished input, those open at its end too."""
    rows, _ = drain(windows.closed_traces(as_stream(t, session_spans(t), "spans", closing=("t", "end")), "12 hours", "1 day"))
    return rows.select("trace", "spans", "last_end")
