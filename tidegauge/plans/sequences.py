"""Analytic functions over runs: CUSUM, crossings, labels, p-values, bigrams, roles."""

from pyspark.sql import functions as F

from tidegauge.functions.clock import window_end
from tidegauge.functions.numbers import fixed
from tidegauge.operators import alerts, sequences, skew
from tidegauge.plans.registry import query
from tidegauge.plans.views import DAY, PTS, SCORES, WE

# Treatment runs are odd; each has one active interval.
ONSET = "8 + run % 5"
STOP = "12 + run % 5 + run % 3"


def active():
    i, run = F.col("i"), F.col("run")
    return (run % 2 == 1) & (i >= 8 + run % 5) & (i < 12 + run % 5 + run % 3)


@query("F1_resettable_cusum", f"""
WITH {PTS}, c AS (SELECT run, seq, t, sum(value - 50) OVER (PARTITION BY run ORDER BY t, seq
  ROWS UNBOUNDED PRECEDING) AS c FROM pts)
SELECT run, seq, R4(c - least(0, min(c) OVER (PARTITION BY run ORDER BY t, seq
  ROWS UNBOUNDED PRECEDING))) AS cusum FROM c""")
def cusum(t):
    out = skew.resettable_cusum(
        t.points, ["run"], ["t", "seq"], F.col("t"), F.col("value") - 50
    )
    return out.select("run", "seq", fixed("cusum", 4).alias("cusum"))


@query("F2_clipped_evidence_maxima", f"""
WITH {PTS} SELECT run, R4(sum(greatest(0, value - 60))) AS maximum FROM pts GROUP BY run""")
def evidence_maxima(t):
    gain = F.greatest(F.lit(0.0), F.col("value") - 60)
    run = skew.running_sum(t.points, ["run"], ["t", "seq"], F.col("t"), {"s": gain})
    return run.groupBy("run").agg(fixed(F.max("s"), 4).alias("maximum"))


@query("F3_related_event_delta", f"""
WITH {PTS}, r AS (SELECT seq, t, CASE WHEN k < 50 THEN 'trace:' || (run % 40)
  ELSE 'service:' || feature END AS rel FROM pts)
SELECT seq, R6(coalesce(CAST(t - lag(t) OVER (PARTITION BY rel ORDER BY t, seq) AS DOUBLE) / 1e9, 0))
  AS delta_seconds FROM r""")
def related(t):
    trace = F.when(F.col("k") < 50, (F.col("run") % 40).cast("string")).otherwise("")
    rows = t.points.select("seq", "t", trace.alias("trace_id"), F.col("feature").alias("service"))
    return sequences.related_deltas(rows).select(
        "seq", fixed("delta_seconds").alias("delta_seconds")
    )


FIRST_SQL = f"""f AS (SELECT run, min(i) FILTER (run % 2 = 1 AND i >= {ONSET} AND i < {STOP}) AS onset,
  max(i) FILTER (run % 2 = 1 AND i >= {ONSET} AND i < {STOP}) AS stop,
  min(i + 1) FILTER (score > 320) AS first_alert FROM scores GROUP BY run)"""


@query("F4_first_crossing_per_run", f"""
WITH {SCORES}, {FIRST_SQL}
SELECT *, onset IS NOT NULL AS is_treatment,
  coalesce(first_alert <= onset, false) AS pre_onset_alert,
  coalesce(first_alert > onset, false) AS detected,
  coalesce(first_alert > onset AND first_alert <= stop, false) AS detected_while_active,
  CASE WHEN first_alert > onset THEN first_alert - onset END AS delay FROM f""")
def first_crossing(t):
    return alerts.run_alert_rows(t.scores, "score", F.lit(320.0), active())


@query("F5_horizon_event_labels", f"""
WITH {SCORES}, e AS (SELECT run, min(i) FILTER (score > 320) AS event_i FROM scores GROUP BY run)
SELECT run, i, h, coalesce(event_i > i AND event_i <= i + h, false) AS label
FROM scores JOIN e USING (run), (SELECT unnest(range(1, 6)) AS h)""")
def labels(t):
    events = t.scores.groupBy("run").agg(
        F.min(F.when(F.col("score") > 320, F.col("i"))).alias("event_i")
    )
    return alerts.horizon_labels(t.scores, events, 5)


STEPS_SQL = f"""steps AS (SELECT run, seq, {WE} AS window_end, feature AS token,
  coalesce(lag(feature) OVER w, '<BOS>') AS previous,
  coalesce(CAST(lead(t) OVER w - t AS DOUBLE) / 1e6, 0) AS ms FROM pts
  WINDOW w AS (PARTITION BY run ORDER BY t, seq)),
pairs AS (SELECT previous, token, count(*) AS c, avg(ln(1 + ms)) AS center,
  greatest(stddev_pop(ln(1 + ms)), 0.05) AS spread FROM steps WHERE run % 5 <> 0 GROUP BY ALL),
ctx AS (SELECT previous, count(*) AS context FROM steps WHERE run % 5 <> 0 GROUP BY 1),
voc AS (SELECT count(DISTINCT token) AS v FROM steps WHERE run % 5 <> 0),
s AS (SELECT run, seq, window_end, -ln((coalesce(c, 0) + 1) / (coalesce(context, 0) + v))
  + least(0.5 * pow((ln(1 + ms) - coalesce(center, 0)) / coalesce(spread, 1), 2), 25) AS surprise
  FROM steps LEFT JOIN pairs USING (previous, token) LEFT JOIN ctx USING (previous), voc)"""


def token_steps(t):
    order, by = ["t", "seq"], F.col("t")
    plan = skew.plan_split(t.points, ["run"], by)
    rows = skew.previous(t.points, ["run"], order, by, {"previous": F.col("feature")}, plan=plan)
    rows = skew.following(rows, ["run"], order, by, {"_next": F.col("t")}, plan=plan)
    return rows.select(
        "run", "seq", window_end(F.col("t"), DAY).alias("window_end"),
        F.col("feature").alias("token"),
        F.coalesce("previous", F.lit(sequences.BEGIN)).alias("previous"),
        F.coalesce((F.col("_next") - F.col("t")) / F.lit(1e6), F.lit(0.0)).alias("time_to_next_ms"),
    )


@query("F6_bigram_surprise", f"""
WITH {PTS}, {STEPS_SQL} SELECT run, seq, R6(surprise) AS surprise FROM s""")
def bigram(t):
    steps = token_steps(t)
    fitted = sequences.fit_bigrams(steps.where("run % 5 <> 0"))
    return sequences.surprise(steps, fitted).select("run", "seq", fixed("surprise").alias("surprise"))


@query("F6_bigram_window_score", f"""
WITH {PTS}, {STEPS_SQL}, w AS (SELECT run, window_end, avg(surprise) AS m, count(*) AS n FROM s
  GROUP BY ALL), c AS (SELECT median(n) AS med FROM w WHERE run % 5 <> 0),
d AS (SELECT any_value(med) AS med, greatest(1.4826 * median(abs(n - med)), 1.0) AS scale
  FROM w, c WHERE run % 5 <> 0)
SELECT run, window_end, R6(m + 0.5 * pow((n - med) / scale, 2)) AS score FROM w, d""")
def bigram_windows(t):
    steps = token_steps(t)
    scored = sequences.surprise(steps, sequences.fit_bigrams(steps.where("run % 5 <> 0")))
    w = scored.groupBy("run", "window_end").agg(
        F.avg("surprise").alias("m"), F.count(F.lit(1)).alias("n")
    )
    fit = w.where("run % 5 <> 0")
    med = skew.exact_quantiles(fit, [], "n", {"med": 0.5})
    mad = skew.exact_quantiles(
        fit.crossJoin(F.broadcast(med)).withColumn("d", F.abs(F.col("n") - F.col("med"))),
        [], "d", {"mad": 0.5},
    )
    z = (F.col("n") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(1.0))
    return w.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(mad)).select(
        "run", "window_end", fixed(F.col("m") + 0.5 * z * z).alias("score")
    )


def spans_of(t):
    """Conversation turns as spans: one second per turn, text length as duration."""
    start = F.col("turn") * 1_000_000_000
    return t.conversations.select(
        F.col("conv_id").alias("trace"), F.col("turn").alias("span"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"),
        F.col("role").alias("name"), start.alias("start"),
        (start + F.length("text").cast("bigint") * 2_000_000).alias("end"),
        F.when(F.col("role") == "system", 2).otherwise(0).alias("status"),
    )


SPANS = """spans AS (SELECT conv_id AS trace, turn AS span, CASE WHEN turn > 0 THEN turn - 1 END AS parent,
  role AS name, turn * 1000000000 AS start, turn * 1000000000 + len(text) * 2000000 AS "end",
  CASE WHEN role = 'system' THEN 2 ELSE 0 END AS status FROM conversations)"""


@query("F7_inter_event_gaps", f"""
WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY start, span) AS rn FROM spans)
SELECT trace, span, CAST(rn AS BIGINT) AS position,
  R4(greatest(0, (start - coalesce(lag("end") OVER w, start)) / 1e6)) AS gap_from_previous_ms,
  R4(greatest(0, (coalesce(lead(start) OVER w, "end") - "end") / 1e6)) AS time_to_next_ms
FROM r WINDOW w AS (PARTITION BY trace ORDER BY start, span)""")
def gaps(t):
    out = sequences.span_gaps(spans_of(t), "trace")
    return out.select(
        "trace", "span", F.col("position").cast("bigint").alias("position"),
        fixed("gap_from_previous_ms", 4).alias("gap_from_previous_ms"),
        fixed("time_to_next_ms", 4).alias("time_to_next_ms"),
    )


@query("F8_stratified_role_split", """
SELECT o_orderkey, CASE WHEN rn <= 200 THEN 'reference' WHEN rn <= 400 THEN 'calibration'
  ELSE 'evaluation' END AS role FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus
    ORDER BY sha256('split-1:' || o_orderkey), o_orderkey) AS rn FROM orders)""")
def roles(t):
    pairs = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = alerts.stratified_roles(
        pairs, ["o_orderpriority", "o_orderstatus"], "o_orderkey",
        [("reference", 200), ("calibration", 400)], "evaluation", salt="split-1",
    )
    return out.select("o_orderkey", "role")


@query("F9_midpoint_episodes", f"""
WITH {SCORES}, x AS (SELECT run, run // 2 AS pair, i, score, (i - ({ONSET})) /
    CAST({STOP} - ({ONSET}) AS DOUBLE) AS elapsed,
    run % 2 = 1 AND i >= {ONSET} AND i < {STOP} AS act FROM scores),
q AS (SELECT pair, run, min(i) AS i FROM x WHERE act AND elapsed >= 0.5 GROUP BY ALL)
SELECT q.pair, q.i, a.score AS treatment_score, c.score AS control_score FROM q
JOIN x a ON a.run = q.run AND a.i = q.i
JOIN x c ON c.pair = q.pair AND c.run <> q.run AND c.i = q.i""")
def episodes(t):
    run = F.col("run")
    rows = t.scores.withColumn("pair", F.expr("run div 2"))
    elapsed = (F.col("i") - (8 + run % 5)) / (4 + run % 3)
    treated = rows.where(active() & (elapsed >= 0.5)).groupBy("pair").agg(
        F.min_by(F.struct("run", "i", "score"), F.struct("i")).alias("q")
    ).select("pair", "q.*")
    control = rows.select("pair", F.col("run").alias("_r"), "i", F.col("score").alias("control_score"))
    return treated.withColumnRenamed("score", "treatment_score").join(
        control, ["pair", "i"]
    ).where("run <> _r").select("pair", "i", "treatment_score", "control_score")


@query("F10_empirical_upper_p_values", f"""
WITH {PTS}, ref AS (SELECT value AS s FROM pts WHERE run % 5 = 0),
u AS (SELECT value, sum(c) OVER (ORDER BY value DESC) AS above FROM (
  SELECT value, count(*) FILTER (run % 5 = 0) AS c FROM pts GROUP BY value))
SELECT seq, R9((1.0::DOUBLE + above) / ((SELECT count(*) FROM ref) + 1)) AS p_value
FROM pts JOIN u USING (value)""")
def p_values(t):
    rows = t.points.select("seq", "run", "value")
    out = alerts.upper_p_values(rows, "value", F.col("run") % 5 == 0)
    return out.select("seq", fixed("p_value", 9).alias("p_value"))
