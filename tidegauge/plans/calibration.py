"""Thresholds, alert reports, proper scores and significance."""

from pyspark.sql import functions as F

from tidegauge.functions.numbers import binomial_lower_tail, fixed
from tidegauge.operators import alerts, calibration, skew
from tidegauge.plans.registry import query
from tidegauge.plans.sequences import ONSET, STOP, active
from tidegauge.plans.views import SCORES


@query("C1_quantile_threshold_alerts", f"""
WITH {SCORES}, q AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scores WHERE run % 5 <> 0)
SELECT run, i, R4(threshold) AS threshold, score > threshold AS alert FROM scores, q""")
def quantile_alerts(t):
    fit = skew.exact_quantiles(t.scores_table.where("run % 5 <> 0"), [], "score", {"threshold": 0.95})
    return calibration.quantile_alerts(t.scores_table, fit, "score").select(
        "run", "i", fixed("threshold", 4).alias("threshold"), "alert"
    )


def control_maxima(t):
    return t.scores.where("run % 2 = 0").groupBy("run").agg(F.max("score").alias("top"))


MAXIMA = "mx AS (SELECT run, max(score) AS top FROM scores WHERE run % 2 = 0 GROUP BY run)"


@query("C2_control_maximum_higher_quantile", f"""
WITH {SCORES}, {MAXIMA}, r AS (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM mx)
SELECT top AS threshold FROM r WHERE rn = CAST(ceil((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1""")
def higher(t):
    return alerts.higher_quantile(control_maxima(t), "top", 0.95)


@query("C3_split_conformal_threshold", f"""
WITH {SCORES}, {MAXIMA}, r AS (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM mx)
SELECT coalesce(max(top) FILTER (rn = CAST(ceil((n + 1) * (1::DOUBLE - 0.05::DOUBLE)) AS BIGINT)), 'infinity'::DOUBLE) AS threshold FROM r""")
def conformal(t):
    return alerts.conformal_threshold(control_maxima(t), "top", 0.05)


EVID = f"""b AS (SELECT *, run // 2 AS pair, run % 2 = 1 AS treated,
  run % 2 = 1 AND i >= {ONSET} AND i < {STOP} AS act FROM scores)"""

C4_SQL = f"""WITH {SCORES}, {EVID},
ref AS (SELECT score FROM b WHERE NOT treated AND pair % 2 = 0),
above AS (SELECT score, sum(c) OVER (ORDER BY score DESC) AS a FROM (
  SELECT score, count(*) FILTER (NOT treated AND pair % 2 = 0) AS c FROM b GROUP BY score)),
e AS (SELECT b.*, R9(greatest(0, -ln((1.0::DOUBLE + a) / ((SELECT count(*) FROM ref) + 1)) - ln(2.0::DOUBLE))) AS ev
  FROM b JOIN above USING (score)),
s AS (SELECT *, R6(sum(ev) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)) AS cum FROM e),
pt AS (SELECT score AS thr FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn,
  count(*) OVER () AS n FROM ref) WHERE rn = CAST(ceil((n - 1) * (1.0::DOUBLE - 0.01)) AS BIGINT) + 1),
st AS (SELECT m AS thr FROM (SELECT m, row_number() OVER (ORDER BY m) AS rn, count(*) OVER () AS n
  FROM (SELECT run, max(cum) AS m FROM s WHERE NOT treated AND pair % 2 = 0 GROUP BY run))
  WHERE rn = CAST(ceil((n - 1) * (1.0::DOUBLE - 0.01)) AS BIGINT) + 1),
o AS (SELECT run, min(i) FILTER (act) AS onset FROM s GROUP BY run),
r AS (SELECT s.run, max(onset) AS onset, bool_or(score > pt.thr) AS any_point,
  bool_or(cum > st.thr) AS any_seq, coalesce(bool_or(score > pt.thr AND i < onset), false) AS pre_point,
  coalesce(bool_or(cum > st.thr AND i < onset), false) AS pre_seq,
  min(i) FILTER (score > pt.thr AND i >= onset) AS post_point,
  min(i) FILTER (cum > st.thr AND i >= onset) AS post_seq
  FROM s JOIN o USING (run), pt, st WHERE pair % 2 = 1 GROUP BY s.run)"""


def conformal_sequential(t, alpha=0.01):
    """Point and accumulated alarms per evaluation run."""
    rows = t.scores_table.withColumn("pair", F.expr("run div 2"))
    is_ref = (F.col("run") % 2 == 0) & (F.col("pair") % 2 == 0)
    scored = alerts.upper_p_values(rows, "score", is_ref)
    ev = scored.withColumn("ev", fixed(alerts.clipped_evidence(F.col("p_value")), 9))
    s = skew.running_sum(ev, ["run"], ["i"], F.col("i"), {"cum": F.col("ev")}).withColumn(
        "cum", fixed("cum")
    )
    q = 1.0 - alpha
    point = alerts.higher_quantile(rows.where(is_ref), "score", q, "point_thr")
    top = s.where(is_ref).groupBy("run").agg(F.max("cum").alias("top"))
    seq = alerts.higher_quantile(top, "top", q, "seq_thr")
    onset = F.when(active(), F.col("i"))
    onsets = rows.groupBy("run").agg(F.min(onset).alias("onset"))
    joined = (
        s.where("pair % 2 = 1").join(onsets, "run")
        .crossJoin(F.broadcast(point)).crossJoin(F.broadcast(seq))
    )
    return alerts.trajectory_alarm_rows(joined, {
        "point": F.col("score") > F.col("point_thr"),
        "seq": F.col("cum") > F.col("seq_thr"),
    })


@query("C4_conformal_sequential_rows", C4_SQL + """
SELECT run, onset, onset IS NOT NULL AS is_treatment, any_point, any_seq,
  pre_point AS pre_onset_point, pre_seq AS pre_onset_seq,
  post_point AS post_onset_point, post_seq AS post_onset_seq FROM r""")
def conformal_rows(t):
    return conformal_sequential(t)


@query("C4_conformal_sequential_report", C4_SQL + """
SELECT R6(avg(any_point::INT) FILTER (onset IS NULL)) AS control_point_rate,
  R6(avg(any_seq::INT) FILTER (onset IS NULL)) AS control_sequential_rate,
  R6(avg((post_point IS NOT NULL)::INT) FILTER (onset IS NOT NULL)) AS point_detection_rate,
  R6(avg((post_seq IS NOT NULL)::INT) FILTER (onset IS NOT NULL)) AS sequential_detection_rate FROM r""")
def conformal_report(t):
    rows = conformal_sequential(t)
    rate = lambda hit, of: fixed(F.try_divide(F.count_if(hit & of), F.count_if(of)))
    tr = F.col("is_treatment")
    return rows.agg(
        rate(F.col("any_point"), ~tr).alias("control_point_rate"),
        rate(F.col("any_seq"), ~tr).alias("control_sequential_rate"),
        rate(F.col("post_onset_point").isNotNull(), tr).alias("point_detection_rate"),
        rate(F.col("post_onset_seq").isNotNull(), tr).alias("sequential_detection_rate"),
    )


C5_SQL = f"""WITH {SCORES}, {EVID},
p AS (SELECT DISTINCT pair FROM b),
roles AS (SELECT pair, CASE WHEN rn <= 3 THEN 'reference' WHEN rn <= 6 THEN 'calibration' ELSE 'evaluation' END AS role
  FROM (SELECT pair, row_number() OVER (PARTITION BY pair % 3, pair % 2 ORDER BY pair) AS rn FROM p)),
x AS (SELECT b.*, role FROM b JOIN roles USING (pair)),
ref AS (SELECT count(*) AS n FROM x WHERE NOT treated AND role = 'reference'),
above AS (SELECT score, sum(c) OVER (ORDER BY score DESC) AS a FROM (
  SELECT score, count(*) FILTER (NOT treated AND role = 'reference') AS c FROM x GROUP BY score)),
e AS (SELECT x.*, R9(-ln((1.0::DOUBLE + a) / (n + 1)) - ln(4.0::DOUBLE)) AS ev FROM x JOIN above USING (score), ref),
c AS (SELECT *, sum(ev) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM e),
s AS (SELECT *, R6(c - least(0, min(c) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING))) AS cum FROM c),
mx AS (SELECT max(cum) AS top FROM s WHERE NOT treated AND role = 'calibration' GROUP BY run),
th AS (SELECT coalesce(max(top) FILTER (rn = CAST(ceil((n + 1) * (1::DOUBLE - 0.1::DOUBLE)) AS BIGINT)), 'infinity'::DOUBLE) AS thr
  FROM (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM mx)),
r AS (SELECT run, min(i) FILTER (act) AS onset, max(i) FILTER (act) AS stop,
  min(i + 1) FILTER (cum > thr) AS first_alert FROM s, th WHERE role = 'evaluation' GROUP BY run)"""


def run_aware(t, alpha=0.1):
    """Roles, p-values, resettable evidence, conformal run threshold, rows per run."""
    rows = t.scores_table.withColumn("pair", F.expr("run div 2"))
    pairs = rows.select("pair").distinct().select(
        "pair", (F.col("pair") % 3).alias("kind"), (F.col("pair") % 2).alias("topology")
    )
    roles = alerts.stratified_roles(
        pairs, ["kind", "topology"], "pair", [("reference", 3), ("calibration", 6)], "evaluation"
    ).select("pair", "role")
    rows = rows.join(roles, "pair")
    control = F.col("run") % 2 == 0
    scored = alerts.upper_p_values(rows, "score", control & (F.col("role") == "reference"))
    ev = scored.withColumn("ev", fixed(alerts.drifting_evidence(F.col("p_value")), 9))
    s = skew.resettable_cusum(ev, ["run"], ["i"], F.col("i"), F.col("ev"), "cum").withColumn(
        "cum", fixed("cum")
    )
    top = s.where(control & (F.col("role") == "calibration")).groupBy("run").agg(
        F.max("cum").alias("top")
    )
    thr = alerts.conformal_threshold(top, "top", alpha)
    final = s.where("role = 'evaluation'").crossJoin(F.broadcast(thr))
    return alerts.run_alert_rows(final, "cum", F.col("threshold"), active())


@query("C5_run_aware_alert_rows", C5_SQL + """
SELECT *, onset IS NOT NULL AS is_treatment,
  coalesce(first_alert <= onset, false) AS pre_onset_alert, coalesce(first_alert > onset, false) AS detected,
  coalesce(first_alert > onset AND first_alert <= stop, false) AS detected_while_active,
  CASE WHEN first_alert > onset THEN first_alert - onset END AS delay FROM r""")
def run_aware_rows(t):
    return run_aware(t)


@query("C5_run_aware_alert_summary", C5_SQL + """, g AS (
SELECT count(*) FILTER (onset IS NULL) AS controls,
  count(*) FILTER (onset IS NULL AND first_alert IS NOT NULL) AS false_alarms,
  R6(count(*) FILTER (first_alert > onset) / nullif(count(*) FILTER (onset IS NOT NULL), 0)) AS detection_rate,
  R6(median(first_alert - onset) FILTER (first_alert > onset)) AS median_delay FROM r)
SELECT *, R9((SELECT sum(exp(lgamma(controls + 1) - lgamma(j + 1) - lgamma(controls - j + 1)
   + j * ln(0.15) + (controls - j) * ln(0.85))) FROM range(0, controls + 1) x(j) WHERE j <= false_alarms))
  AS false_alarm_p_value FROM g""")
def run_aware_summary(t):
    rows = run_aware(t)
    tr = F.col("is_treatment")
    g = rows.agg(
        F.count_if(~tr).alias("controls"),
        F.count_if(~tr & F.col("first_alert").isNotNull()).alias("false_alarms"),
        fixed(F.try_divide(F.count_if(F.col("detected")), F.count_if(tr))).alias("detection_rate"),
        fixed(F.percentile("delay", 0.5)).alias("median_delay"),
    )
    tail = binomial_lower_tail(F.col("false_alarms"), F.col("controls").cast("double"), F.lit(0.15))
    return g.withColumn("false_alarm_p_value", fixed(tail, 9))


ALARM = f"""o AS (SELECT run, min(i) FILTER (act) AS onset FROM b GROUP BY run),
r AS (SELECT b.run, max(onset) AS onset, bool_or(score > T) AS any_a,
  coalesce(bool_or(score > T AND i < onset), false) AS pre,
  min(i) FILTER (score > T AND i >= onset) AS post FROM b JOIN o USING (run) GROUP BY b.run)"""

METRICS = """count(*) FILTER (onset IS NULL) AS controls, count(*) FILTER (onset IS NOT NULL) AS treatments,
  R6(avg(any_a::INT) FILTER (onset IS NULL)) AS false_alarm_rate,
  R6(avg((post IS NOT NULL)::INT) FILTER (onset IS NOT NULL)) AS detection_rate,
  R6(avg(pre::INT) FILTER (onset IS NOT NULL)) AS pre_onset_rate,
  max(post - onset) AS worst_delay, R6(avg(any_a::INT)) AS alerts_per_run,
  R6(median(post - onset)) AS median_delay"""


def alarm_metrics(t, threshold):
    onsets = t.scores.groupBy("run").agg(F.min(F.when(active(), F.col("i"))).alias("onset"))
    rows = alerts.trajectory_alarm_rows(
        t.scores.join(onsets, "run"), {"alarm": F.col("score") > threshold}
    )
    m = alerts.alarm_metrics(rows, "alarm")
    rates = ["false_alarm_rate", "detection_rate", "pre_onset_rate", "alerts_per_run", "median_delay"]
    return m.withColumns({c: fixed(c) for c in rates})


@query("C6_trajectory_alert_metrics", f"""
WITH {SCORES}, {EVID}, {ALARM.replace(' T', ' 320')} SELECT {METRICS} FROM r""")
def alert_metrics(t):
    return alarm_metrics(t, 320.0)


@query("C18_policy_pareto", f"""
WITH {SCORES}, {EVID}, {ALARM.replace(' T', ' 320')}, a AS (SELECT {METRICS} FROM r),
{ALARM.replace(' T', ' 400').replace('o AS', 'o2 AS').replace('r AS', 'r2 AS').replace('JOIN o ', 'JOIN o2 ')},
c AS (SELECT {METRICS} FROM r2),
j AS (SELECT a.false_alarm_rate AS fa, c.false_alarm_rate AS cfa, a.detection_rate AS d,
  c.detection_rate AS cd, coalesce(a.median_delay, 'infinity') AS m, coalesce(c.median_delay, 'infinity') AS cm FROM a, c)
SELECT cfa <= fa AND cd >= d AND cm <= m AS non_inferior,
  cfa <= fa AND cd >= d AND cm <= m AND (cfa < fa OR cd > d OR cm < m) AS dominates FROM j""")
def policy_pareto(t):
    return calibration.pareto(alarm_metrics(t, 400.0), alarm_metrics(t, 320.0))


@query("C18_gate_table", f"""
WITH {SCORES}, {EVID}, {ALARM.replace(' T', ' 320')}, a AS (SELECT {METRICS} FROM r)
SELECT 'false_alarm' AS gate, false_alarm_rate AS observed, 0.5::DOUBLE AS "limit", false_alarm_rate <= 0.5 AS passed FROM a
UNION ALL SELECT 'detection', detection_rate, 0.8, detection_rate >= 0.8 FROM a
UNION ALL SELECT 'worst_delay', worst_delay, 10, worst_delay <= 10 FROM a""")
def gates(t):
    return calibration.gate_table(alarm_metrics(t, 320.0), [
        ("false_alarm", "false_alarm_rate", "<=", 0.5), ("detection", "detection_rate", ">=", 0.8),
        ("worst_delay", "worst_delay", "<=", 10),
    ])


PROB = "p AS (SELECT doc_id, quality, ((doc_id * 37) % 100 + 0.5::DOUBLE) / 100 AS p FROM labels)"


def probabilities(t):
    return t.labels.select(
        "doc_id", "quality", (((F.col("doc_id") * 37) % 100 + F.lit(0.5)) / 100).alias("p")
    )


@query("C7_probability_surface_metrics", f"""
WITH {PROB}, g AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(quality) AS sy FROM p GROUP BY 1)
SELECT (SELECT R6(avg(pow(p - quality, 2))) FROM p) AS brier, R6(sum(abs(sp - sy)) / sum(n)) AS ece,
  R6(sum(sy) / sum(n)) AS positive_rate FROM g""")
def surface(t):
    m = calibration.surface_metrics(probabilities(t), "p", "quality")
    return m.select(*[fixed(c).alias(c) for c in m.columns])


GRID = """grid AS (SELECT slope, -4 + 0.25 * j AS intercept FROM
  (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]::DOUBLE[]) AS slope),
  (SELECT unnest(range(0, 33))::DOUBLE AS j)),
br AS (SELECT slope, intercept, avg(pow(1 / (1 + exp(-(slope * ln(p / (1 - p)) + intercept))) - quality, 2)) AS brier
  FROM p, grid GROUP BY ALL),
best AS (SELECT slope, intercept, brier FROM br
  ORDER BY brier, abs(slope - 1), abs(intercept), slope, intercept LIMIT 1)"""


@query("C8_logit_calibrator_grid", f"""
WITH {PROB}, {GRID} SELECT slope, intercept, R6(brier) AS brier FROM best""")
def logit_fit(t):
    best = calibration.fit_logit_calibrator(probabilities(t), "p", "quality")
    return best.select("slope", "intercept", fixed("brier").alias("brier"))


@query("C8_logit_calibrator_apply", f"""
WITH {PROB}, {GRID} SELECT doc_id, R6(1 / (1 + exp(-(slope * ln(p / (1 - p)) + intercept)))) AS calibrated
FROM p, best""")
def logit_apply(t):
    best = calibration.fit_logit_calibrator(probabilities(t), "p", "quality")
    p = calibration.logit_map(F.col("p"), F.col("slope"), F.col("intercept"))
    return probabilities(t).crossJoin(F.broadcast(best)).select(
        "doc_id", fixed(p).alias("calibrated")
    )


@query("B14_calibrated_score_adapter", f"""
WITH {PROB}, {GRID}, c AS (SELECT doc_id, doc_id // 8 AS run, quality,
  R6(1 / (1 + exp(-(slope * ln(p / (1 - p)) + intercept)))) AS risk FROM p, best),
m AS (SELECT max(risk) AS top FROM c WHERE quality = 0 GROUP BY run),
th AS (SELECT top AS thr FROM (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM m)
  WHERE rn = CAST(ceil((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1)
SELECT doc_id, risk, risk >= thr AS decision FROM c, th""")
def score_adapter(t):
    best = calibration.fit_logit_calibrator(probabilities(t), "p", "quality")
    p = calibration.logit_map(F.col("p"), F.col("slope"), F.col("intercept"))
    c = probabilities(t).crossJoin(F.broadcast(best)).select(
        "doc_id", F.expr("doc_id div 8").alias("run"), "quality", fixed(p).alias("risk")
    )
    top = c.where("quality = 0").groupBy("run").agg(F.max("risk").alias("top"))
    thr = alerts.higher_quantile(top, "top", 0.95)
    return c.crossJoin(F.broadcast(thr)).select(
        "doc_id", "risk", (F.col("risk") >= F.col("threshold")).alias("decision")
    )


@query("C9_survival_cdf", f"""
WITH {SCORES}, h AS (SELECT run, i, (CAST(round(score * 100) AS BIGINT) % 100) / 1000 AS h FROM scores)
SELECT run, i, R9(1 - product(1 - h) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)) AS cdf FROM h""")
def survival(t):
    h = t.scores.withColumn("h", (F.round(F.col("score") * 100).cast("bigint") % 100) / 1000)
    arrays = h.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s")
    ).withColumn("cdf", calibration.survival_cdf(F.transform("s", lambda x: x["h"])))
    return arrays.select("run", F.explode(F.arrays_zip(F.col("s"), F.col("cdf"))).alias("z")).select(
        "run", F.col("z.s.i").alias("i"), fixed(F.col("z.cdf"), 9).alias("cdf")
    )


@query("C12_gaussian_nll", """
SELECT l_orderkey, R6(sum(0.5 * (ln(2 * pi() * (100 + l_linenumber)) + pow(l_quantity - 25, 2) / (100 + l_linenumber)))) AS nll
FROM lineitem GROUP BY 1""")
def gaussian(t):
    term = calibration.gaussian_nll(F.col("l_quantity"), F.lit(25.0), F.lit(100.0) + F.col("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(fixed(F.sum(term)).alias("nll"))


MIX = "c(component, weight, mean, var) AS (VALUES (0, 0.3::DOUBLE, 10::DOUBLE, 50::DOUBLE), (1, 0.7, 30, 80))"


def mixture(t):
    return t.spark.createDataFrame(
        [(0, 0.3, 10.0, 50.0), (1, 0.7, 30.0, 80.0)],
        "component int, weight double, mean double, var double",
    )


@query("C12_mixture_nll", f"""
WITH {MIX}, l AS (SELECT l_orderkey, component, ln(any_value(weight)) - sum(0.5 * (ln(2 * pi() * var) + pow(l_quantity - mean, 2) / var)) AS l
  FROM lineitem, c GROUP BY ALL), m AS (SELECT l_orderkey, max(l) AS top FROM l GROUP BY 1)
SELECT l_orderkey, R6(-(any_value(top) + ln(sum(exp(l - top))))) AS nll FROM l JOIN m USING (l_orderkey) GROUP BY 1""")
def mixture_nll(t):
    out = calibration.mixture_nll(t.lineitem, ["l_orderkey"], "l_quantity", mixture(t))
    return out.select("l_orderkey", fixed("nll").alias("nll"))


def monthly_differences(t):
    month = F.month(F.col("o_orderdate"))
    by = t.orders.groupBy(month.alias("month"), "o_orderstatus").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"),
        F.count(F.lit(1)).alias("n"),
    )
    mean = F.col("c") / F.col("n") / 100
    return by.groupBy("month").agg(
        (F.max(F.when(F.col("o_orderstatus") == "F", mean))
         - F.max(F.when(F.col("o_orderstatus") == "O", mean))).alias("d")
    )


DIFF = """m AS (SELECT month(o_orderdate) AS month, o_orderstatus AS s, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100 AS mean
  FROM orders GROUP BY ALL),
d AS (SELECT month, max(mean) FILTER (s = 'F') - max(mean) FILTER (s = 'O') AS d FROM m GROUP BY month)"""


@query("C14_exact_sign_flip", f"""
WITH {DIFF}, k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j FROM d), n AS (SELECT count(*) AS n, sum(d) AS obs FROM d),
f AS (SELECT x.id, sum(CASE WHEN (x.id >> j) & 1 = 1 THEN -d ELSE d END) AS s FROM range(0, 4096) x(id), k GROUP BY x.id)
SELECT CAST(count(*) AS BIGINT) AS patterns, CAST(count(*) FILTER (s <= obs + 1e-9) AS BIGINT) AS as_extreme,
  R9(count(*) FILTER (s <= obs + 1e-9) / count(*)) AS p_value FROM f, n""")
def sign_flip(t):
    out = calibration.exact_sign_flip(monthly_differences(t), "d")
    return out.withColumn("p_value", fixed("p_value", 9))


@query("C14_monte_carlo_sign_flip", f"""
WITH {DIFF}, s AS (SELECT draw, sum(CASE WHEN ('0x' || substr(sha256('7:' || draw || ':' || month), 16, 1))::INT % 2 = 0 THEN d ELSE -d END) AS s
  FROM d, range(1, 10000) x(draw) GROUP BY draw)
SELECT R9((1 + count(*) FILTER (s <= (SELECT sum(d) FROM d) + 1e-9)) / 10000.0) AS p_value FROM s""")
def sign_flip_mc(t):
    out = calibration.monte_carlo_sign_flip(monthly_differences(t), "month", "d", 9_999, 7)
    return out.select(fixed("p_value", 9).alias("p_value"))


@query("C17_rollout_stability", f"""
WITH {SCORES}, f AS (SELECT run, i, abs(lead(score, 1) OVER w) AS s1, {', '.join(
    f'lead(score, {h}) OVER w AS f{h}' for h in range(1, 6))} FROM scores WINDOW w AS (PARTITION BY run ORDER BY i))
SELECT count(*) AS samples, true AS finite, max(greatest(f1, f2, f3, f4, f5)) AS max_abs,
  R6(max(greatest(f1, f2, f3, f4, f5) / greatest(f1, 1))) AS max_growth FROM f WHERE f5 IS NOT NULL""")
def stability(t):
    from tidegauge.operators import frames

    out = frames.history_future_frames(t.scores, ["run"], 1, 5, "score")
    size = F.transform("future", lambda x: F.abs(x))
    top = F.array_max(size)
    return out.agg(
        F.count(F.lit(1)).alias("samples"),
        F.bool_and(F.forall("future", lambda x: F.abs(x) < float("inf"))).alias("finite"),
        F.max(top).alias("max_abs"),
        fixed(F.max(top / F.greatest(F.get(size, 0), F.lit(1.0)))).alias("max_growth"),
    )
