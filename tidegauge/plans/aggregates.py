"""Event features, templates, matched pairs and grouped report metrics."""

from pyspark.sql import Window, functions as F

from tidegauge.functions.clock import window_end
from tidegauge.functions.numbers import fixed
from tidegauge.operators import events, sequences, skew
from tidegauge.plans.frames import ACTIONS, actions_of
from tidegauge.plans.registry import query
from tidegauge.plans.sequences import ONSET, STOP, SPANS, active, spans_of
from tidegauge.plans.views import ACT, DAY, PTS, SCORES, WE, WIDE

TEMPLATES = ["click", "error", "view"]


def event_records(t):
    rows = t.points.select(
        "run", "seq", "t", F.col("feature").alias("template"), (F.col("k") % 24 + 1).alias("severity"),
        F.lit("").alias("trace_id"), F.col("run").cast("string").alias("service"),
        (F.col("k") < 50).alias("linked"),
        F.when(F.col("k") % 2 == 0, F.col("value")).alias("amount"),
        window_end(F.col("t"), DAY).alias("window_end"),
    )
    return sequences.related_deltas(rows)


RECORDS = f"""rec AS (SELECT run, seq, feature AS template, k % 24 + 1 AS severity, k < 50 AS linked,
  CASE WHEN k % 2 = 0 THEN value END AS amount, {WE} AS window_end,
  coalesce(CAST(t - lag(t) OVER (PARTITION BY run ORDER BY t, seq) AS DOUBLE) / 1e9, 0) AS delta FROM pts),
ef AS (SELECT run, window_end, count(*) FILTER (template = 'click') AS n_click,
  count(*) FILTER (template = 'error') AS n_error, count(*) FILTER (template = 'view') AS n_view,
  count(*) AS total, avg(severity) AS mean_severity, avg(delta) AS mean_delta,
  count(*) FILTER (linked) / count(*) AS link_ratio, avg(amount) AS mean_amount,
  count(amount) / count(*) AS observed_amount FROM rec GROUP BY ALL)"""
RATIOS = ["mean_severity", "mean_delta", "link_ratio", "mean_amount", "observed_amount"]


@query("A1_window_event_features", f"""
WITH {PTS}, {RECORDS} SELECT run, window_end, n_click, n_error, n_view, total,
  {', '.join(f'R5({c}) AS {c}' for c in RATIOS)} FROM ef""")
def event_features(t):
    f = events.event_features(event_records(t), ["run", "window_end"], TEMPLATES, ["amount"])
    return f.withColumns({c: fixed(c, 5) for c in RATIOS})


@query("A2_event_feature_transform", f"""
WITH {PTS}, {RECORDS}, q AS (SELECT quantile_cont(amount, 0.5) AS c, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS s
  FROM rec WHERE run % 5 <> 0)
SELECT run, window_end, R6(ln(1 + n_click)) AS n_click, R6(ln(1 + n_error)) AS n_error, R6(ln(1 + n_view)) AS n_view,
  R6(ln(1 + total)) AS total, R6(mean_severity / 24) AS mean_severity, R6(ln(1 + mean_delta)) AS mean_delta,
  R5(link_ratio) AS link_ratio, R5(observed_amount) AS observed_amount,
  R5(CASE WHEN observed_amount > 0 THEN greatest(least((mean_amount - c) / s, 8), -8) ELSE 0 END) AS mean_amount FROM ef, q""")
def event_transform(t):
    rec = event_records(t)
    f = events.event_features(rec, ["run", "window_end"], TEMPLATES, ["amount"])
    fit = events.fit_numeric_scale(rec.where("run % 5 <> 0").select("amount"), "amount")
    out = events.transform_features(f, TEMPLATES, "amount", fit)
    six = [f"n_{v}" for v in TEMPLATES] + ["total", "mean_severity", "mean_delta"]
    return out.withColumns({c: fixed(c) for c in six}).withColumns(
        {c: fixed(c, 5) for c in ("link_ratio", "observed_amount", "mean_amount")}
    )


@query("A3_three_signal_observations", f"""
WITH {PTS}, m AS (SELECT run, {WE} AS window_end, k, feature, value FROM pts)
SELECT run, window_end, R4(max(CASE WHEN feature = 'view' THEN value END)) AS metric_peak,
  count(*) FILTER (feature IN ('click', 'error')) AS log_count,
  count(*) FILTER (feature IN ('click', 'error') AND k % 24 + 1 >= 17) AS error_log_count,
  count(*) FILTER (feature IN ('purchase', 'signup')) AS span_count,
  count(*) FILTER (feature IN ('purchase', 'signup') AND k % 3 = 2) AS error_span_count FROM m GROUP BY ALL""")
def three_signals(t):
    p = t.points.withColumn("window_end", window_end(F.col("t"), DAY))
    none = F.lit(0).cast("bigint")
    signals = [
        ("view", [F.max("value").alias("metric_peak"), none.alias("log_count"), none.alias("error_log_count"),
                  none.alias("span_count"), none.alias("error_span_count")]),
        ("click,error", [F.lit(None).cast("double").alias("metric_peak"), F.count(F.lit(1)).alias("log_count"),
                         F.count_if(F.col("k") % 24 + 1 >= 17).alias("error_log_count"),
                         none.alias("span_count"), none.alias("error_span_count")]),
        ("purchase,signup", [F.lit(None).cast("double").alias("metric_peak"), none.alias("log_count"),
                             none.alias("error_log_count"), F.count(F.lit(1)).alias("span_count"),
                             F.count_if(F.col("k") % 3 == 2).alias("error_span_count")]),
    ]
    out = None
    for names, aggs in signals:
        part = p.where(F.col("feature").isin(names.split(","))).groupBy("run", "window_end").agg(*aggs)
        out = part if out is None else out.unionByName(part)
    counts = ["log_count", "error_log_count", "span_count", "error_span_count"]
    return out.groupBy("run", "window_end").agg(
        fixed(F.max("metric_peak"), 4).alias("metric_peak"), *[F.sum(c).alias(c) for c in counts]
    )


@query("A4_trace_binned_features", f"""
WITH {SPANS}, g AS (SELECT *, greatest(0, (start - coalesce(lag("end") OVER (PARTITION BY trace ORDER BY start, span), start)) / 1e6) AS gap FROM spans)
SELECT trace // 10 AS "window", name AS entity, R6(ln(1 + count(*))) AS log_count, R6(avg(status)) AS mean_outcome,
  R6(avg(ln(1 + ("end" - start) / 1e6))) AS mean_log_duration, R6(stddev_pop(ln(1 + ("end" - start) / 1e6))) AS std_log_duration,
  R6(avg(ln(1 + gap))) AS mean_log_gap FROM g GROUP BY ALL""")
def trace_bins(t):
    s = sequences.span_gaps(spans_of(t), "trace")
    duration = F.log1p((F.col("end") - F.col("start")) / F.lit(1e6))
    return s.groupBy(F.expr("trace div 10").alias("window"), F.col("name").alias("entity")).agg(
        fixed(F.log1p(F.count(F.lit(1)))).alias("log_count"), fixed(F.avg("status")).alias("mean_outcome"),
        fixed(F.avg(duration)).alias("mean_log_duration"),
        fixed(F.stddev_pop(duration)).alias("std_log_duration"),
        fixed(F.avg(F.log1p("gap_from_previous_ms"))).alias("mean_log_gap"),
    )


@query("A5_training_vocabulary", """
WITH d AS (SELECT doc_id, lang || ':' || source AS template FROM documents),
v AS (SELECT template, row_number() OVER (ORDER BY template) AS id FROM (SELECT DISTINCT template FROM d WHERE doc_id % 3 <> 0))
SELECT doc_id, coalesce(id, 0) AS template_id FROM d LEFT JOIN v USING (template)""")
def vocabulary(t):
    d = t.documents.select("doc_id", F.concat_ws(":", "lang", "source").alias("template"))
    v = events.fit_vocabulary(d.where("doc_id % 3 <> 0"))
    return events.encode(d, v).select("doc_id", "template_id")


TOKEN_RE = r"^([-+]?[0-9]+(\.[0-9]+)?|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}|([0-9]{1,3}\.){3}[0-9]{1,3})$"


@query("A6_log_template_mining", rf"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT trim(regexp_replace(line, '[ \t\n\v\f\r\x1c-\x1f\x85   -     　]+', ' ', 'g')) AS line FROM l),
t AS (SELECT array_to_string(list_transform(string_split(line, ' '), lambda x:
  CASE WHEN regexp_matches(x, '{TOKEN_RE}', 'i') THEN '<*>' ELSE x END), ' ') AS template FROM w)
SELECT md5(template) AS template_md5, count(*) AS n, octet_length(encode(template)) + 8 AS payload_bytes FROM t GROUP BY template""")
def template_mining(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return events.log_templates(lines, "line").select(
        F.md5("template").alias("template_md5"), "n", "payload_bytes"
    )


@query("A8_pooled_error_rate", f"""
WITH {WIDE}, s AS (SELECT run, sum(error) AS e, sum(error + view) AS r FROM wide WHERE i >= 5 AND i < 15 GROUP BY run)
SELECT run, CAST(r AS BIGINT) AS requests, CASE WHEN r > 0 THEN R6(e / r) END AS error_rate FROM s""")
def pooled_error_rate(t):
    s = t.wide.where("i >= 5 AND i < 15").groupBy("run").agg(
        F.sum("error").alias("e"), F.sum(F.col("error") + F.col("view")).alias("requests"),
        F.bool_and((F.col("error") >= 0) & (F.col("view") >= 0)).alias("ok"),
    )
    return s.select(
        "run", "requests",
        F.when(F.col("ok") & (F.col("requests") > 0), fixed(F.col("e") / F.col("requests"))).alias("error_rate"),
    )


CASES = f"""c AS (SELECT run, run % 3 AS topology, min(i) FILTER (run % 2 = 1 AND score > 250 AND i >= {ONSET} AND i < {STOP}) - any_value({ONSET}) AS delay,
  count(*) FILTER (score > 250 AND i < {ONSET}) AS pre_alerts, count(*) FILTER (i < {ONSET}) AS pre_points FROM scores GROUP BY run)"""


def case_rows(t):
    onset = 8 + F.col("run") % 5
    hit = F.col("score") > 250
    return t.scores.groupBy("run").agg(
        (F.min(F.when(active() & hit, F.col("i"))) - F.first(onset)).alias("delay"),
        F.count_if(hit & (F.col("i") < onset)).alias("pre_alerts"),
        F.count_if(F.col("i") < onset).alias("pre_points"),
    ).withColumn("topology", F.col("run") % 3)


@query("A9_stratified_alert_metrics", f"""
WITH {SCORES}, {CASES} SELECT topology, count(*) AS cases, count(delay) AS detected, R6(count(delay) / count(*)) AS recall,
  max(delay) AS worst_delay, CAST(sum(pre_alerts) AS BIGINT) AS pre_alerts, R6(sum(pre_alerts) / sum(pre_points)) AS pre_alert_rate
FROM c GROUP BY GROUPING SETS ((topology), ())""")
def stratified(t):
    return case_rows(t).groupingSets([["topology"], []], "topology").agg(
        F.count(F.lit(1)).alias("cases"), F.count("delay").alias("detected"),
        fixed(F.count("delay") / F.count(F.lit(1))).alias("recall"), F.max("delay").alias("worst_delay"),
        F.sum("pre_alerts").alias("pre_alerts"),
        fixed(F.sum("pre_alerts") / F.sum("pre_points")).alias("pre_alert_rate"),
    )


@query("A10_matched_block_risk_difference", """
WITH b AS (SELECT o_orderpriority AS block, o_orderstatus AS level, count(*) FILTER (o_totalprice > 250000) / count(*) AS rate FROM orders GROUP BY ALL),
d AS (SELECT b.block, b.level, b.rate - r.rate AS diff FROM b JOIN b r ON r.block = b.block AND r.level = 'F' WHERE b.level <> 'F'),
e AS (SELECT level, avg(diff) AS mean_difference, bool_and(diff >= 0.005) AS material, bool_and(abs(diff) < 0.005) AS none FROM d GROUP BY level)
SELECT level, R6(mean_difference) AS mean_difference, material,
  (SELECT CASE WHEN bool_and(material) THEN 'reproduced' WHEN NOT bool_or(material) AND bool_and(none) THEN 'none' ELSE 'mixed' END FROM e) AS classification FROM e""")
def risk_difference(t):
    b = t.orders.groupBy(F.col("o_orderpriority").alias("block"), F.col("o_orderstatus").alias("level")).agg(
        (F.count_if(F.col("o_totalprice") > 250000) / F.count(F.lit(1))).alias("rate")
    )
    ref = b.where("level = 'F'").select("block", F.col("rate").alias("_ref"))
    d = b.where("level <> 'F'").join(ref, "block").withColumn("diff", F.col("rate") - F.col("_ref"))
    e = d.groupBy("level").agg(
        F.avg("diff").alias("mean_difference"), F.bool_and(F.col("diff") >= 0.005).alias("material"),
        F.bool_and(F.abs("diff") < 0.005).alias("none"),
    )
    kind = e.agg(
        F.when(F.bool_and("material"), "reproduced")
        .when(~F.bool_or("material") & F.bool_and("none"), "none").otherwise("mixed").alias("classification")
    )
    return e.crossJoin(F.broadcast(kind)).select(
        "level", fixed("mean_difference").alias("mean_difference"), "material", "classification"
    )


@query("A11_pair_balanced_mean", f"""
WITH {SCORES}, r AS (SELECT run // 2 AS pair, run, avg(score) AS m FROM scores GROUP BY ALL),
p AS (SELECT pair, avg(m) AS m, count(*) AS arms FROM r GROUP BY pair)
SELECT count(*) AS pairs, R4(avg(m)) AS balanced_mean FROM p WHERE arms = 2""")
def balanced_mean(t):
    r = t.scores.groupBy("run").agg(F.avg("score").alias("m"))
    p = r.groupBy(F.expr("run div 2").alias("pair")).agg(
        F.avg("m").alias("m"), F.count(F.lit(1)).alias("arms")
    )
    return p.where("arms = 2").agg(
        F.count(F.lit(1)).alias("pairs"), fixed(F.avg("m"), 4).alias("balanced_mean")
    )


@query("A12_forecast_panels", f"""
WITH {ACT}, {ACTIONS}, e AS (SELECT act.run, act.feature, i, pow(lead(value) OVER (PARTITION BY act.run, act.feature ORDER BY i) - value, 2) AS sq FROM act)
SELECT a.kind, e.run % 4 AS replicas, count(*) AS n, R3(avg(sq)) AS mse FROM e JOIN (SELECT run, kind FROM actions) a ON a.run = e.run
WHERE sq IS NOT NULL GROUP BY GROUPING SETS ((), (a.kind), (e.run % 4))""")
def forecast_panels(t):
    w = Window.partitionBy("run", "feature").orderBy("i")
    d = F.lead("value").over(w) - F.col("value")
    e = t.activity.withColumn("sq", d * d).where("sq IS NOT NULL").join(
        actions_of(t).select("run", "kind"), "run"
    ).withColumn("replicas", F.col("run") % 4)
    return e.groupingSets([[], ["kind"], ["replicas"]], "kind", "replicas").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("sq"), 3).alias("mse")
    )


@query("A13_normalized_mse_per_channel", f"""
WITH {ACT}, d AS (SELECT run, feature, i, value, lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS p FROM act),
v AS (SELECT feature, var_pop(value) AS v FROM act WHERE run % 5 <> 0 GROUP BY feature)
SELECT feature, R4(avg(pow(value - p, 2)) / any_value(v)) AS nmse FROM d JOIN v USING (feature)
WHERE run % 5 = 0 AND p IS NOT NULL AND v > 1e-12 GROUP BY feature""")
def normalized_mse(t):
    w = Window.partitionBy("run", "feature").orderBy("i")
    d = t.activity.withColumn("p", F.lag("value").over(w)).where("run % 5 = 0 AND p IS NOT NULL")
    v = t.activity.where("run % 5 <> 0").groupBy("feature").agg(F.var_pop("value").alias("v"))
    e = (F.col("value") - F.col("p")) * (F.col("value") - F.col("p"))
    mse = d.groupBy("feature").agg(F.avg(e).alias("mse"))
    return mse.join(v.where("v > 1e-12"), "feature").select(
        "feature", fixed(F.col("mse") / F.col("v"), 4).alias("nmse")
    )


@query("A14_run_identity_guard", """
SELECT conv_id AS run, count(DISTINCT role) AS roles, count(DISTINCT len(text) > 100) AS builds FROM conversations
GROUP BY 1 HAVING count(DISTINCT role) > 1 OR count(DISTINCT len(text) > 100) > 1""")
def identity_guard(t):
    rows = t.conversations.select(
        F.col("conv_id").alias("run"), "role", (F.length("text") > 100).alias("build")
    )
    return rows.groupBy("run").agg(
        F.count_distinct("role").alias("roles"), F.count_distinct("build").alias("builds")
    ).where("roles > 1 OR builds > 1")


@query("A15_cross_run_identifier_reuse", """
WITH o AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1)
SELECT CAST(sum(owners - 1) FILTER (owners > 1) AS BIGINT) AS reused FROM o""")
def reuse(t):
    o = t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("owners")
    )
    return o.agg(F.sum(F.when(F.col("owners") > 1, F.col("owners") - 1)).alias("reused"))


PAIRED = f"""dl AS (SELECT a.run // 2 AS pair, a.i, a.score - b.score AS delta FROM scores a JOIN scores b
  ON b.run = a.run - 1 AND b.i = a.i WHERE a.run % 2 = 1),
pl AS (SELECT DISTINCT run // 2 AS pair, {ONSET} AS s, {STOP} AS e FROM scores WHERE run % 2 = 1),
fx AS (SELECT pair, median(delta) FILTER (i > s AND i <= e) AS active, median(delta) FILTER (i >= greatest(0, s - (e - s)) AND i < s) AS placebo,
  median(abs(delta)) FILTER (i > top - 4) AS leftover FROM dl JOIN pl USING (pair), (SELECT max(i) AS top FROM scores) GROUP BY pair)"""


def pair_effect_rows(t):
    rows = t.scores.select(
        F.expr("run div 2").alias("pair"), (F.col("run") % 2 == 1).alias("treated"), "i", "score"
    )
    run = F.col("run")
    plan = t.events.select(F.col("user_id").alias("run")).distinct().where("run % 2 = 1").select(
        F.expr("run div 2").alias("pair"), (8 + run % 5).alias("start_i"),
        (12 + run % 5 + run % 3).alias("stop_i"),
    )
    return events.pair_effects(events.paired(rows, ["i"], "score"), plan, 4, 10.0)


@query("A16_matched_pair_effects", f"""
WITH {SCORES}, {PAIRED} SELECT pair, R4(active) AS active, R4(placebo) AS placebo,
  R5(leftover / greatest(abs(active), 10)) AS recovery_ratio FROM fx""")
def pair_effects(t):
    return pair_effect_rows(t).select(
        "pair", fixed("active", 4).alias("active"), fixed("placebo", 4).alias("placebo"),
        fixed("recovery_ratio", 5).alias("recovery_ratio"),
    )


@query("A17_pair_failure_summary", f"""
WITH {SCORES}, {PAIRED}, g AS (SELECT pair, pair % 3 AS kind, unnest([CASE WHEN R4(active) <= 0 THEN 'effect' END,
  CASE WHEN abs(R4(placebo)) > 50 THEN 'placebo' END, CASE WHEN R5(leftover / greatest(abs(active), 10)) > 2 THEN 'recovery' END]) AS gate FROM fx)
SELECT kind, gate, count(*) AS failures, R6(count(*) / any_value(n)) AS failure_rate FROM g
JOIN (SELECT pair % 3 AS kind, count(*) AS n FROM fx GROUP BY 1) USING (kind) WHERE gate IS NOT NULL GROUP BY kind, gate""")
def failure_summary(t):
    fx = pair_effects(t).withColumn("kind", F.col("pair") % 3)
    failed = F.array_compact(F.array(
        F.when(F.col("active") <= 0, F.lit("effect")),
        F.when(F.abs("placebo") > 50, F.lit("placebo")),
        F.when(F.col("recovery_ratio") > 2, F.lit("recovery")),
    ))
    gates = fx.withColumn("gates", failed)
    n = gates.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return gates.select("kind", F.explode("gates").alias("gate")).groupBy("kind", "gate").agg(
        F.count(F.lit(1)).alias("failures")
    ).join(F.broadcast(n), "kind").select(
        "kind", "gate", "failures", fixed(F.col("failures") / F.col("n")).alias("failure_rate")
    )


@query("A18_raw_effect_sizes", f"""
WITH {ACT}, {ACTIONS}, j AS (SELECT act.run, i, value, n, start_i, stop_i FROM act JOIN actions a ON a.run = act.run AND a.feature = act.feature)
SELECT run, R4(median(value) FILTER (i < start_i)) AS baseline_median, max(value) FILTER (i >= start_i AND i < stop_i) AS fault_max,
  R4(max(value) FILTER (i >= start_i AND i < stop_i) - median(value) FILTER (i < start_i)) AS growth,
  CASE WHEN median(value) FILTER (i < start_i) <> 0 THEN R5(median(value) FILTER (i >= start_i AND i < stop_i) / median(value) FILTER (i < start_i)) ELSE 0 END AS ratio
FROM j GROUP BY run""")
def raw_effects(t):
    j = t.activity.join(actions_of(t).drop("kind", "magnitude"), ["run", "feature"])
    before = F.col("i") < F.col("start_i")
    during = ~before & (F.col("i") < F.col("stop_i"))
    med = lambda c: F.median(F.when(c, F.col("value")))
    e = j.groupBy("run").agg(
        med(before).alias("b"), F.max(F.when(during, F.col("value"))).alias("fault_max"),
        med(during).alias("f"),
    )
    return e.select(
        "run", fixed("b", 4).alias("baseline_median"), "fault_max",
        fixed(F.col("fault_max") - F.col("b"), 4).alias("growth"),
        F.when(F.col("b") != 0, fixed(F.col("f") / F.col("b"), 5)).otherwise(0.0).alias("ratio"),
    )


@query("A19_count_rate_consistency", f"""
WITH {WIDE} SELECT run, bool_and(error <= view) AS errors_within_requests,
  bool_and(abs(R5(view / 86400) * 86400 - view) <= 0.25) AS rate_matches FROM wide GROUP BY run""")
def count_rate(t):
    # The rate as it is recorded: five digits a second, which only some counts survive.
    rate = fixed(F.col("view") / 86400, 5)
    return t.wide.groupBy("run").agg(
        F.bool_and(F.col("error") <= F.col("view")).alias("errors_within_requests"),
        F.bool_and(F.abs(rate * 86400 - F.col("view")) <= 0.25).alias("rate_matches"),
    )


@query("A21_assignment_usage", """
WITH p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label)
SELECT R6(exp(-sum(p * ln(p)))) AS perplexity, count(*) FILTER (p > 0.005) AS active_codes FROM p""")
def assignment_usage(t):
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    p = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select(
        (F.col("c") / F.col("n")).alias("p")
    )
    return p.agg(
        fixed(F.exp(-F.sum(F.col("p") * F.log("p")))).alias("perplexity"),
        F.count_if(F.col("p") > 0.005).alias("active_codes"),
    )


@query("A22_owned_feature_mask", f"""
WITH {ACT}, o AS (SELECT run, feature, max(value) - min(value) > 1e-9 AS moved FROM act GROUP BY ALL),
b AS (SELECT DISTINCT user_id AS run, 'error' AS feature FROM events)
SELECT run, feature, coalesce(moved, false) OR b.run IS NOT NULL AS owned FROM o FULL JOIN b USING (run, feature)""")
def owned_mask(t):
    o = t.activity.groupBy("run", "feature").agg(
        ((F.max("value") - F.min("value")) > 1e-9).alias("moved")
    )
    b = t.events.select(F.col("user_id").alias("run"), F.lit("error").alias("feature")).distinct().withColumn(
        "bound", F.lit(True)
    )
    return o.join(b, ["run", "feature"], "full_outer").select(
        "run", "feature", (F.coalesce("moved", F.lit(False)) | F.coalesce("bound", F.lit(False))).alias("owned")
    )


@query("A23_score_summary", f"""
WITH {SCORES} SELECT run % 3 AS topology, count(*) AS n, R2(avg(score * score)) AS mean_square, R4(quantile_cont(score, 0.5)) AS median,
  R4(quantile_cont(score, 0.95)) AS p95, count(*) FILTER (score > 320) AS alerts, R6(count(*) FILTER (score > 320) / count(*)) AS alert_rate
FROM scores GROUP BY 1""")
def score_summary(t):
    s = t.scores.withColumn("topology", F.col("run") % 3)
    q = skew.exact_quantiles(s, ["topology"], "score", {"median": 0.5, "p95": 0.95})
    hit = F.count_if(F.col("score") > 320)
    g = s.groupBy("topology").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg(F.col("score") * F.col("score")), 2).alias("mean_square"),
        hit.alias("alerts"), fixed(hit / F.count(F.lit(1))).alias("alert_rate"),
    )
    return g.join(q, "topology").withColumns({"median": fixed("median", 4), "p95": fixed("p95", 4)})


@query("C19_family_ratio_gate", f"""
WITH {SCORES}, f AS (SELECT run % 3 AS family, avg(score) FILTER (run % 2 = 1) AS candidate, avg(score) FILTER (run % 2 = 0) AS raw FROM scores GROUP BY 1)
SELECT family, R5(candidate / raw) AS ratio, R5(candidate / raw) <= 1.02 AS passed,
  bool_and(R5(candidate / raw) <= 1.02) OVER () AS all_passed FROM f""")
def family_gate(t):
    arm = lambda k: F.avg(F.when(F.col("run") % 2 == k, F.col("score")))
    f = t.scores.groupBy((F.col("run") % 3).alias("family")).agg(
        fixed(arm(1) / arm(0), 5).alias("ratio")
    ).withColumn("passed", F.col("ratio") <= 1.02)
    return f.crossJoin(F.broadcast(f.agg(F.bool_and("passed").alias("all_passed"))))


@query("C15_detector_phase_report", f"""
WITH {SCORES}, p AS (SELECT *, CASE WHEN i >= {ONSET} AND i < {STOP} THEN 'structural' WHEN i >= 2 AND i < 6 THEN 'routine_noise' ELSE 'normal' END AS phase FROM scores)
SELECT phase, count(*) AS points, count(*) FILTER (score > 320) AS alerts, R6(count(*) FILTER (score > 320) / count(*)) AS alert_rate,
  R4(quantile_cont(score, 0.5)) AS median_score FROM p GROUP BY phase""")
def phase_report(t):
    run, i = F.col("run"), F.col("i")
    during = (i >= 8 + run % 5) & (i < 12 + run % 5 + run % 3)
    phase = F.when(during, "structural").when((i >= 2) & (i < 6), "routine_noise").otherwise("normal")
    p = t.scores.withColumn("phase", phase)
    hit = F.count_if(F.col("score") > 320)
    rates = p.groupBy("phase").agg(
        F.count(F.lit(1)).alias("points"), hit.alias("alerts"), fixed(hit / F.count(F.lit(1))).alias("alert_rate")
    )
    med = skew.exact_quantiles(p, ["phase"], "score", {"median_score": 0.5})
    return rates.join(med, "phase").withColumn("median_score", fixed("median_score", 4))
