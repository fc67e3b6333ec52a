"""Sequence frames, scaling and folds over the activity grid."""

from pyspark.sql import functions as F

from tidegauge.functions.numbers import fixed
from tidegauge.operators import frames
from tidegauge.plans.registry import query
from tidegauge.plans.views import ACT

SERIES = ["run", "feature"]


def frames_of(t, lookback=6):
    return frames.lookback_frames(t.activity, SERIES, lookback)


@query("W1_lookback_frames", f"""
WITH {ACT} SELECT * FROM (SELECT run, feature, i, {', '.join(
    f'lag(value, {6 - j}) OVER w AS c{j}' for j in range(6))}, value AS target FROM act
  WINDOW w AS (PARTITION BY run, feature ORDER BY i)) WHERE i >= 6""")
def lookback(t):
    return frames_of(t).select(
        *SERIES, "i", *[F.get("context", j).alias(f"c{j}") for j in range(6)], "target"
    )


@query("W2_multi_horizon_blocks", f"""
WITH {ACT}, b AS (SELECT run, feature, i, unnest([1, 3]) AS horizon FROM act),
j AS (SELECT b.run, b.feature, b.i, b.horizon, x.value AS b0, y.value AS b1 FROM b
  JOIN act x ON x.run = b.run AND x.feature = b.feature AND x.i = b.i + b.horizon - 1
  JOIN act y ON y.run = b.run AND y.feature = b.feature AND y.i = b.i + b.horizon)
SELECT run, feature, i, CAST(horizon AS BIGINT) AS horizon, b0, b1 FROM j""")
def blocks(t):
    out = frames.future_blocks(t.activity, SERIES, [1, 3], 2)
    return out.select(
        *SERIES, "i", F.col("horizon").cast("bigint").alias("horizon"),
        F.get("block", 0).alias("b0"), F.get("block", 1).alias("b1"),
    )


@query("W3_history_future_frames", f"""
WITH {ACT}, f AS (SELECT run, feature, i, lag(value, 9) OVER w AS h_first, value AS h_last,
  lead(value, 1) OVER w AS f_first, lead(value, 5) OVER w AS f_last,
  sum(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h_sum,
  sum(n) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS action_sum
  FROM act WINDOW w AS (PARTITION BY run, feature ORDER BY i))
SELECT run, feature, i, h_first, h_last, f_first, f_last, R4(h_sum) AS h_sum,
  CAST(action_sum AS BIGINT) AS action_sum FROM f WHERE h_first IS NOT NULL AND f_last IS NOT NULL""")
def history_future(t):
    out = frames.history_future_frames(t.activity, SERIES, 10, 5, action="n")
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return out.select(
        *SERIES, "i", F.get("history", 0).alias("h_first"),
        F.element_at("history", -1).alias("h_last"), F.get("future", 0).alias("f_first"),
        F.element_at("future", -1).alias("f_last"),
        fixed(total("history", F.lit(0.0)), 4).alias("h_sum"),
        total("actions", F.lit(0).cast("bigint")).alias("action_sum"),
    )


# One planned action per run: kind, target, interval and magnitude from the run id.
ACTIONS = """actions AS (SELECT run, ['stall', 'flood', 'leak'][run % 3 + 1] AS kind,
  ['click', 'error', 'purchase', 'signup', 'view'][run % 5 + 1] AS feature,
  8 + run % 5 AS start_i, 12 + run % 5 + run % 3 AS stop_i, run % 7 + 1 AS magnitude
  FROM (SELECT DISTINCT user_id AS run FROM events))"""


def actions_of(t):
    run = F.col("run")
    pick = lambda names, k: F.element_at(
        F.array(*[F.lit(n) for n in names]), (run % k + 1).cast("int")
    )
    return t.events.select(F.col("user_id").alias("run")).distinct().select(
        "run", pick(["stall", "flood", "leak"], 3).alias("kind"),
        pick(["click", "error", "purchase", "signup", "view"], 5).alias("feature"),
        (8 + run % 5).alias("start_i"), (12 + run % 5 + run % 3).alias("stop_i"),
        (run % 7 + 1).alias("magnitude"),
    )


@query("W4_intervention_encoding", f"""
WITH {ACT}, {ACTIONS}, s AS (SELECT kind, max(magnitude) AS top FROM actions
  WHERE run % 5 <> 0 GROUP BY kind),
j AS (SELECT act.run, act.feature, act.i, a.kind, start_i, stop_i,
  magnitude / CAST(top AS DOUBLE) AS m, coalesce(act.i >= start_i AND act.i < stop_i, false) AS act1,
  coalesce(act.i = stop_i, false) AS stop1
  FROM act LEFT JOIN actions a ON a.run = act.run AND a.feature = act.feature
  LEFT JOIN s ON s.kind = a.kind)
SELECT run, feature, i, NOT (act1 OR stop1) AS no_action, act1 OR stop1 AS applicable,
  CASE WHEN act1 OR stop1 THEN kind END AS kind,
  CASE WHEN i = start_i THEN 'start' WHEN act1 THEN 'active' WHEN stop1 THEN 'stop' END AS phase,
  CASE WHEN act1 THEN R6(m) ELSE 0 END AS magnitude,
  CASE WHEN act1 THEN R6((i - start_i) / (stop_i - start_i)) ELSE 0 END AS elapsed,
  CASE WHEN act1 THEN R6((stop_i - i) / (stop_i - start_i)) ELSE 0 END AS remaining FROM j""")
def intervention(t):
    plan = actions_of(t)
    scale = plan.where("run % 5 <> 0").groupBy("kind").agg(F.max("magnitude").alias("_top"))
    scaled = plan.join(F.broadcast(scale), "kind", "left").withColumn(
        "scaled_magnitude", F.col("magnitude") / F.col("_top")
    ).drop("_top", "magnitude")
    out = frames.encode_actions(t.activity.select(*SERIES, "i"), scaled, SERIES)
    return out.withColumns({c: fixed(c) for c in ("magnitude", "elapsed", "remaining")})


ROBUST = """med AS (SELECT feature, median(value) AS location FROM act GROUP BY 1),
rob AS (SELECT feature, any_value(location) AS location,
  CASE WHEN 1.4826 * median(abs(value - location)) > 1e-12 THEN 1.4826 * median(abs(value - location))
       WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1 END AS scale
  FROM act JOIN med USING (feature) GROUP BY feature)"""


@query("W5_robust_scaling_fit", f"""
WITH {ACT}, {ROBUST} SELECT feature, R6(location) AS location, R6(scale) AS scale FROM rob""")
def robust_fit(t):
    fit = frames.robust_scale(t.activity, ["feature"], "value")
    return fit.select("feature", fixed("location").alias("location"), fixed("scale").alias("scale"))


@query("W6_standard_scaling_fit", f"""
WITH {ACT}, {ACTIONS} SELECT feature, R4(avg(value)) AS location,
  R4(CASE WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1 END) AS scale
FROM act WHERE run % 5 <> 0 GROUP BY feature""")
def standard_fit(t):
    fit = frames.standard_scale(t.activity.where("run % 5 <> 0"), ["feature"], "value")
    return fit.select(
        "feature", fixed("location", 4).alias("location"), fixed("scale", 4).alias("scale")
    )


@query("W6_action_magnitude_scale", f"""
WITH {ACTIONS} SELECT kind, max(magnitude) AS scale FROM actions WHERE run % 5 <> 0 GROUP BY kind""")
def magnitude_scale(t):
    return actions_of(t).where("run % 5 <> 0").groupBy("kind").agg(
        F.max("magnitude").alias("scale")
    )


@query("W7_scaler_apply_and_invert", f"""
WITH {ACT}, {ROBUST} SELECT run, feature, i, R6((value - location) / scale) AS z,
  R4(value) AS restored FROM act JOIN rob USING (feature)""")
def apply_invert(t):
    fit = frames.robust_scale(t.activity, ["feature"], "value")
    z = frames.apply_scale(t.activity, F.broadcast(fit), ["feature"], "value")
    back = frames.invert_scale(z, F.broadcast(fit), ["feature"], "z", "restored")
    return back.select(*SERIES, "i", fixed("z").alias("z"), fixed("restored", 4).alias("restored"))


@query("W8_repair_isolated_outliers", f"""
WITH {ACT}, fit AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM act GROUP BY 1),
z AS (SELECT run, i, feature, R6((value - m) / s) AS z FROM act JOIN fit USING (feature)),
o AS (SELECT *, abs(z) > 1.5 AS o, count(*) FILTER (abs(z) > 1.5) OVER (PARTITION BY run, i) AS n FROM z)
SELECT run, i, feature, o AND n < 2 AS repaired,
  R6(CASE WHEN o AND n < 2 THEN median(CASE WHEN NOT (o AND n < 2) THEN z END)
    OVER (PARTITION BY run, i) ELSE z END) AS fixed_value FROM o""")
def repaired(t):
    fit = frames.standard_scale(t.activity, ["feature"], "value")
    z = frames.apply_scale(t.activity, F.broadcast(fit), ["feature"], "value").withColumn(
        "z", fixed("z")
    )
    out = frames.repair_isolated_outliers(z, ["run", "i"], "z", 1.5, 2)
    return out.select("run", "i", "feature", "repaired", fixed("fixed_value").alias("fixed_value"))


@query("W9_rebuild_trajectory", f"""
WITH {ACT}, m AS (SELECT max(i) AS top FROM act)
SELECT run, feature, i, value, CAST(least(i + 1, top - i, 6, top - 5) AS BIGINT) AS copies,
  true AS agrees, true AS gap_free FROM act, m WHERE i < top""")
def rebuilt(t):
    return frames.rebuild_trajectory(frames_of(t), SERIES)


@query("W10_group_held_out_scalers", f"""
WITH {ACT}, x AS (SELECT fold, act.* FROM act, (VALUES (0), (1), (2)) f(fold) WHERE run % 3 <> fold),
med AS (SELECT fold, feature, median(value) AS location FROM x GROUP BY ALL),
fit AS (SELECT fold, feature, any_value(location) AS location,
  CASE WHEN 1.4826 * median(abs(value - location)) > 1e-12 THEN 1.4826 * median(abs(value - location))
       WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1 END AS scale
  FROM x JOIN med USING (fold, feature) GROUP BY ALL)
SELECT run, feature, i, R4((value - location) / scale) AS z FROM act
JOIN fit USING (feature) WHERE fold = run % 3""")
def folds(t):
    rows = t.activity.withColumn("group", (F.col("run") % 3).cast("int"))
    fit = frames.robust_scale(
        frames.held_out_folds(rows, "group", [0, 1, 2]), ["fold", "feature"], "value"
    )
    scored = frames.apply_scale(
        rows.withColumnRenamed("group", "fold"), F.broadcast(fit), ["fold", "feature"], "value"
    )
    return scored.select(*SERIES, "i", fixed("z", 4).alias("z"))


@query("W11_shortest_repeating_period", """
WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) % 3 ORDER BY l_linenumber, l_partkey, l_quantity) AS q
  FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, list_concat(q, q) AS s FROM a),
p AS (SELECT l_orderkey, s, list_filter(range(1, len(s) + 1), lambda p:
  len(list_filter(range(0, len(s)), lambda i: s[i + 1] <> s[i % p + 1])) = 0)[1] AS period FROM s)
SELECT l_orderkey, CAST(period AS BIGINT) AS period, CAST(list_sum(s[1:period]) AS BIGINT) AS total FROM p""")
def period(t):
    q = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        (F.col("l_quantity").cast("bigint") % 3).alias("q"),
    ).groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "q"))),
            lambda x: x["q"],
        ).alias("q")
    ).withColumn("s", F.concat("q", "q"))
    best = q.withColumn("best", frames.shortest_period(F.col("s")))
    return best.select(
        "l_orderkey", F.size("best").cast("bigint").alias("period"),
        F.aggregate("best", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


@query("W12_largest_level_held_out", """
WITH p AS (SELECT o_custkey AS pair, min(o_custkey % 4 + CAST(o_orderkey % 1000 = 0 AS INT)) AS level,
  max(o_custkey % 4 + CAST(o_orderkey % 1000 = 0 AS INT)) AS hi FROM orders GROUP BY 1)
SELECT pair, level, level = hi AS constant, hi = (SELECT max(hi) FROM p) AS held_out FROM p""")
def level_split(t):
    level = F.col("o_custkey") % 4 + (F.col("o_orderkey") % 1000 == 0).cast("int")
    df = t.orders.select(F.col("o_custkey").alias("pair"), level.alias("level"))
    return frames.largest_level_held_out(df, "pair", "level")


@query("B15_fine_and_coarse_views", f"""
WITH {ACT}, f AS (SELECT run, feature, i, lag(value, 9) OVER w AS p0, lag(value, 8) OVER w AS p1,
  lag(value, 1) OVER w AS p8, value AS p9,
  {', '.join(f'lead(value, {j}) OVER w AS f{j}' for j in range(1, 11))}
  FROM act WINDOW w AS (PARTITION BY run, feature ORDER BY i))
SELECT run, feature, i, p0 AS first_patch_0, p1 AS first_patch_1, p8 AS last_patch_0,
  p9 AS last_patch_1, f9 AS future_patch_0, f10 AS future_patch_1,
  R4((f1 + f2 + f3 + f4 + f5) / 5) AS coarse_0, R4((f6 + f7 + f8 + f9 + f10) / 5) AS coarse_1
FROM f WHERE p0 IS NOT NULL AND f10 IS NOT NULL""")
def views(t):
    out = frames.history_future_frames(t.activity, SERIES, 10, 10)
    patch = lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda p: F.slice(c, p * 2 + 1, F.lit(2))
    )
    mean = lambda c, a: F.aggregate(
        F.slice(c, a, 5), F.lit(0.0), lambda s, x: s + x
    ) / 5
    v = out.withColumn("fine", patch(F.col("history"))).withColumn("ahead", patch(F.col("future")))
    at = lambda c, p, j, n: F.get(F.get(c, p), j).alias(n)
    return v.select(
        *SERIES, "i", at("fine", 0, 0, "first_patch_0"), at("fine", 0, 1, "first_patch_1"),
        at("fine", 4, 0, "last_patch_0"), at("fine", 4, 1, "last_patch_1"),
        at("ahead", 4, 0, "future_patch_0"), at("ahead", 4, 1, "future_patch_1"),
        fixed(mean("future", 1), 4).alias("coarse_0"), fixed(mean("future", 6), 4).alias("coarse_1"),
    )


@query("U3_grouped_two_pass_mad", """
WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1)
SELECT event_type, R6(any_value(c)) AS median, R6(1.4826 * median(abs(value - c))) AS mad FROM events JOIN m USING (event_type) GROUP BY 1""")
def two_pass_mad(t):
    """A grouped aggregate with no single-pass form, from one table of value counts."""
    fit = frames.robust_scale(t.events, ["event_type"], "value")
    return fit.select("event_type", fixed("location").alias("median"), fixed("scale").alias("mad"))
