"""Composed jobs: one frame in, one table out, chaining the smaller operators."""

import uuid
from functools import reduce

from pyspark.sql import Window, functions as F

from tidegauge.functions.hashing import identity
from tidegauge.functions.numbers import fixed
from tidegauge.operators import (
    calibration, design, detectors, dynamics, events, features, frames, graph, linear, models, reports, skew, traces, windows,
)
from tidegauge.plans import baselines
from tidegauge.plans.frames import ACTIONS, ROBUST, SERIES, actions_of
from tidegauge.plans.graph_joins import CASE, PATH, wave_cases
from tidegauge.plans.predicates import log_counts
from tidegauge.plans.registry import query
from tidegauge.plans.sequences import ONSET, STOP, spans_of
from tidegauge.plans.views import ACT, DAY, FEATURES, GRID, SCORES, WIDE
from tidegauge.session import materialize, shared_folder


def first_alert_report(t, max_gap=3, quantile=0.95, lookback=6):
    """From points to the first alert of each run with its top three features.

    Right-closed daily windows, bounded fill, robust scaling and threshold from the
    training runs, largest scaled value as score, strict latched alert, evidence
    averaged over the look-back buffer.
    """
    filled = windows.forward_fill(t.grid, SERIES, max_gap).where("filled IS NOT NULL")
    rows = materialize(filled.select("run", "feature", "window_end", F.col("filled").alias("value")))
    train = F.col("run") % 5 != 0
    fit = frames.robust_scale(rows.where(train), ["feature"], "value")
    z = materialize(frames.apply_scale(rows, F.broadcast(fit), ["feature"], "value"))
    score = z.groupBy("run", "window_end").agg(F.max(F.abs("z")).alias("score"))
    cut = skew.exact_quantiles(score.where(train), [], "score", {"threshold": quantile})
    first = score.crossJoin(F.broadcast(cut)).where("score > threshold").groupBy("run").agg(
        F.min("window_end").alias("first_end")
    )
    near = z.join(first, "run").where(
        (F.col("window_end") <= F.col("first_end"))
        & (F.col("window_end") > F.col("first_end") - lookback * DAY)
    )
    evidence = near.groupBy("run", "first_end", "feature").agg(
        fixed(F.abs(F.avg("z")), 5).alias("evidence")
    )
    w = Window.partitionBy("run").orderBy(F.col("evidence").desc(), F.col("feature").desc())
    return evidence.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3")


@query("B0_first_alert_report", f"""
WITH {GRID}, g AS (SELECT *, row_number() OVER (PARTITION BY run, feature ORDER BY window_end) AS rn FROM grid),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS lv, max(CASE WHEN observed THEN rn END) OVER w AS seen FROM g
  WINDOW w AS (PARTITION BY run, feature ORDER BY window_end ROWS UNBOUNDED PRECEDING)),
r AS (SELECT run, feature, window_end, lv AS v FROM f WHERE observed OR rn - seen <= 3),
m AS (SELECT feature, median(v) AS loc FROM r WHERE run % 5 <> 0 GROUP BY feature),
s AS (SELECT feature, any_value(loc) AS loc, CASE WHEN 1.4826 * median(abs(v - loc)) > 1e-12 THEN 1.4826 * median(abs(v - loc))
  WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) ELSE 1 END AS sc FROM r JOIN m USING (feature) WHERE run % 5 <> 0 GROUP BY feature),
z AS (SELECT run, feature, window_end, (v - loc) / sc AS z FROM r JOIN s USING (feature)),
sco AS (SELECT run, window_end, max(abs(z)) AS score FROM z GROUP BY ALL),
th AS (SELECT quantile_cont(score, 0.95) AS thr FROM sco WHERE run % 5 <> 0),
fa AS (SELECT run, min(window_end) AS first_end FROM sco, th WHERE score > thr GROUP BY run),
e AS (SELECT run, first_end, feature, R5(abs(avg(z))) AS evidence FROM z JOIN fa USING (run)
  WHERE window_end <= first_end AND window_end > first_end - {6 * DAY} GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY run ORDER BY evidence DESC, feature DESC) AS rank FROM e QUALIFY rank <= 3""")
def flagship(t):
    return first_alert_report(t)


@query("B1_structured_event_feature_job", f"""
WITH {ACT}, s AS (SELECT run, i, CASE WHEN feature IN ('error', 'purchase') THEN 'backend' ELSE 'frontend' END AS entity,
  ln(1 + sum(n)) AS x FROM act GROUP BY ALL), f AS (SELECT *, {', '.join(f'lag(x, {6 - j}) OVER w AS c{j}' for j in range(6))} FROM s
  WINDOW w AS (PARTITION BY run, entity ORDER BY i))
SELECT run, entity, i, R6(x) AS target, R6(c0) AS oldest, R6(c5) AS latest, CASE WHEN run % 5 = 0 THEN 'validation' ELSE 'training' END AS role
FROM f WHERE c0 IS NOT NULL""")
def event_feature_job(t):
    """Vocabulary on training runs, entity resolution, dense log counts, frames for both roles."""
    rows = t.activity.withColumnRenamed("feature", "template")
    vocabulary = events.fit_vocabulary(
        t.points.where("run % 5 <> 0").select(F.col("feature").alias("template"))
    )
    owners = t.spark.createDataFrame(
        [("error", "backend"), ("purchase", "backend"), ("click", "frontend"),
         ("signup", "frontend"), ("view", "frontend")], "template string, entity string"
    )
    coded = events.encode(rows, vocabulary).join(F.broadcast(owners), "template")
    dense = coded.where("template_id > 0").groupBy("run", "entity", "i").agg(
        F.log1p(F.sum("n")).alias("value")
    )
    f = frames.lookback_frames(dense, ["run", "entity"], 6)
    return f.select(
        "run", "entity", "i", fixed("target").alias("target"), fixed(F.get("context", 0)).alias("oldest"),
        fixed(F.get("context", 5)).alias("latest"),
        F.when(F.col("run") % 5 == 0, "validation").otherwise("training").alias("role"),
    )


@query("B2_metric_corpus_job", f"""
WITH {WIDE}, d AS (SELECT run, i, click / (view + 1) AS click_ratio, error / (view + 1) AS error_ratio FROM wide),
l AS (UNPIVOT d ON click_ratio, error_ratio INTO NAME feature VALUE v),
s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM l WHERE run % 5 <> 0 GROUP BY feature),
z AS (SELECT run, i, feature, (v - m) / s AS z FROM l JOIN s USING (feature)),
f AS (SELECT *, lag(z, 6) OVER w AS oldest FROM z WINDOW w AS (PARTITION BY run, feature ORDER BY i))
SELECT run, feature, i, R5(z) AS target, R5(oldest) AS oldest FROM f WHERE oldest IS NOT NULL""")
def metric_corpus(t):
    ratios = features.condition_on_demand(
        t.wide.select("run", "i", "click", "error", (F.col("view") + 1).alias("view")),
        "view", {"click": "click_ratio", "error": "error_ratio"},
    )
    long = ratios.select("run", "i", F.explode(F.create_map(
        F.lit("click_ratio"), "click_ratio", F.lit("error_ratio"), "error_ratio"
    )).alias("feature", "value"))
    fit = frames.standard_scale(long.where("run % 5 <> 0"), ["feature"], "value")
    z = frames.apply_scale(long, F.broadcast(fit), ["feature"], "value")
    f = frames.lookback_frames(z, SERIES, 6, "z")
    return f.select(*SERIES, "i", fixed("target", 5).alias("target"), fixed(F.get("context", 0), 5).alias("oldest"))


@query("B3_contextual_blocks_job", f"""
WITH {WIDE}, d AS (SELECT run, i, click / greatest(view, 1) AS checkout_completion_ratio, error / (purchase + 1.0::DOUBLE) AS application_error_event_rate FROM wide),
l AS (UNPIVOT d ON checkout_completion_ratio, application_error_event_rate INTO NAME feature VALUE v),
s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM l WHERE run % 5 <> 0 GROUP BY feature),
z AS (SELECT run, i, feature, (v - m) / s AS z FROM l JOIN s USING (feature)),
f AS (SELECT run, feature, i, unnest([1, 3]) AS horizon, unnest([z, lead(z, 2) OVER w]) AS b0, unnest([lead(z, 1) OVER w, lead(z, 3) OVER w]) AS b1
  FROM z WINDOW w AS (PARTITION BY run, feature ORDER BY i))
SELECT run, feature, i, CAST(horizon AS BIGINT) AS horizon, R5(b0) AS b0, R5(b1) AS b1,
  CASE feature WHEN 'checkout_completion_ratio' THEN 'checkout' ELSE 'application' END AS entity FROM f WHERE b1 IS NOT NULL""")
def contextual_blocks(t):
    df = log_counts(t)
    out = features.log_residuals(df)
    names = ["checkout_completion_ratio", "application_error_event_rate"]
    long = df.select("run", "i", F.explode(F.create_map(
        *[x for n in names for x in (F.lit(n), out[n])]
    )).alias("feature", "value"))
    fit = frames.standard_scale(long.where("run % 5 <> 0"), ["feature"], "value")
    z = frames.apply_scale(long, F.broadcast(fit), ["feature"], "value")
    owners = t.spark.createDataFrame(list(zip(names, ["checkout", "application"])), "feature string, entity string")
    bound = graph.bind_features(owners.select("feature"), owners).select("feature", "entity")
    blocks = frames.future_blocks(z, SERIES, [1, 3], 2, "z").join(F.broadcast(bound), "feature")
    return blocks.select(
        *SERIES, "i", F.col("horizon").cast("bigint").alias("horizon"),
        fixed(F.get("block", 0), 5).alias("b0"), fixed(F.get("block", 1), 5).alias("b1"), "entity",
    )


@query("B4_role_sharded_load", """
WITH r AS (SELECT o_custkey AS pair, CASE WHEN o_custkey % 5 = 0 THEN 'validation' ELSE 'training' END AS role, o_orderpriority AS family, o_totalprice FROM orders)
SELECT role, family, count(*) AS "rows", count(DISTINCT pair) AS pairs, 0 AS shared_pairs FROM r GROUP BY role, family""")
def role_sharded(t):
    """Write one shard per (role, family), read them back by partition, check the roles share no pair."""
    role = F.when(F.col("o_custkey") % 5 == 0, "validation").otherwise("training")
    rows = t.orders.select(
        F.col("o_custkey").alias("pair"), role.alias("role"), F.col("o_orderpriority").alias("family"), "o_totalprice"
    )
    loaded = materialize(rows, partition_by=["role", "family"])
    shared = loaded.select("pair", "role").distinct().groupBy("pair").agg(
        F.count(F.lit(1)).alias("n")
    ).agg(F.count_if(F.col("n") > 1).alias("shared_pairs"))
    by = loaded.groupBy("role", "family", "pair").agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy("role", "family").agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("pairs")
    ).crossJoin(F.broadcast(shared))


@query("B5_collection_gate_table", f"""
WITH {PATH}, {CASE}, k AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT (SELECT count(*) FILTER (exact) / count(*) FROM x) AS path_coverage,
  (SELECT avg(b::INT) FROM (SELECT coalesce(max(stop) FILTER (wave = 0) <= min(start) FILTER (wave = 1), false) AS b FROM c GROUP BY batch)) AS barrier_rate,
  (SELECT bool_and(e <= n)::INT FROM k) AS counts_consistent, (SELECT max(e / n) FROM k) AS worst_error_rate)
SELECT 'path_coverage' AS gate, R6(path_coverage) AS observed, 0.9::DOUBLE AS "limit", path_coverage >= 0.9 AS passed FROM g
UNION ALL SELECT 'barrier_rate', R6(barrier_rate), 1, barrier_rate >= 1 FROM g
UNION ALL SELECT 'counts_consistent', counts_consistent, 1, counts_consistent >= 1 FROM g
UNION ALL SELECT 'worst_error_rate', R6(worst_error_rate), 0.5, worst_error_rate <= 0.5 FROM g""")
def collection_gates(t):
    path = traces.exact_path(spans_of(t), ["user", "assistant"]).agg(
        (F.count_if("exact") / F.count(F.lit(1))).alias("path_coverage")
    )
    wave = design.wave_barrier(wave_cases(t)).agg(
        F.avg(F.col("barrier").cast("int")).alias("barrier_rate")
    )
    k = t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("e"), F.count(F.lit(1)).alias("n")
    ).agg(
        F.bool_and(F.col("e") <= F.col("n")).cast("int").alias("counts_consistent"),
        F.max(F.col("e") / F.col("n")).alias("worst_error_rate"),
    )
    gates = calibration.gate_table(path.crossJoin(wave).crossJoin(k), [
        ("path_coverage", "path_coverage", ">=", 0.9), ("barrier_rate", "barrier_rate", ">=", 1),
        ("counts_consistent", "counts_consistent", ">=", 1), ("worst_error_rate", "worst_error_rate", "<=", 0.5),
    ])
    return gates.withColumn("observed", fixed("observed"))


@query("B6_plan_manifest_attestation", """
WITH p AS (SELECT c_custkey AS id, c_nationkey AS n FROM customer), m AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT o_custkey AS id, max(o_totalprice) > 490000 AS late FROM orders GROUP BY 1)
SELECT coalesce(p.id, m.id, a.id) AS id, p.id IS NOT NULL AS planned, m.id IS NOT NULL AS captured, a.id IS NOT NULL AS attested,
  sha256('{"id":' || coalesce(p.id, m.id, a.id) || ',"n":' || n || '}') AS binding FROM p FULL JOIN m ON m.id = p.id FULL JOIN a ON a.id = coalesce(p.id, m.id)""")
def three_way(t):
    p = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.lit(True).alias("_p"))
    m = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id")).distinct().withColumn("_m", F.lit(True))
    a = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("_a"))
    both = p.join(m, "id", "full_outer").join(a, "id", "full_outer")
    return both.select(
        "id", F.col("_p").isNotNull().alias("planned"), F.col("_m").isNotNull().alias("captured"),
        F.col("_a").isNotNull().alias("attested"),
        F.when(F.col("n").isNotNull(), identity(["id", "n"])).alias("binding"),
    )


@query("B7_attribution_query_builder", f"""
WITH {SCORES}, q AS (SELECT run // 2 AS pair, run, i, score FROM scores WHERE i = (8 + (run // 2 * 2 + 1) % 5) - 1
  AND run // 2 * 2 + 1 IN (SELECT run FROM scores)), lib AS (SELECT kind, magnitude FROM (VALUES ('stall'), ('flood'), ('leak'), ('none')) k(kind), (VALUES (1), (4)) m(magnitude))
SELECT pair, run % 2 = 1 AS is_treatment, i, score, kind, magnitude FROM q, lib""")
def attribution_queries(t):
    """One query per arm at the step before the pair's onset, with every declared candidate."""
    rows = t.scores.withColumn("pair", F.expr("run div 2"))
    treated = rows.where("run % 2 = 1").select("pair", (8 + F.col("run") % 5 - 1).alias("i")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("stall", "flood", "leak", "none")])).alias("kind")
    return rows.join(treated, ["pair", "i"]).select(
        "pair", (F.col("run") % 2 == 1).alias("is_treatment"), "i", "score", kinds
    ).select("*", F.explode(F.array(F.lit(1), F.lit(4))).alias("magnitude"))


@query("U4_action_schedule_expansion", f"""
WITH {ACTIONS} SELECT run, feature, kind, i, i = start_i AS is_start FROM (SELECT *, unnest(range(start_i, stop_i)) AS i FROM actions)""")
def schedule(t):
    """Interval rows expanded to one row per active step."""
    return actions_of(t).select(
        "run", "feature", "kind", "start_i", F.explode(F.sequence(F.col("start_i"), F.col("stop_i") - 1)).alias("i")
    ).select("run", "feature", "kind", "i", (F.col("i") == F.col("start_i")).alias("is_start"))


@query("U2_feature_adapters", f"""
WITH {WIDE} SELECT run, i, 'identity' AS adapter, CAST(click AS DOUBLE) AS value FROM wide
UNION ALL SELECT run, i, 'demand', R6(click / (view + 1)) FROM wide""")
def adapters(t):
    """Adapters are plain frame functions, applied with ``transform``."""
    def plain(df):
        return df.select("run", "i", F.lit("identity").alias("adapter"), F.col("click").cast("double").alias("value"))

    def demand(df):
        return df.select("run", "i", F.lit("demand").alias("adapter"), fixed(F.col("click") / (F.col("view") + 1)).alias("value"))

    return t.wide.transform(plain).unionByName(t.wide.transform(demand))


RAW_SCORES = """d AS (SELECT act.*, lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS p FROM act),
s AS (SELECT 'persistence' AS kind, run, i, R6(sqrt(avg(pow(value - p, 2)))) AS score FROM d WHERE i >= 6 GROUP BY run, i
  UNION ALL SELECT 'robust', run, i, R6(max(abs((value - location) / scale))) FROM act JOIN rob USING (feature) WHERE i >= 6 GROUP BY run, i)"""


def raw_frames(t):
    """Frames of unscaled feature vectors."""
    return materialize(detectors.vector_frames(detectors.vector_steps(t.activity_table, "value"), 6))


def stored_and_restored(t, fitted):
    """The models as a registry gives them back after they were written."""
    folder = f"{shared_folder(t.spark)}/tidegauge/models-{uuid.uuid4().hex}"
    models.save(t.spark, fitted, folder)
    return {name: models.load(t.spark, folder, name) for name in fitted}


@query("U1_fitted_model_registry")
def model_registry(t):
    """Latent models written, read back by name and scored again: parameters, threshold, alerts."""
    f = baselines.frames_table(t)
    train = f.where("run % 5 <> 0")
    fitted = {kind: models.fit_latent(train, len(FEATURES), 6, coherent=kind == "coherent") for kind in ("latent", "coherent")}
    return reduce(lambda a, b: a.unionByName(b), [
        models.score(f, m).agg(
            F.lit(name).alias("kind"), F.lit(m.parameter_count()).alias("parameters"),
            fixed(F.lit(m.numbers["threshold"])).alias("threshold"), F.count_if("alert").alias("alerts"),
        ) for name, m in stored_and_restored(t, fitted).items()
    ])


@query("U1_stored_closed_form_models", f"""
WITH {ACT}, {ROBUST}, {RAW_SCORES},
th AS (SELECT kind, R6(quantile_cont(score, 0.99)) AS threshold FROM s WHERE run % 5 <> 0 GROUP BY kind)
SELECT s.kind, CASE WHEN s.kind = 'robust' THEN 2 * (SELECT count(DISTINCT feature) FROM act) ELSE 0 END AS parameters, any_value(threshold) AS threshold,
  count(*) AS points, count(*) FILTER (score > threshold) AS alerts FROM s JOIN th USING (kind) GROUP BY s.kind""")
def closed_form_registry(t):
    """Persistence and robust detectors, calibrated on training runs, stored, restored and applied to all runs."""
    f = raw_frames(t)
    train = f.where("run % 5 <> 0")
    scale = frames.robust_scale(t.activity_table, ["feature"], "value")
    fitted = {"persistence": models.fit_persistence(train, len(FEATURES)), "robust": models.fit_robust(train, scale)}
    return reduce(lambda a, b: a.unionByName(b), [
        models.score(f, m).agg(
            F.lit(name).alias("kind"), F.lit(m.parameter_count()).cast("bigint").alias("parameters"), F.lit(m.numbers["threshold"]).alias("threshold"),
            F.count(F.lit(1)).alias("points"), F.count_if("alert").alias("alerts"),
        ) for name, m in stored_and_restored(t, fitted).items()
    ])


RIDGES = [0.0, 10.0, 1000.0, 100000.0]


@query("B8_candidate_selection", f"""
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem WHERE l_orderkey % 5 <> 0),
b AS (SELECT r AS ridge, sum((l_quantity - mx) * (l_extendedprice - my)) / (sum(pow(l_quantity - mx, 2)) + r) AS slope, any_value(mx) AS mx, any_value(my) AS my
  FROM lineitem, m, (VALUES (0.0), (10.0), (1000.0), (100000.0)) v(r) WHERE l_orderkey % 5 <> 0 GROUP BY r),
e AS (SELECT ridge, avg(pow(l_extendedprice - (my + slope * (l_quantity - mx)), 2)) AS mse FROM lineitem, b WHERE l_orderkey % 5 = 0 GROUP BY ridge)
SELECT CAST(ridge AS DOUBLE) AS ridge, R1(mse) AS mse, row_number() OVER (ORDER BY mse, ridge) = 1 AS selected FROM e""")
def candidate_selection(t):
    """A ridge grid fitted and scored from two Gram matrices; the first of equals wins."""
    v = F.array("l_quantity", F.lit(1.0), "l_extendedprice")
    rows = t.lineitem.select((F.col("l_orderkey") % 5 != 0).alias("train"), v.alias("v"))
    g = linear.gram_matrices(rows, "v", 3, ["train"])
    out = []
    for r in RIDGES:
        w = linear.solve_ridge(g[True], [0, 1], [2], r, free=1)
        out.append((r, float(linear.residual_mse(g[False], [0, 1], [2], w, g[False][1, 1])[0])))
    best = min(out, key=lambda x: (x[1], x[0]))[0]
    return t.spark.createDataFrame([(r, m, r == best) for r, m in out], "ridge double, mse double, selected boolean").select(
        "ridge", fixed("mse", 1).alias("mse"), "selected"
    )


@query("B9_action_conditioning_sanity")
def conditioning_sanity(t):
    """Loss with the right, absent and pair-shuffled actions; win share of the right ones."""
    steps = baselines.action_steps(t)
    g = dynamics.joint_gram(baselines.training(dynamics.transitions(steps)), baselines.LAYOUT)
    w = dynamics.fit_dense(g, baselines.LAYOUT)
    rows = dynamics.rollout_frames(steps.where("run % 5 = 0"), 5)
    strata = steps.select("run", (F.col("run") % 2).alias("arm")).distinct()
    donors = design.derangement(strata, ["arm"], "run").where("donor IS NOT NULL")
    other = rows.select(F.col("run").alias("donor"), "i", F.col("actions").alias("_a"))
    shuffled = rows.join(donors.select("run", "donor"), "run").join(other, ["donor", "i"]).withColumn(
        "actions", F.col("_a")
    )
    variants = {
        "correct": rows, "absent": rows.withColumn("actions", F.transform("actions", lambda x: F.lit(0.0))),
        "shuffled": shuffled,
    }
    cols = ["run", "i", "state", "controls", "actions", "observed"]
    out = reduce(lambda a, b: a.unionByName(b), [
        dynamics.errors_long(dynamics.rollout(v.select(*cols), baselines.LAYOUT, w), baselines.LAYOUT)
        .groupBy("run").agg(F.avg("sq").alias("loss")).withColumn("variant", F.lit(k))
        for k, v in variants.items()
    ])
    p = out.groupBy("run").pivot("variant", list(variants)).agg(F.first("loss"))
    return p.agg(
        *[fixed(F.avg(k), 5).alias(f"{k}_loss") for k in variants],
        fixed(F.avg((F.col("correct") <= F.col("absent")).cast("int"))).alias("beats_absent"),
        fixed(F.avg((F.col("correct") <= F.col("shuffled")).cast("int"))).alias("beats_shuffled"),
    )


B10 = """d AS (SELECT run // 2 % 6 AS family, run // 12 % 4 AS seed, avg(score) FILTER (run % 2 = 1) - avg(score) FILTER (run % 2 = 0) AS d
  FROM scores GROUP BY ALL),
f AS (SELECT family, avg(d) AS d, R6(count(*) FILTER (d < 0) / count(*)) AS win_fraction FROM d WHERE d IS NOT NULL GROUP BY family)"""


@query("B10_multi_seed_confirmation", f"""
WITH {SCORES}, {B10}, k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j FROM f), n AS (SELECT count(*) AS n, sum(d) AS obs FROM f),
p AS (SELECT x.id, sum(CASE WHEN (x.id >> j) & 1 = 1 THEN -d ELSE d END) AS s FROM range(0, 64) x(id), k GROUP BY x.id)
SELECT family, R5(d) AS mean_difference, win_fraction, d = max(d) OVER () AS is_worst,
  (SELECT R9(count(*) FILTER (s <= obs + 1e-9) / count(*)) FROM p, n) AS p_value FROM f""")
def multi_seed(t):
    """Family means over seeds, share of seeds won, worst family, exact randomisation p-value."""
    arm = lambda k: F.avg(F.when(F.col("run") % 2 == k, F.col("score")))
    d = t.scores.groupBy(
        F.expr("run div 2 % 6").alias("family"), F.expr("run div 12 % 4").alias("seed")
    ).agg((arm(1) - arm(0)).alias("d")).where("d IS NOT NULL")
    f = d.groupBy("family").agg(
        F.avg("d").alias("d"), fixed(F.count_if(F.col("d") < 0) / F.count(F.lit(1))).alias("win_fraction")
    )
    f = materialize(f)
    p = calibration.exact_sign_flip(f, "d").select(fixed("p_value", 9).alias("p_value"))
    worst = f.agg(F.max("d").alias("_w"))
    return f.crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(p)).select(
        "family", fixed("d", 5).alias("mean_difference"), "win_fraction",
        (F.col("d") == F.col("_w")).alias("is_worst"), "p_value",
    )


@query("B12_forecast_study")
def forecast_study(t):
    """Graph, dense, no-action and persistence roll-outs by model and horizon step, with gates."""
    steps = baselines.action_steps(t)
    _, models = baselines._models(t, steps)
    rows = dynamics.rollout_frames(steps.where("run % 5 = 0"), 5)
    rolled = {k: dynamics.rollout(rows, baselines.LAYOUT, w) for k, w in models.items()}
    rolled["persistence"] = dynamics.persistence_rollout(rows, 5)
    errors = reduce(lambda a, b: a.unionByName(b), [
        dynamics.errors_long(r, baselines.LAYOUT).withColumn("model", F.lit(k)) for k, r in rolled.items()
    ])
    panel = errors.groupingSets([["model"], ["model", "step"]], "model", "step").agg(
        F.avg("sq").alias("mse")
    )
    panel = panel.withColumn("step", F.coalesce("step", F.lit(0)))
    base = panel.where("model = 'persistence'").select("step", F.col("mse").alias("_b"))
    return panel.join(base, "step").select(
        "model", F.when(F.col("step") > 0, F.col("step")).alias("step"), fixed("mse", 5).alias("mse"),
        (F.col("mse") <= F.col("_b")).alias("beats_persistence"),
    )


@query("B13_detector_bake_off", f"""
WITH {ACT}, {ROBUST}, d AS (SELECT act.*, lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS p FROM act),
s AS (SELECT 'persistence' AS detector, run, i, R4(sqrt(avg(pow(value - p, 2)))) AS score FROM d WHERE i >= 6 GROUP BY run, i
  UNION ALL SELECT 'robust', run, i, R4(max(abs((value - location) / scale))) FROM act JOIN rob USING (feature) WHERE i >= 6 GROUP BY run, i),
th AS (SELECT detector, quantile_cont(score, 0.95) AS thr FROM s WHERE run % 5 <> 0 GROUP BY detector),
x AS (SELECT s.*, score > thr AS alert, i >= {ONSET} AND i < {STOP} AS structural FROM s JOIN th USING (detector)),
r AS (SELECT detector, run, bool_or(alert AND structural) AS hit, min(i) FILTER (alert AND structural) - any_value({ONSET}) AS delay FROM x GROUP BY ALL)
SELECT detector, R6(count(*) FILTER (alert AND NOT structural) / count(*) FILTER (NOT structural)) AS normal_alert_rate,
  R6(count(*) FILTER (alert AND structural) / count(*) FILTER (structural)) AS structural_alert_rate,
  (SELECT R6(avg(hit::INT)) FROM r WHERE r.detector = x.detector) AS event_recall, (SELECT R6(avg(delay)) FROM r WHERE r.detector = x.detector) AS mean_delay
FROM x GROUP BY detector""")
def bake_off(t):
    """Same frames, two detectors, one metrics table."""
    rows = t.activity_table
    plain = detectors.vector_frames(detectors.vector_steps(rows, "value"), 6)
    fit = frames.robust_scale(rows, ["feature"], "value")
    z = frames.apply_scale(rows, F.broadcast(fit), ["feature"], "value")
    scaled = detectors.vector_frames(detectors.vector_steps(z), 6)
    n = len(FEATURES)
    scores = detectors.persistence_score(plain, n).select("run", "i", "score", F.lit("persistence").alias("detector")).unionByName(
        detectors.robust_score(scaled).select("run", "i", "score", F.lit("robust").alias("detector"))
    ).withColumn("score", fixed("score", 4))
    scores = materialize(scores)
    thr = skew.exact_quantiles(scores.where("run % 5 <> 0"), ["detector"], "score", {"thr": 0.95})
    onset = 8 + F.col("run") % 5
    during = (F.col("i") >= onset) & (F.col("i") < 12 + F.col("run") % 5 + F.col("run") % 3)
    x = scores.join(F.broadcast(thr), "detector").select(
        "detector", "run", "i", (F.col("score") > F.col("thr")).alias("alert"), during.alias("structural"), onset.alias("onset")
    )
    both = F.col("alert") & F.col("structural")
    rates = x.groupBy("detector").agg(
        fixed(F.count_if(F.col("alert") & ~F.col("structural")) / F.count_if(~F.col("structural"))).alias("normal_alert_rate"),
        fixed(F.count_if(both) / F.count_if("structural")).alias("structural_alert_rate"),
    )
    runs = x.groupBy("detector", "run").agg(
        F.bool_or(both).alias("hit"), (F.min(F.when(both, F.col("i"))) - F.first("onset")).alias("delay")
    ).groupBy("detector").agg(
        fixed(F.avg(F.col("hit").cast("int"))).alias("event_recall"), fixed(F.avg("delay")).alias("mean_delay")
    )
    return rates.join(runs, "detector")


NOISE = (20, 26)
AFFECTED = "[['click', 'error', 'purchase', 'signup', 'view'][run % 5 + 1], ['click', 'error', 'purchase', 'signup', 'view'][(run + 2) % 5 + 1]]"


def fault_intervals(t):
    """One structural interval per run with the two features that it affects, and one of routine noise."""
    run = F.col("run")
    name = lambda k: F.element_at(F.array(*[F.lit(f) for f in FEATURES]), (k % 5 + 1).cast("int"))
    runs = t.events.select(F.col("user_id").alias("run")).distinct()
    fault = runs.select(
        "run", F.lit("structural").alias("phase"), (8 + run % 5).alias("start_i"), (12 + run % 5 + run % 3).alias("stop_i"), F.array(name(run), name(run + 2)).alias("affected"),
    )
    noise = runs.select("run", F.lit("routine_noise").alias("phase"), F.lit(NOISE[0]).cast("bigint").alias("start_i"), F.lit(NOISE[1]).cast("bigint").alias("stop_i"), F.array().cast("array<string>").alias("affected"))
    return fault.unionByName(noise)


def detector_scores(t, fitted, f):
    """Scores, alerts and evidence of several stored models over the same frames."""
    rows = [
        models.score(f, m, digits=4).select(
            F.lit(name).alias("detector"), "run", "i", "score", "alert", "evidence", F.lit(m.kind in ("latent", "coherent")).alias("signed"),
        ) for name, m in fitted.items()
    ]
    return materialize(reduce(lambda a, b: a.unionByName(b), rows))


@query("C15_event_report", f"""
WITH {ACT}, {ROBUST}, d AS (SELECT act.*, lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS p FROM act),
e AS (SELECT 'persistence' AS detector, run, i, feature, abs(value - p) AS e FROM d WHERE i >= 6
  UNION ALL SELECT 'robust', run, i, feature, abs((value - location) / scale) FROM act JOIN rob USING (feature) WHERE i >= 6),
s AS (SELECT detector, run, i, R4(CASE WHEN detector = 'robust' THEN max(e) ELSE sqrt(avg(e * e)) END) AS score FROM e GROUP BY detector, run, i),
th AS (SELECT detector, R4(quantile_cont(score, 0.95)) AS thr FROM s WHERE run % 5 <> 0 GROUP BY detector),
x AS (SELECT s.*, score > thr AS alert, {ONSET} AS start_i, i >= {ONSET} AND i < {STOP} AS structural, i >= {NOISE[0]} AND i < {NOISE[1]} AND NOT (i >= {ONSET} AND i < {STOP}) AS noise FROM s JOIN th USING (detector)),
ev AS (SELECT detector, run, min(i) AS begin_i, min(i) FILTER (alert) AS first_i FROM x WHERE structural GROUP BY ALL),
near AS (SELECT ev.detector, ev.run, feature, R6(avg(e)) AS e FROM ev JOIN e ON e.detector = ev.detector AND e.run = ev.run AND e.i <= first_i AND e.i > first_i - 6 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY detector, run ORDER BY e DESC, feature DESC) AS rank FROM near),
hits AS (SELECT detector, run, count(*) FILTER (list_contains({AFFECTED}, feature)) AS hits FROM top WHERE rank <= 3 GROUP BY ALL),
event AS (SELECT detector, count(*) AS events, count(first_i) AS detected, R6(avg(first_i - begin_i)) AS mean_delay,
  R6(avg(CASE WHEN first_i IS NOT NULL THEN (hits > 0)::INT END)) AS hit_at_3, R6(avg(CASE WHEN first_i IS NULL THEN 0 ELSE hits / 2.0 END)) AS recall_at_3
  FROM ev LEFT JOIN hits USING (detector, run) GROUP BY detector),
ep AS (SELECT detector, run, i - row_number() OVER (PARTITION BY detector, run ORDER BY i) AS g, structural FROM x WHERE alert),
epi AS (SELECT detector, count(*) AS episodes, count(*) FILTER (NOT met) AS false_episodes FROM (SELECT detector, run, g, bool_or(structural) AS met FROM ep GROUP BY ALL) GROUP BY detector),
pt AS (SELECT detector, count(*) FILTER (noise) AS noise_points, R6(count(*) FILTER (noise AND alert) / count(*) FILTER (noise)) AS noise_alert_rate,
  R6(count(*) FILTER (alert AND NOT noise AND NOT structural) / count(*) FILTER (NOT noise AND NOT structural)) AS normal_alert_rate,
  R6(count(*) FILTER (alert AND structural) / count(*) FILTER (structural)) AS structural_alert_rate,
  R4(quantile_cont(score, 0.5) FILTER (noise)) AS median_noise_score, R4(quantile_cont(score, 0.5) FILTER (structural)) AS median_structural_score FROM x GROUP BY detector)
SELECT detector, noise_points, noise_alert_rate, normal_alert_rate, structural_alert_rate, median_noise_score, median_structural_score, events, detected,
  R6(detected / events) AS event_recall, mean_delay, hit_at_3, recall_at_3, episodes, false_episodes FROM pt JOIN event USING (detector) JOIN epi USING (detector)""")
def event_report(t):
    """Point rates, event recall, delay, attribution and alert episodes of the two closed-form detectors."""
    f = raw_frames(t)
    train = f.where("run % 5 <> 0")
    scale = frames.robust_scale(t.activity_table, ["feature"], "value")
    fitted = {"persistence": models.fit_persistence(train, len(FEATURES), 0.95, 4), "robust": models.fit_robust(train, scale, 0.95, 4)}
    return reports.rounded(reports.event_report(detector_scores(t, fitted, f), fault_intervals(t), FEATURES, 6))


@query("B13_four_detectors")
def four_detectors(t):
    """Persistence, robust, latent and coherent detectors over the same standard-scaled frames, with the coherent one's gates."""
    f = baselines.frames_table(t)
    train = f.where("run % 5 <> 0")
    unit = t.spark.createDataFrame([(n, 0.0, 1.0) for n in FEATURES], "feature string, location double, scale double")
    fitted = {
        "persistence": models.fit_persistence(train, len(FEATURES)), "robust": models.fit_robust(train, unit),
        "latent": models.fit_latent(train, len(FEATURES), 6), "coherent": models.fit_latent(train, len(FEATURES), 6, coherent=True),
    }
    table = materialize(reports.event_report(detector_scores(t, stored_and_restored(t, fitted), f), fault_intervals(t), FEATURES, 6))
    passed = reports.gates(table, "coherent", "persistence", len(FEATURES), 2)
    return reports.rounded(table).crossJoin(F.broadcast(passed))
