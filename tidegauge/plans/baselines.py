"""Detectors and linear models over the activity grid, lineitem and embeddings."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F

from tidegauge.functions.numbers import fixed
from tidegauge.operators import alerts, detectors, drift, dynamics, frames, linear, skew
from tidegauge.plans.frames import ROBUST, actions_of
from tidegauge.plans.registry import query
from tidegauge.plans.views import ACT, FEATURES
from tidegauge.session import materialize

LOOKBACK = 6
N = len(FEATURES)


def standard_steps(t, source=None):
    """Standard-scaled feature vectors per (run, day); scaler from the training runs."""
    rows = t.activity_table if source is None else source
    fit = frames.standard_scale(rows.where("run % 5 <> 0"), ["feature"], "value")
    z = frames.apply_scale(rows, F.broadcast(fit), ["feature"], "value")
    return detectors.vector_steps(z)


def frames_table(t):
    return materialize(detectors.vector_frames(standard_steps(t), LOOKBACK))


@query("M1_persistence_detector", f"""
WITH {ACT}, d AS (SELECT run, i, value - lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS d FROM act)
SELECT run, i, R4(sqrt(avg(d * d))) AS score FROM d WHERE i >= 6 GROUP BY ALL""")
def persistence(t):
    steps = detectors.vector_steps(t.activity, "value")
    f = detectors.vector_frames(steps, LOOKBACK)
    return detectors.persistence_score(f, N).select("run", "i", fixed("score", 4).alias("score"))


@query("M2_robust_detector", f"""
WITH {ACT}, {ROBUST} SELECT run, i, R4(max(abs((value - location) / scale))) AS score
FROM act JOIN rob USING (feature) WHERE i >= 6 GROUP BY ALL""")
def robust(t):
    rows = t.activity
    fit = frames.robust_scale(rows, ["feature"], "value")
    z = frames.apply_scale(rows, F.broadcast(fit), ["feature"], "value")
    f = detectors.vector_frames(detectors.vector_steps(z), LOOKBACK)
    return detectors.robust_score(f).select("run", "i", fixed("score", 4).alias("score"))


@query("M3_ridge_regression", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / (sum(pow(l_quantity - mx, 2)) + 10) AS slope,
  any_value(mx) AS mx, any_value(my) AS my FROM lineitem, m)
SELECT l_orderkey, l_linenumber, l_partkey, R3(my - slope * mx + slope * l_quantity) AS predicted FROM lineitem, b""")
def ridge(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array("l_quantity", "l_extendedprice").alias("v"),
    )
    w, intercept = linear.one_moments(rows, "v", 2).ridge([0], [1], 10.0)
    predicted = F.get("v", 0) * float(w[0, 0]) + float(intercept[0])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", fixed(predicted, 3).alias("predicted"))


@query("M4_latent_detector")
def latent(t):
    f = frames_table(t)
    model = detectors.fit_latent(f.where("run % 5 <> 0"), N, LOOKBACK, latent=3)
    return detectors.score_latent(f, model).select("run", "i", fixed("score", 4).alias("score"), "alert")


def coherent_scores(t):
    f = frames_table(t)
    model = detectors.fit_latent(f.where("run % 5 <> 0"), N, LOOKBACK, latent=2, coherent=True)
    return detectors.score_latent(f, model)


@query("M5_coherent_detector")
def coherent(t):
    return coherent_scores(t).select("run", "i", fixed("score", 4).alias("score"), "alert")


@query("M6_demand_conditioned_detector")
def demand_conditioned(t):
    from tidegauge.operators import features
    from tidegauge.plans.predicates import daily_rates

    out = features.condition_on_demand(daily_rates(t), "request_rate")
    day = F.timestamp_micros("day")
    long = out.select(
        F.year(day).cast("bigint").alias("run"), F.dayofyear(day).cast("bigint").alias("i"),
        F.explode(F.create_map(
            F.lit("worker"), "worker_completion_ratio", F.lit("db"), "db_write_completion_ratio"
        )).alias("feature", "value"),
    )
    rows = materialize(long)
    fit = frames.robust_scale(rows, ["feature"], "value")
    z = frames.apply_scale(rows, F.broadcast(fit), ["feature"], "value")
    f = materialize(detectors.vector_frames(detectors.vector_steps(z), LOOKBACK))
    model = detectors.fit_latent(
        f, 2, LOOKBACK, latent=1, quantile=0.98, coherent=True, floor=1e-3, fallback=1e-3, widen=2.0
    )
    return detectors.score_latent(f, model).select("run", "i", fixed("score", 4).alias("score"), "alert")


LAYOUT = dynamics.Layout(entities=N, controls=1, action_width=2)
RING = [sorted({e, (e - 1) % N}) for e in range(N)]
BOTH = [sorted({(e - 1) % N, e, (e + 1) % N}) for e in range(N)]


def action_steps(t):
    """State, control (scaled total count) and (applicable, magnitude) action per step."""
    rows = t.activity_table
    acts = actions_of(t).withColumn("scaled_magnitude", F.col("magnitude") / 7.0).drop("magnitude")
    treated = acts.where("run % 2 = 1")
    a = frames.encode_actions(rows.select("run", "feature", "i"), treated, ["run", "feature"])
    action = a.groupBy("run", "i").agg(
        F.array_sort(F.collect_list(F.struct(
            "feature", F.col("applicable").cast("double").alias("on"), "magnitude"
        ))).alias("a")
    ).select("run", "i", F.flatten(F.transform("a", lambda x: F.array(x["on"], x["magnitude"]))).alias("action"))
    control = rows.groupBy("run", "i").agg(F.array(F.sum("n") / 5.0).alias("control"))
    steps = standard_steps(t, rows)
    return materialize(steps.join(control, ["run", "i"]).join(action, ["run", "i"]))


def training(rows):
    return rows.where("run % 5 <> 0")


def _models(t, steps):
    g = dynamics.joint_gram(training(dynamics.transitions(steps)), LAYOUT)
    dense = dynamics.fit_dense(g, LAYOUT)
    low = dynamics.fit_low_rank(g, LAYOUT, rank=2)
    return g, {
        "graph": dynamics.fit_graph(g, LAYOUT, RING),
        "no_action": dynamics.fit_graph(g, LAYOUT, RING, actions=False),
        "dense": dense,
        "low_rank": low,
    }


def _mse_frame(t, named):
    rows = [(m, FEATURES[e], float(v)) for m, mse in named.items() for e, v in enumerate(mse)]
    return t.spark.createDataFrame(rows, "model string, entity string, mse double").withColumn(
        "mse", fixed("mse")
    )


def _validation(steps):
    return dynamics.joint_gram(dynamics.transitions(steps).where("run % 5 = 0"), LAYOUT)


@query("M7_graph_varx_one_step")
def graph_varx(t):
    steps = action_steps(t)
    _, models = _models(t, steps)
    v = _validation(steps)
    return _mse_frame(t, {k: dynamics.one_step_mse(v, LAYOUT, models[k]) for k in ("graph", "no_action")})


@query("M8_dense_and_low_rank_rollout")
def dense_rollout(t):
    steps = action_steps(t)
    _, models = _models(t, steps)
    rows = dynamics.rollout_frames(steps.where("run % 5 = 0"), 5)
    out = None
    for name in ("dense", "low_rank"):
        e = dynamics.errors_long(dynamics.rollout(rows, LAYOUT, models[name]), LAYOUT)
        e = e.groupBy("step").agg(fixed(F.avg("sq"), 4).alias("mse")).withColumn("model", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out


@query("M9_bounded_graph_residual")
def graph_residual(t):
    steps = action_steps(t)
    g, models = _models(t, steps)
    fix = dynamics.fit_graph_residual(g, LAYOUT, models["low_rank"], BOTH)
    rows = dynamics.rollout_frames(steps.where("run % 5 = 0"), 5)
    rolled = dynamics.rollout(rows, LAYOUT, models["low_rank"], correction=fix, bound=0.5)
    return dynamics.errors_long(rolled, LAYOUT).groupBy("step").agg(
        fixed(F.avg("sq"), 4).alias("mse")
    )


@query("M10_input_mask_ablation")
def ablation(t):
    steps = action_steps(t)
    g = dynamics.joint_gram(training(dynamics.transitions(steps)), LAYOUT)
    v = _validation(steps)
    named = {"full": dynamics.one_step_mse(v, LAYOUT, dynamics.fit_dense(g, LAYOUT))}
    for e, f in enumerate(FEATURES):
        w = dynamics.fit_dense(g, LAYOUT, masked=[e])
        named[f"without_{f}"] = dynamics.one_step_mse(v, LAYOUT, w)
    return _mse_frame(t, named)


@query("M11_persistence_rollout", f"""
WITH {ACT}, h AS (SELECT unnest(range(1, 6)) AS step)
SELECT a.run, a.feature, a.i, step, a.value AS predicted, b.value AS observed FROM act a, h
JOIN act b ON b.run = a.run AND b.feature = a.feature AND b.i = a.i + step
WHERE a.i + 5 <= (SELECT max(i) FROM act)""")
def persistence_rollout(t):
    f = frames.history_future_frames(t.activity, ["run", "feature"], 1, 5)
    return f.select(
        "run", "feature", "i", F.get("history", 0).alias("predicted"),
        F.posexplode("future").alias("p", "observed"),
    ).select("run", "feature", "i", (F.col("p") + 1).cast("bigint").alias("step"), "predicted", "observed")


def embedded(t):
    return t.embeddings.select(
        "vec_id", "label", F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("v")
    )


def plain_vectors(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def dimension(t):
    """Length of all vectors; tables of mixed lengths are refused."""
    sizes = t.embeddings.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError(f"vectors of {sizes.low} to {sizes.high} components")
    return sizes.low


@query("A20_covariance_diagnostics")
def covariance_report(t):
    _, cov = linear.one_moments(plain_vectors(t), "v", dimension(t)).covariance(ddof=1)
    found = linear.covariance_diagnostics(cov)
    return t.spark.createDataFrame([found]).select(*[fixed(c).alias(c) for c in sorted(found)])


@query("A20_participation_rank", """
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
c AS (SELECT a.p AS i, b.p AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
SELECT R4(pow(sum(c) FILTER (i = j), 2) / sum(c * c)) AS participation_rank FROM c""")
def participation(t):
    _, cov = linear.one_moments(plain_vectors(t), "v", dimension(t)).covariance(ddof=1)
    value = float(np.trace(cov) ** 2 / np.sum(cov * cov))
    return t.spark.createDataFrame([(value,)], "v double").select(fixed("v", 4).alias("participation_rank"))


def _axes(key, m, width):
    _, cov = m.covariance()
    axes, values = linear.principal_axes(cov, width)
    return pd.DataFrame({
        "fit": f"label:{int(key[0])}" if key else "all", "component": np.arange(len(axes), dtype=np.int32),
        "explained": values / np.trace(cov), "largest_loading": np.abs(axes).max(axis=1),
    })


_AXES = "fit string, component int, explained double, largest_loading double"


def _pca(rows, width):
    """Leading axes of all rows and of each label's, every fit on an executor."""
    per = linear.keyed_fits(rows, "v", ["label"], lambda key, m: _axes(key, m, width), _AXES)
    whole = linear.keyed_fits(rows, "v", [], lambda key, m: _axes(key, m, width), _AXES)
    return per.unionByName(whole).select("fit", "component", fixed("explained").alias("explained"), fixed("largest_loading").alias("largest_loading"))


@query("M12_pca_global_and_per_label")
def pca(t):
    return _pca(plain_vectors(t), 4)


TWO_AXES = """two AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"""


@query("M12_two_axis_pca", f"""
WITH {TWO_AXES}, f AS (SELECT 'label:' || label AS fit, x, y FROM two UNION ALL SELECT 'all', x, y FROM two),
c AS (SELECT fit, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM f GROUP BY fit),
e AS (SELECT *, (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS hi FROM c),
v AS (SELECT *, greatest(abs(c), abs(hi - a)) / sqrt(c * c + (hi - a) * (hi - a)) AS load FROM e)
SELECT fit, k::INT AS component, R6(CASE k WHEN 0 THEN hi / (a + b) ELSE 1 - hi / (a + b) END) AS explained, R6(load) AS largest_loading FROM v, (VALUES (0), (1)) x(k)""")
def two_axis_pca(t):
    """Principal axes of the first two components, where the eigenvalues have a closed form."""
    return _pca(plain_vectors(t).select("label", F.slice("v", 1, 2).alias("v")), 2)


@query("M12_pca_projection")
def pca_projection(t):
    d = dimension(t)
    g = linear.gram_matrices(embedded(t), "v", d + 1)
    mean, cov = linear.covariance(g, list(range(d)), d)
    axes, _ = linear.principal_axes(cov, 4)
    w = np.vstack([axes.T, -(mean @ axes.T)[None, :]])
    z = linear.linear_map(w)("v")
    return embedded(t).select("vec_id", F.posexplode(z).alias("component", "x")).select(
        "vec_id", "component", fixed("x", 5).alias("x")
    )


@query("M13_reduced_rank_probe")
def probe(t):
    """Second half of each vector from the first half; error per label."""
    d = dimension(t)
    half = d // 2
    g = linear.gram_matrices(embedded(t), "v", d + 1)
    inputs, targets = [*range(half), d], list(range(half, d))
    w = linear.reduced_rank(g, inputs, targets, 1.0, d, rank=8)
    full = np.zeros((d + 1, half))
    full[inputs] = w
    _, cov = linear.covariance(g, targets, d)
    spread = float(np.sqrt(np.mean(np.diag(cov))))
    rows = embedded(t).withColumn("p", linear.linear_map(full)("v"))
    sq = F.aggregate(
        F.zip_with("p", F.slice("v", half + 1, half), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0), lambda s, x: s + x,
    ) / half
    return rows.groupBy("label").agg(fixed(F.sqrt(F.avg(sq)) / spread, 4).alias("nrmse"))


@query("M14_kmeans_codebook")
def codebook(t):
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=7, maxIter=20).fit(rows)
    coded = model.transform(rows)
    return coded.groupBy(F.col("prediction").alias("code")).agg(F.count(F.lit(1)).alias("members"))


def gaussian_alerts(rows, key, is_control, quantile=0.99, ridge=1e-2):
    """Mahalanobis distance of every row to the Gaussian of its key's control rows, as bounded score d / (1 + d), with an alert.

    ``rows``: id, key, v. Fits are made on executors and meet blocks of rows there; the threshold of a key is a quantile
    of its control scores. Keys without control rows have no fit and their rows no score.
    """
    fits = linear.keyed_fits(
        rows.where(is_control), "v", [key],
        lambda k, m: pd.DataFrame({key: [k[0]], "mean": [m.mean], "inverse": [np.linalg.inv(m.covariance()[1] + ridge * np.eye(len(m.mean))).ravel()]}),
        f"{key} {rows.schema[key].dataType.simpleString()}, mean array<double>, inverse array<double>",
    )
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    copies = fits.join(sizes, key).select(key, "mean", "inverse", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    dealt = rows.withColumn("_control", is_control).join(sizes, key).select(
        "id", F.col(key).alias(key), "v", "_control", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("_block")
    )

    def distance(left, right):
        if left.empty or right.empty:
            return pd.DataFrame()
        e = np.stack(left["v"].to_numpy()) - np.asarray(right["mean"].iloc[0])
        inverse = np.asarray(right["inverse"].iloc[0]).reshape(e.shape[1], e.shape[1])
        d = np.einsum("ij,jk,ik->i", e, inverse, e) / e.shape[1]
        return pd.DataFrame({"id": left["id"], key: left[key], "control": left["_control"], "score": d / (1 + d)})

    kind = f"id {rows.schema['id'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, control boolean, score double"
    scored = dealt.groupBy(key, "_block").cogroup(copies.groupBy(key, "_block")).applyInPandas(distance, kind)
    scored = materialize(scored.withColumn("score", fixed("score")))
    cut = skew.exact_quantiles(scored.where("control"), [key], "score", {"threshold": quantile})
    return scored.join(cut, key).select("id", key, "control", "score", (F.col("score") > F.col("threshold")).alias("alert"))


BLOCK = 50_000


@query("M15_mahalanobis_alert")
def mahalanobis(t):
    """Distance to the Gaussian of the own label's control rows."""
    rows = plain_vectors(t).withColumnRenamed("vec_id", "id")
    return gaussian_alerts(rows, "label", F.col("id") % 5 == 0).withColumnRenamed("id", "vec_id")


@query("M15_two_axis_alert", f"""
WITH {TWO_AXES}, g AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) + 1e-2 AS a, var_pop(y) + 1e-2 AS b, covar_pop(x, y) AS c FROM two WHERE vec_id % 5 = 0 GROUP BY label),
d AS (SELECT vec_id, label, vec_id % 5 = 0 AS control,
  (b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c) / 2 AS d FROM two JOIN g USING (label)),
s AS (SELECT vec_id, label, control, R6(d / (1 + d)) AS score FROM d),
q AS (SELECT label, quantile_cont(score, 0.9) AS threshold FROM s WHERE control GROUP BY label)
SELECT vec_id, label, control, score, score > threshold AS alert FROM s JOIN q USING (label)""")
def two_axis_alert(t):
    """The same alert over the first two components, where the inverse has a closed form."""
    rows = plain_vectors(t).select(F.col("vec_id").alias("id"), "label", F.slice("v", 1, 2).alias("v"))
    return gaussian_alerts(rows, "label", F.col("id") % 5 == 0, 0.9).withColumnRenamed("id", "vec_id")


EVENTDEF = """d AS (SELECT run, i, feature, value - lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS d FROM act),
dd AS (SELECT * FROM d WHERE d IS NOT NULL),
m AS (SELECT feature, median(d) AS c FROM dd WHERE run % 2 = 0 GROUP BY feature),
f AS (SELECT feature, any_value(c) AS c, CASE WHEN 1.4826 * median(abs(d - c)) > 1e-8 THEN 1.4826 * median(abs(d - c))
  WHEN stddev_pop(d) > 1e-8 THEN stddev_pop(d) ELSE 1 END AS s FROM dd JOIN m USING (feature) WHERE run % 2 = 0 GROUP BY feature),
e AS (SELECT run, i - 1 AS i, R6(sqrt(avg(pow((d - c) / s, 2)))) AS effect FROM dd JOIN f USING (feature) GROUP BY run, i),
x AS (SELECT max(effect) AS top FROM e WHERE run % 2 = 0 GROUP BY run),
th AS (SELECT top AS thr FROM (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM x)
  WHERE rn = CAST(ceil((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1)"""


@query("M16_state_change_events", f"""
WITH {ACT}, {EVENTDEF} SELECT run, min(i) FILTER (effect > thr) AS event_i, max(effect) AS largest FROM e, th GROUP BY run""")
def state_change(t):
    w = Window.partitionBy("run", "feature").orderBy("i")
    d = materialize(t.activity.withColumn("d", F.col("value") - F.lag("value").over(w)).where("d IS NOT NULL"))
    control = d.where("run % 2 = 0")
    med = skew.exact_quantiles(control, ["feature"], "d", {"c": 0.5})
    off = control.join(F.broadcast(med), "feature").withColumn("a", F.abs(F.col("d") - F.col("c")))
    mad = skew.exact_quantiles(off, ["feature"], "a", {"m": 0.5})
    sd = control.groupBy("feature").agg(F.stddev_pop("d").alias("sd"))
    scale = F.when(1.4826 * F.col("m") > 1e-8, 1.4826 * F.col("m")).when(
        F.col("sd") > 1e-8, F.col("sd")
    ).otherwise(1.0)
    fit = med.join(mad, "feature").join(sd, "feature").select("feature", "c", scale.alias("s"))
    z = (F.col("d") - F.col("c")) / F.col("s")
    e = d.join(F.broadcast(fit), "feature").groupBy("run", (F.col("i") - 1).alias("i")).agg(
        fixed(F.sqrt(F.avg(z * z))).alias("effect")
    )
    top = e.where("run % 2 = 0").groupBy("run").agg(F.max("effect").alias("top"))
    thr = alerts.higher_quantile(top, "top", 0.95)
    hit = F.col("effect") > F.col("threshold")
    return e.crossJoin(F.broadcast(thr)).groupBy("run").agg(
        F.min(F.when(hit, F.col("i"))).alias("event_i"), F.max("effect").alias("largest")
    )


@query("M17_local_one_hop_flat_contexts")
def contexts(t):
    """Ridge per target on own, neighbour and all inputs; normalised error per context."""
    steps = action_steps(t)
    g = dynamics.joint_gram(training(dynamics.transitions(steps)), LAYOUT)
    v = _validation(steps)
    _, cov = linear.covariance(g, LAYOUT.next(), LAYOUT.one)
    variance = np.diag(cov)
    sets = {"local": [[e] for e in range(N)], "one_hop": BOTH, "flat": [list(range(N))] * N}
    named = {
        k: dynamics.one_step_mse(v, LAYOUT, dynamics.fit_graph(g, LAYOUT, s)) / variance
        for k, s in sets.items()
    }
    return _mse_frame(t, named)


@query("M18_mechanism_preflight")
def preflight(t):
    """Does a ridge on price explain quantity, and do two clusters split the residual."""
    rows = t.lineitem.select(
        "l_returnflag", F.array("l_extendedprice", "l_discount", F.lit(1.0), "l_quantity").alias("v")
    )
    g = linear.gram_matrices(rows, "v", 4)
    w = linear.solve_ridge(g, [0, 1, 2], [3], 1.0, free=2)
    full = np.vstack([w, np.zeros((1, 1))])
    _, cov = linear.covariance(g, [3], 2)
    r = rows.select("l_returnflag", (F.get("v", 3) - F.get(linear.linear_map(full)("v"), 0)).alias("r"))
    r = materialize(r)
    vec = r.select(array_to_vector(F.array("r")).alias("features"))
    two = KMeans(k=2, seed=7, maxIter=10).fit(vec).summary.trainingCost
    spread = r.agg((F.var_pop("r") * F.count("r")).alias("sse")).first().sse
    return r.groupBy("l_returnflag").agg(
        fixed(F.avg(F.col("r") * F.col("r")) / float(cov[0, 0]), 4).alias("mse_ratio"),
        fixed(F.var_pop("r"), 3).alias("residual_variance"),
    ).withColumn("two_cluster_reduction", fixed(F.lit(1 - two / spread), 3))


@query("M19_sliced_wasserstein", """
WITH x AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY x) AS rn, count(*) OVER (PARTITION BY p) AS n FROM (
  SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings))
SELECT CAST(a.p - 1 AS BIGINT) AS direction, R6(avg(pow(a.x + b.x, 2))) AS distance
FROM x a JOIN x b ON a.p = b.p AND b.rn = a.n + 1 - a.rn GROUP BY a.p""")
def sliced_wasserstein(t):
    """Each axis against its mirror image: rank-matched mean squared distance."""
    x = t.embeddings.select(
        "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("direction", "x")
    )
    mirror = x.withColumn("x", -F.col("x"))
    by, order = F.col("x"), ["x", "vec_id"]
    a = skew.running_count(x, ["direction"], order, by, "rn")
    b = skew.running_count(mirror, ["direction"], order, by, "rn").withColumnRenamed("x", "y")
    pairs = a.join(b.drop("vec_id"), ["direction", "rn"])
    d = F.col("x") - F.col("y")
    return pairs.groupBy(F.col("direction").cast("bigint").alias("direction")).agg(
        fixed(F.avg(d * d)).alias("distance")
    )


#: Each direction mixes one component and the next.
MIXED = [[0.0] * k + [0.6, 0.8] for k in range(4)]


@query("M19_two_sample_wasserstein", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, k FROM embeddings, (VALUES (0), (1), (2), (3)) d(k)),
p AS (SELECT vec_id, label % 3 = 0 AS first, k, 0.6 * v[k + 1] + 0.8 * v[k + 2] AS x FROM v),
r AS (SELECT first, k, x, row_number() OVER (PARTITION BY first, k ORDER BY x, vec_id) AS i, count(*) OVER (PARTITION BY first, k) AS n FROM p),
m AS (SELECT a.k, a.x - b.x AS g, least(a.i / a.n::DOUBLE, b.i / b.n::DOUBLE) - greatest((a.i - 1) / a.n::DOUBLE, (b.i - 1) / b.n::DOUBLE) AS w
  FROM r a JOIN r b ON a.first AND NOT b.first AND a.k = b.k)
SELECT k::BIGINT AS direction, R6(sum(w * g * g)) AS distance FROM m WHERE w > 0 GROUP BY k""")
def two_sample_wasserstein(t):
    """Two samples of different size along four given directions."""
    rows = plain_vectors(t).withColumnRenamed("vec_id", "id")
    wide = [d + [0.0] * (dimension(t) - len(d)) for d in MIXED]
    found = drift.sliced_wasserstein(rows.where("label % 3 = 0"), rows.where("label % 3 <> 0"), wide)
    return found.select("direction", fixed("distance").alias("distance"))


@query("M19_gaussian_prior_mmd", """
WITH v AS (SELECT embedding::DOUBLE[] AS v, len(embedding) AS d FROM embeddings),
e AS (SELECT avg(exp(-greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0) / (2 * a.d))) AS e, any_value(a.d) AS d FROM v a, v b),
c AS (SELECT avg(exp(-list_dot_product(v, v) / (2 * (d + 1.0)))) AS c FROM v)
SELECT R6(e - 2 * pow(d / (d + 1.0), d / 2.0) * c + pow(d / (d + 2.0), d / 2.0)) AS mmd FROM e, c""")
def prior_mmd(t):
    """Discrepancy of the embeddings from the standard Gaussian."""
    rows = plain_vectors(t).withColumnRenamed("vec_id", "id")
    return drift.gaussian_prior_mmd(rows, dimension(t)).select(fixed("mmd").alias("mmd"))


@query("C13_energy_score")
def energy_score(t):
    """Energy score of a diagonal Gaussian per vector, 256 antithetic draws from a row seed."""
    d = dimension(t)
    mean, cov = linear.covariance(linear.gram_matrices(embedded(t), "v", d + 1), list(range(d)), d)
    sd = np.sqrt(np.diag(cov))

    @F.pandas_udf("double")
    def score(vec_id: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for key, x in zip(vec_id.to_numpy(), v.to_numpy()):
            half = np.random.default_rng([7, int(key)]).standard_normal((128, d))
            draws = mean + sd * np.vstack([half, -half])
            near = np.linalg.norm(draws - x[:d], axis=1).mean()
            spread = np.linalg.norm(draws - np.roll(draws, 1, axis=0), axis=1).mean()
            out.append(near - 0.5 * spread)
        return pd.Series(out)

    return embedded(t).select("vec_id", fixed(score("vec_id", "v"), 5).alias("score"))
