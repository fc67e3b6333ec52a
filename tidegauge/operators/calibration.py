"""Probability calibration, proper scores and significance tests."""

import math

from pyspark.sql import functions as F

from tidegauge.functions.hashing import derived_integer
from tidegauge.operators import skew
from tidegauge.session import materialize

# The calibration grid of slopes and intercepts.
SLOPES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
INTERCEPTS = [-4.0 + 0.25 * i for i in range(33)]
CLIP = 1e-7


def quantile_alerts(scores, threshold, score):
    """Strict alerts above a one-row threshold table."""
    return scores.crossJoin(F.broadcast(threshold)).withColumn(
        "alert", F.col(score) > F.col("threshold")
    )


def logit_map(p, slope, intercept):
    """Increasing logit map of a clipped probability."""
    c = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return 1 / (1 + F.exp(-(slope * (F.log(c) - F.log1p(-c)) + intercept)))


def fit_logit_calibrator(df, p, label):
    """Slope and intercept with the least Brier score; ties go to the mildest map.

    Equal (probability, label) rows are counted first, then each is scored on the
    fixed grid; the shuffle carries one partial sum per grid point.
    """
    grid = F.array(*[
        F.struct(F.lit(s).alias("slope"), F.lit(i).alias("intercept"))
        for s in SLOPES for i in INTERCEPTS
    ])
    counted = df.groupBy(F.col(p).alias("_p"), F.col(label).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = counted.withColumn("g", F.explode(grid)).select("_p", "_y", "_n", "g.*")
    miss = logit_map(F.col("_p"), F.col("slope"), F.col("intercept")) - F.col("_y")
    scored = rows.groupBy("slope", "intercept").agg(
        (F.sum(miss * miss * F.col("_n")) / F.sum("_n")).alias("brier")
    )
    best = F.min_by(
        F.struct("slope", "intercept", "brier"),
        F.struct("brier", F.abs(F.col("slope") - 1), F.abs("intercept"), "slope", "intercept"),
    )
    return scored.agg(best.alias("b")).select("b.*")


def surface_metrics(df, p, label, keys=()):
    """Brier score, 10-bin expected calibration error, positive rate."""
    y = F.col(label).cast("double")
    bins = df.groupBy(*keys, F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_sp"), F.sum(y).alias("_sy"),
        F.sum((F.col(p) - y) * (F.col(p) - y)).alias("_sq"),
    )
    n = F.sum("_n")
    return bins.groupBy(*keys).agg(
        (F.sum("_sq") / n).alias("brier"),
        (F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / n).alias("ece"),
        (F.sum("_sy") / n).alias("positive_rate"),
    )


def survival_cdf(hazards):
    """Event CDF of an array of per-step hazards: 1 - prod(1 - h) per prefix."""
    step = F.aggregate(
        hazards,
        F.struct(F.lit(1.0).alias("s"), F.array().cast("array<double>").alias("out")),
        lambda acc, h: F.struct(
            (acc["s"] * (1 - h)).alias("s"),
            F.array_append(acc["out"], 1 - acc["s"] * (1 - h)).alias("out"),
        ),
    )
    return step["out"]


def gaussian_nll(x, mean, var):
    return 0.5 * (F.log(2 * math.pi * var) + (x - mean) * (x - mean) / var)


def mixture_nll(rows, sample, x, components):
    """Negative log likelihood of a Gaussian mixture over all terms of a sample.

    ``components``: small table ``component, weight, mean, var``.
    """
    per = rows.crossJoin(F.broadcast(components)).groupBy(*sample, "component").agg(
        (F.log(F.first("weight")) - F.sum(gaussian_nll(F.col(x), F.col("mean"), F.col("var"))))
        .alias("_l")
    )
    top = per.groupBy(*sample).agg(F.collect_list("_l").alias("_ls"))
    peak = F.array_max("_ls")
    total = F.aggregate("_ls", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("_ls")))
    return top.select(*sample, (-(peak + F.log(total))).alias("nll"))


def mixture_moments(components):
    """Exact mean and variance of the mixture: one row."""
    m = F.sum(F.col("weight") * F.col("mean"))
    second = F.sum(F.col("weight") * (F.col("var") + F.col("mean") * F.col("mean")))
    return components.agg(m.alias("mean"), (second - m * m).alias("var"))


def _half_sums(spark, values):
    """(s, c): every signed sum of the values, and how many sign patterns give it; one row a pattern before they are counted."""
    signed = sum((F.when(F.col("id").bitwiseAND(F.lit(1 << j)) == 0, F.lit(v)).otherwise(F.lit(-v)) for j, v in enumerate(values)), F.lit(0).cast("bigint"))
    return spark.range(1 << len(values)).select(signed.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))


def exact_sign_flip(pairs, difference, unit=1e-9):
    """Exact paired sign-flip p-value over all 2^n sign patterns of up to 62 pairs.

    Differences are taken in whole ``unit``s; sums within one unit per pair of the observed one count as
    equal. The pairs are halved: each half has 2^(n/2) signed sums, and a pattern is one sum of each. In
    one order by value, a sum of the first half stands behind all partners of the second that keep the whole at
    most as large as observed, so their running count, weighted by the first half's patterns, is the result. The order
    is range-split when it is long; no table holds the 2^n patterns.
    """
    spark = pairs.sparkSession
    values = [int(round(r[0] / unit)) for r in pairs.select(difference).where(F.col(difference).isNotNull()).limit(63).collect()]
    if not values:
        raise ValueError("no pair to flip")
    if len(values) > 62:
        raise ValueError("the exact test takes 62 pairs at most; use monte_carlo_sign_flip for more")
    n, most = len(values), sum(values) + len(values)
    near, far = _half_sums(spark, values[: n // 2]), _half_sums(spark, values[n // 2 :])
    zero = F.lit(0).cast("decimal(20,0)")
    whole = F.col("c").cast("decimal(20,0)")
    # A partner equal to what is left counts, so partners come first among equals.
    both = near.select(F.col("s").alias("at"), F.lit(0).alias("side"), whole.alias("c"), zero.alias("w")).unionByName(
        far.select((F.lit(most) - F.col("s")).alias("at"), F.lit(1).alias("side"), zero.alias("c"), whole.alias("w"))
    )
    if n > 24:
        both = materialize(both)
    plan = skew.NO_SPLIT if n <= 24 else None
    ranked = skew.running_sum(both, [], ["at", "side"], F.col("at"), {"upto": F.col("c")}, plan=plan)
    extreme = F.coalesce(F.sum((F.col("upto") * F.col("w")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return ranked.agg(extreme.alias("x")).select(
        F.lit(1 << n).alias("patterns"), F.col("x").cast("bigint").alias("as_extreme"), (F.col("x").cast("double") / float(1 << n)).alias("p_value"),
    )


def monte_carlo_sign_flip(pairs, pair, difference, draws, seed):
    """One-sided p-value ``(1 + hits) / (draws + 1)`` with signs drawn from ``seed:draw:pair``.

    Signs hang on (seed, draw, pair) only, so a rerun draws the same. Pairs are
    not collected: each pair adds one signed term to every draw.
    """
    drawn = derived_integer(seed, F.concat_ws(":", "draw", F.col(pair).cast("string")))
    sign = F.when(drawn % 2 == 0, 1.0).otherwise(-1.0)
    total = pairs.agg(F.sum(difference).alias("_obs"))
    rows = pairs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sums = rows.groupBy("draw").agg(F.sum(sign * F.col(difference)).alias("_s"))
    hit = F.col("_s") <= F.col("_obs") + 1e-9
    return sums.crossJoin(F.broadcast(total)).agg(
        ((1 + F.count_if(hit)) / F.lit(draws + 1.0)).alias("p_value")
    )


def gate_table(metrics, gates):
    """One row per gate: observed, limit, passed. ``gates``: ``[(name, column, op, limit)]``."""
    rows = []
    for name, column, op, limit in gates:
        x, y = F.col(column).cast("double"), F.lit(float(limit))
        ok = {"<=": x <= y, "<": x < y, ">=": x >= y, ">": x > y, "==": x == y}[op]
        rows.append(F.struct(
            F.lit(name).alias("gate"), x.alias("observed"), y.alias("limit"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
        ))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def pareto(candidate, baseline):
    """Is the candidate no worse on every alert metric, and better on one."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    both = candidate.crossJoin(b)
    fa, bfa = F.col("false_alarm_rate"), F.col("b_false_alarm_rate")
    dr, bdr = F.col("detection_rate"), F.col("b_detection_rate")
    late = F.lit(float("inf"))
    de, bde = F.coalesce("median_delay", late), F.coalesce("b_median_delay", late)
    no_worse = (fa <= bfa) & (dr >= bdr) & (de <= bde)
    better = (fa < bfa) | (dr > bdr) | (de < bde)
    return both.select(no_worse.alias("non_inferior"), (no_worse & better).alias("dominates"))
