"""Evidence, thresholds, first alerts and alert metrics per run."""

from pyspark.sql import functions as F

from tidegauge.operators import skew
from tidegauge.session import materialize


def upper_p_values(scored, score, is_reference, out="p_value", keys=()):
    """Empirical upper p-value ``(1 + #{reference >= s}) / (n + 1)`` of each score.

    Distinct scores are counted first and ranked once, so the work is one sort
    of the distinct scores, not scores times reference.
    """
    keys = list(keys)
    counted = scored.groupBy(*keys, score).agg(
        F.sum(F.when(is_reference, 1).otherwise(0)).cast("bigint").alias("_ref")
    )
    counted = materialize(counted)
    down = -F.col(score)
    ranked = skew.running_sum(
        counted, keys, [F.col(score).desc()], down, {"_above": F.col("_ref")}
    )
    totals = counted.groupBy(*keys).agg(F.sum("_ref").alias("_n"))
    ranked = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    p = (1.0 + F.col("_above")) / (F.col("_n") + 1.0)
    return scored.join(ranked.select(*keys, score, p.alias(out)), [*keys, score])


def higher_quantile(df, value, q, out="threshold"):
    """Quantile by rank ceil((n - 1) q), without interpolation."""
    ranked = skew.ranked_values(df, [], value)
    return skew.pick_ranks(
        ranked, [], value, {out: lambda n: F.ceil((n - 1) * F.lit(float(q)))}
    ).select(out)


def conformal_threshold(maxima, value, alpha, out="threshold"):
    """Split-conformal threshold: rank ceil((n + 1)(1 - alpha)), infinite beyond n."""
    ranked = skew.ranked_values(maxima, [], value)
    rank = lambda n: F.ceil((n + 1) * F.lit(1.0 - alpha)) - 1
    return skew.pick_ranks(ranked, [], value, {out: rank}).select(
        F.coalesce(F.col(out), F.lit(float("inf"))).alias(out)
    )


def clipped_evidence(p):
    """Evidence per step, never negative."""
    return F.greatest(F.lit(0.0), -F.log(p) - F.log(F.lit(2.0)))


def drifting_evidence(p):
    """Evidence per step with negative drift; the accumulator resets at zero."""
    return -F.log(p) - F.log(F.lit(4.0))


def run_alert_rows(traces, evidence, threshold, active):
    """Per run: first alert, latched, against the activity interval.

    Alerts are stamped one step later than their transition, and a detection must
    come after the onset.
    """
    i = F.col("i")
    rows = traces.groupBy("run").agg(
        F.min(F.when(active, i)).alias("onset"),
        F.max(F.when(active, i)).alias("stop"),
        F.min(F.when(F.col(evidence) > threshold, i + 1)).alias("first_alert"),
    )
    treated = F.col("onset").isNotNull()
    after = F.coalesce(F.col("first_alert") > F.col("onset"), F.lit(False))
    before = F.coalesce(F.col("first_alert") <= F.col("onset"), F.lit(False))
    return rows.select(
        "run", "onset", "stop", "first_alert",
        treated.alias("is_treatment"),
        (treated & before).alias("pre_onset_alert"),
        (treated & after).alias("detected"),
        (treated & after & F.coalesce(F.col("first_alert") <= F.col("stop"), F.lit(False)))
        .alias("detected_while_active"),
        F.when(treated & after, F.col("first_alert") - F.col("onset")).alias("delay"),
    )


def trajectory_alarm_rows(rows, alarms, onset="onset"):
    """Per run and alarm kind: any, pre-onset and first post-onset alarm step.

    ``alarms``: ``{name: boolean Column}``. Post-onset here means at or after it.
    """
    i, at = F.col("i"), F.col(onset)
    aggs = [F.max(onset).alias("onset")]
    for name, hit in alarms.items():
        aggs += [
            F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"any_{name}"),
            F.coalesce(F.bool_or(hit & (i < at)), F.lit(False)).alias(f"pre_onset_{name}"),
            F.min(F.when(hit & (i >= at), i)).alias(f"post_onset_{name}"),
        ]
    return rows.groupBy("run").agg(*aggs).withColumn("is_treatment", F.col("onset").isNotNull())


def alarm_metrics(rows, name, keys=()):
    """False alarm, detection and pre-onset rates, median and worst delay."""
    treated = F.col("is_treatment")
    delay = F.col(f"post_onset_{name}") - F.col("onset")
    share = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    base = rows.withColumn("_delay", delay)
    rates = base.groupBy(*keys).agg(
        F.count_if(~treated).alias("controls"),
        F.count_if(treated).alias("treatments"),
        share(F.col(f"any_{name}"), ~treated).alias("false_alarm_rate"),
        share(F.col("_delay").isNotNull(), treated).alias("detection_rate"),
        share(F.col(f"pre_onset_{name}"), treated).alias("pre_onset_rate"),
        F.max("_delay").alias("worst_delay"),
        F.avg(F.col(f"any_{name}").cast("int")).alias("alerts_per_run"),
    )
    median = skew.exact_quantiles(base, keys, "_delay", {"median_delay": 0.5})
    if keys:
        return rates.join(median, list(keys), "left")
    return rates.join(F.broadcast(median), F.lit(True), "left")


def horizon_labels(rows, events, horizon):
    """Does the run's first event fall in ``(i, i + h]``, for every h up to the horizon."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    hit = (F.col("event_i") > F.col("i")) & (F.col("event_i") <= F.col("i") + F.col("h"))
    return (
        rows.join(events, "run", "left").select("run", "i", "event_i", h)
        .select("run", "i", F.col("h").cast("bigint").alias("h"),
                F.coalesce(hit, F.lit(False)).alias("label"))
    )


def stratified_roles(pairs, cell, key, cuts, default, salt=None):
    """Role by position inside a cell, ordered by a salted hash (or the id).

    ``cuts``: ``[(role, upper position)]``; later positions get ``default``. The
    hash prefix is the order column, so a large cell is cut evenly into slots.
    """
    text = F.concat_ws(":", F.lit(salt), F.col(key).cast("string")) if salt else None
    if salt:
        ranked = pairs.withColumn("_h", F.sha2(text, 256)).withColumn(
            "_p", F.conv(F.substring("_h", 1, 12), 16, 10).cast("bigint")
        )
        ranked = skew.running_count(ranked, list(cell), ["_p", "_h", key], F.col("_p"), "_rn")
    else:
        ranked = skew.running_count(pairs, list(cell), [key], F.col(key), "_rn")
    role = F.lit(default)
    for name, upper in reversed(cuts):
        role = F.when(F.col("_rn") <= upper, name).otherwise(role)
    return ranked.withColumn("role", role).drop("_rn", "_h", "_p")
