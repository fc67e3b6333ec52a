"""Event sequences per run: gaps, related deltas and a bigram surprise model."""

from pyspark.sql import functions as F

from tidegauge.operators import skew

BEGIN = "<BOS>"


def related_deltas(records):
    """Seconds since the previous record of the same trace, else of the same service.

    Needs ``trace_id, service, t, seq``; the first of a relation gets 0.
    """
    traced = F.length("trace_id") > 0
    relation = F.when(traced, F.concat(F.lit("trace:"), "trace_id")).otherwise(
        F.concat(F.lit("service:"), "service")
    )
    rows = skew.previous(
        records.withColumn("_rel", relation), ["_rel"], ["t", "seq"], F.col("t"),
        {"_prev": F.col("t")},
    )
    return rows.withColumn(
        "delta_seconds", F.coalesce((F.col("t") - F.col("_prev")) / F.lit(1e9), F.lit(0.0))
    ).drop("_rel", "_prev")


def span_gaps(spans, trace):
    """Gaps inside an ordered trace, in ms and never negative.

    Needs whole-number ``span``, ``start`` and ``end``. Spans without a trace id may pile up under one
    key, so the order is scanned split-safe.
    """
    keys, order, by = [trace], ["start", "span"], F.col("start")
    plan = skew.plan_split(spans, keys, by)
    rows = skew.running_count(spans, keys, order, by, "position", plan=plan)
    rows = skew.previous(rows, keys, order, by, {"_before": F.col("end")}, plan=plan)
    rows = skew.following(rows, keys, order, by, {"_after": F.col("start")}, plan=plan)
    ms = F.lit(1e6)
    before, after = F.coalesce("_before", "start"), F.coalesce("_after", "end")
    return rows.select(
        *spans.columns, "position",
        F.greatest(F.lit(0.0), (F.col("start") - before) / ms).alias("gap_from_previous_ms"),
        F.greatest(F.lit(0.0), (after - F.col("end")) / ms).alias("time_to_next_ms"),
    )


def fit_bigrams(steps):
    """Counts, context counts and log-time statistics of (previous, token).

    The fitted table is one row per observed bigram, at most vocabulary squared.
    """
    log_time = F.log1p("time_to_next_ms")
    pairs = steps.groupBy("previous", "token").agg(
        F.count(F.lit(1)).alias("c"), F.avg(log_time).alias("center"),
        F.greatest(F.stddev_pop(log_time), F.lit(0.05)).alias("spread"),
    )
    context = steps.groupBy("previous").agg(F.count(F.lit(1)).alias("context"))
    vocabulary = steps.agg(F.count_distinct("token").alias("vocabulary"))
    return pairs, context, vocabulary


def surprise(steps, fitted):
    """Negative log add-one probability plus a capped half squared time z-score."""
    pairs, context, vocabulary = fitted
    rows = (
        steps.join(pairs, ["previous", "token"], "left")
        .join(context, "previous", "left")
        .crossJoin(F.broadcast(vocabulary))
    )
    p = (F.coalesce("c", F.lit(0)) + 1.0) / (
        F.coalesce("context", F.lit(0)) + F.greatest("vocabulary", F.lit(1))
    )
    z = (F.log1p("time_to_next_ms") - F.coalesce("center", F.lit(0.0))) / F.coalesce(
        "spread", F.lit(1.0)
    )
    return rows.withColumn("surprise", -F.log(p) + F.least(0.5 * z * z, F.lit(25.0))).drop(
        "c", "center", "spread", "context", "vocabulary"
    )
