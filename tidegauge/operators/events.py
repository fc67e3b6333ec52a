"""Per-window event features, vocabularies, log templates and matched-pair effects."""

from pyspark.sql import Window, functions as F

from tidegauge.functions.text import mask_tokens
from tidegauge.operators import skew

UNKNOWN = 0


def event_features(records, keys, templates, numeric=()):
    """One row per key: count by template, total, mean severity and related delta,
    trace-link ratio, and mean and observed ratio of each numeric attribute.

    ``records``: template, severity, delta_seconds, linked, and the numeric columns
    (NULL where unobserved). All counts combine map-side.
    """
    n = F.count(F.lit(1))
    aggs = [F.count_if(F.col("template") == v).alias(f"n_{v}") for v in templates]
    aggs += [
        n.alias("total"), F.avg("severity").alias("mean_severity"),
        F.avg("delta_seconds").alias("mean_delta"), (F.count_if("linked") / n).alias("link_ratio"),
    ]
    for c in numeric:
        aggs += [F.avg(c).alias(f"mean_{c}"), (F.count(c) / n).alias(f"observed_{c}")]
    return records.groupBy(*keys).agg(*aggs)


def fit_numeric_scale(records, column):
    """Median and inter-quartile range; the scale falls back to max(|x|, 1)."""
    q = skew.exact_quantiles(records, [], column, {"lo": 0.25, "center": 0.5, "hi": 0.75})
    top = records.agg(F.greatest(F.max(F.abs(column)), F.lit(1.0)).alias("_top"))
    iqr = F.col("hi") - F.col("lo")
    return q.crossJoin(top).select(
        "center", F.when(iqr > 1e-9, iqr).otherwise(F.col("_top")).alias("scale")
    )


def transform_features(features, templates, column, fit):
    """log1p counts and delta, severity / 24, numeric clipped to +-8 scales."""
    z = (F.col(f"mean_{column}") - F.col("center")) / F.col("scale")
    clipped = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    out = {f"n_{v}": F.log1p(f"n_{v}") for v in templates}
    out |= {
        "total": F.log1p("total"), "mean_severity": F.col("mean_severity") / 24,
        "mean_delta": F.log1p("mean_delta"),
        f"mean_{column}": F.when(F.col(f"observed_{column}") > 0, clipped).otherwise(0.0),
    }
    return features.crossJoin(F.broadcast(fit)).withColumns(out).drop("center", "scale")


def fit_vocabulary(templates, column="template", limit=None):
    """Ids from 1 by sorted order of the distinct templates; 0 stays for unknown."""
    distinct = templates.select(column).distinct()
    width = F.rpad(F.substring(F.hex(F.encode(F.col(column), "UTF-8")), 1, 12), 12, "0")
    by = F.conv(width, 16, 10).cast("bigint")
    return skew.running_count(distinct, [], [column], by, "template_id", limit)


def encode(records, vocabulary, column="template"):
    """Template ids by join; Spark broadcasts a small vocabulary by its size."""
    return records.join(vocabulary, column, "left").withColumn(
        "template_id", F.coalesce("template_id", F.lit(UNKNOWN))
    )


def log_templates(bodies, column):
    """Count of each masked template, with its payload bytes (text plus one counter)."""
    t = mask_tokens(F.col(column)).alias("template")
    return bodies.select(t).groupBy("template").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "payload_bytes", (F.octet_length("template") + 8).cast("bigint")
    )


def paired(rows, keys, value="value"):
    """Treatment minus control at the same pair and step.

    ``rows``: pair, treated, keys, value; one row per arm and key.
    """
    v = lambda arm: F.max(F.when(F.col("treated") == arm, F.col(value)))
    return rows.groupBy("pair", *keys).agg(
        v(True).alias("treatment"), v(False).alias("control")
    ).where("treatment IS NOT NULL AND control IS NOT NULL").withColumn(
        "delta", F.col("treatment") - F.col("control")
    )


def pair_effects(deltas, plan, recovery_windows, floor):
    """Active, placebo and recovery medians of the paired deltas of each pair.

    The active slice is shifted by one step: ``[start + 1, stop + 1)``; the placebo
    is the same length before the start; recovery is the end of the series. A
    pair has one value per step, so the medians are small.
    """
    d = deltas.join(plan, "pair").withColumn(
        "_end", F.max("i").over(Window.partitionBy("pair"))
    )
    i, a, b = F.col("i"), F.col("start_i"), F.col("stop_i")
    med = lambda cond, x="delta": F.median(F.when(cond, F.col(x)))
    out = d.withColumn("_abs", F.abs("delta")).groupBy("pair").agg(
        med((i > a) & (i <= b)).alias("active"),
        med((i >= F.greatest(F.lit(0), a - (b - a))) & (i < a)).alias("placebo"),
        med(i > F.col("_end") - recovery_windows, "_abs").alias("_left"),
    )
    return out.withColumn(
        "recovery_ratio", F.col("_left") / F.greatest(F.abs("active"), F.lit(floor))
    ).drop("_left")
