"""Event-level report of detectors: alert episodes and scored steps against fault intervals.

Steps and intervals of a run are merged in order of the step index and swept once: each step takes the last
interval that began at or before it. Intervals of one phase do not overlap in a run. A step inside a structural
interval is structural, else one inside a noise interval is noise, else it is normal.
"""

from math import comb

from pyspark.sql import Window, functions as F

from tidegauge.functions.numbers import fixed
from tidegauge.operators import skew

PHASES = ("structural", "routine_noise")


def with_phases(scored, intervals):
    """Scored steps with ``phase``, and ``start_i`` and ``affected`` of the structural interval that they lie in.

    ``intervals``: run, phase, start_i, stop_i, affected (feature names).
    """
    steps = scored.withColumns({"_kind": F.lit(1), "_at": F.lit(None).cast("string")})
    held = F.struct("start_i", "stop_i", "affected")
    marks = intervals.select("run", F.col("start_i").alias("i"), F.col("phase").alias("_at"), F.lit(0).alias("_kind"), held.alias("_held"))
    both = steps.unionByName(marks, allowMissingColumns=True)
    begun = {f"_{p}": F.when(F.col("_at") == p, F.col("_held")) for p in PHASES}
    swept = skew.last_known(both, ["run"], ["i", "_kind"], F.col("i"), begun).where("_kind = 1")
    inside = {p: F.coalesce(F.col("i") < F.col(f"_{p}")["stop_i"], F.lit(False)) for p in PHASES}
    phase = F.lit("normal")
    for p in reversed(PHASES):
        phase = F.when(inside[p], F.lit(p)).otherwise(phase)
    fault = F.when(inside["structural"], F.col("_structural"))
    return swept.select(*scored.columns, phase.alias("phase"), fault["start_i"].alias("start_i"), fault["affected"].alias("affected"))


def alert_episodes(rows):
    """Runs of consecutive alert steps: detector, run, first and last step, and whether one of them is structural."""
    alerts = rows.where("alert").select("detector", "run", "i", (F.col("phase") == "structural").alias("_met"))
    keys = ["detector", "run"]
    before = skew.previous(alerts, keys, ["i"], F.col("i"), {"_before": F.col("i")})
    begins = F.when(F.col("_before") == F.col("i") - 1, 0).otherwise(1).cast("bigint")
    numbered = skew.running_sum(before, keys, ["i"], F.col("i"), {"episode": begins})
    return numbered.groupBy(*keys, "episode").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.bool_or("_met").alias("structural"))


def top_features(rows, first, features, lookback, k):
    """The ``k`` features with the largest evidence over the look-back up to each first detection.

    Signed evidence is averaged before its size is taken. Each detection asks for its own steps by index, so no run is
    scanned for it. ``first``: detector, run, start_i, first_i.
    """
    wanted = first.select("detector", "run", "start_i", F.explode(F.sequence(F.col("first_i") - (lookback - 1), F.col("first_i"))).alias("i"))
    near = wanted.join(rows.select("detector", "run", "i", "evidence", "signed"), ["detector", "run", "i"])
    flat = near.select("detector", "run", "start_i", "signed", F.posexplode("evidence").alias("p", "e"))
    size = F.when(F.first("signed"), F.abs(F.avg("e"))).otherwise(F.avg(F.abs("e")))
    by = flat.groupBy("detector", "run", "start_i", "p").agg(fixed(size).alias("e"))
    named = by.withColumn("feature", F.get(F.array(*[F.lit(n) for n in features]), F.col("p")))
    # One row per feature and event.
    order = Window.partitionBy("detector", "run", "start_i").orderBy(F.desc("e"), F.desc("feature"))
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def event_report(scored, intervals, features, lookback, k=3):
    """One row per detector, from (detector, run, i, score, alert, evidence, signed)."""
    from tidegauge.session import materialize

    rows = materialize(with_phases(scored, intervals))
    structural, noise = F.col("phase") == "structural", F.col("phase") == "routine_noise"
    rate = lambda part: F.coalesce(F.count_if(F.col("alert") & part) / F.nullif(F.count_if(part), F.lit(0)), F.lit(0.0))
    points = rows.groupBy("detector").agg(
        F.count_if(noise).alias("noise_points"), rate(noise).alias("noise_alert_rate"), rate(~structural & ~noise).alias("normal_alert_rate"),
        rate(structural).alias("structural_alert_rate"),
    )
    medians = skew.exact_quantiles(rows.where("phase <> 'normal'"), ["detector", "phase"], "score", {"m": 0.5}).groupBy("detector").agg(
        F.max(F.when(noise, F.col("m"))).alias("median_noise_score"), F.max(F.when(structural, F.col("m"))).alias("median_structural_score")
    )
    found = materialize(rows.where(structural).groupBy("detector", "run", "start_i").agg(
        F.min("i").alias("begin_i"), F.min(F.when(F.col("alert"), F.col("i"))).alias("first_i"), F.first("affected").alias("affected")
    ))
    detected = found.where("first_i IS NOT NULL")
    top = top_features(rows, detected, features, lookback, k)
    keys = ["detector", "run", "start_i"]
    hits = top.join(detected.select(*keys, "affected"), keys).groupBy(*keys).agg(F.count_if(F.array_contains("affected", F.col("feature"))).alias("hits"))
    wanted = F.least(F.lit(k), F.lit(len(features)), F.size("affected"))
    recall = F.when(wanted > 0, F.coalesce("hits", F.lit(0)) / wanted).otherwise(0.0)
    events = found.join(hits, keys, "left").groupBy("detector").agg(
        F.count(F.lit(1)).alias("events"), F.count("first_i").alias("detected"), F.avg(F.col("first_i") - F.col("begin_i")).alias("mean_delay"),
        F.avg(F.when(F.col("first_i").isNotNull(), (F.col("hits") > 0).cast("int"))).alias("hit_at_3"), F.avg(recall).alias("recall_at_3"),
    ).withColumn("event_recall", F.col("detected") / F.col("events"))
    episodes = alert_episodes(rows).groupBy("detector").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(~F.col("structural")).alias("false_episodes"))
    return points.join(medians, "detector", "left").join(events, "detector", "left").join(episodes, "detector", "left").fillna(0, ["episodes", "false_episodes"])


def rounded(report):
    digits = {"median_noise_score": 4, "median_structural_score": 4}
    return report.withColumns({
        c: fixed(c, digits.get(c, 6)) for c, kind in report.dtypes if kind == "double"
    })


def random_hit(features, affected, k):
    """Chance that ``k`` features drawn at random hold one of the affected."""
    return 1 - comb(features - affected, k) / comb(features, k)


def gates(report, candidate, baseline, features, affected, k=3):
    """One row: each acceptance gate of the candidate, and whether all hold."""
    c, b = (report.where(F.col("detector") == name) for name in (candidate, baseline))
    one = c.select("event_recall", "noise_alert_rate", F.coalesce("hit_at_3", F.lit(0.0)).alias("hit_at_3")).crossJoin(F.broadcast(b.select(F.col("noise_alert_rate").alias("other"))))
    tests = {
        "recall_at_least_0_8": F.col("event_recall") >= 0.8, "noise_at_most_0_1": F.col("noise_alert_rate") <= 0.1,
        "hit_at_least_0_8": F.col("hit_at_3") >= 0.8, "hit_above_chance": F.col("hit_at_3") > random_hit(features, affected, k),
        "less_noise_than_baseline": F.col("noise_alert_rate") < F.col("other"),
    }
    passed = one.select(*[x.alias(n) for n, x in tests.items()])
    return passed.withColumn("all_passed", F.least(*[F.col(n).cast("int") for n in tests]) == 1)
