"""Training frames per run and feature, scaling, and fold refits."""

from pyspark.sql import Window, functions as F

from tidegauge.operators import skew
from tidegauge.session import materialize

MAD_TO_SIGMA = 1.4826
EPS = 1e-12


def halo(series, keys, before, after):
    """Series rows in blocks of the index ``i``, with the rows that frames of a block's border need.

    A block holds at most ``tidegauge.maxGroupRows`` steps, so one long series is cut over many tasks
    without counting it first. The last ``before`` and the first ``after`` steps of a block are copied to its
    neighbours; copies have ``_own`` false. Returns the rows and the window that orders a block.
    """
    size = max(skew.max_group_rows(series.sparkSession), before + after + 1)
    block, at = F.floor(F.col("i") / F.lit(size)), F.pmod(F.col("i"), F.lit(size))
    places = F.array(block, F.when(at >= size - before, block + 1), F.when(at < after, block - 1))
    rows = series.withColumn("_block", F.explode(F.array_compact(places)))
    return rows.withColumn("_own", F.col("_block") == block), Window.partitionBy(*keys, "_block").orderBy("i")


def framed(series, keys, before, after, columns):
    """Rows with frames ``{name: (column, first, last)}`` that hold every step from first to last, relative to the row."""
    rows, w = halo(series, keys, before, after)
    built, whole = {}, F.col("_own")
    for name, (column, first, last) in columns.items():
        frame = w.rowsBetween(first, last)
        built[name] = F.collect_list(column).over(frame)
        built[f"_first_{name}"] = F.min("i").over(frame)
        built[f"_last_{name}"] = F.max("i").over(frame)
        here = (F.size(name) == last - first + 1) & (F.col(f"_first_{name}") == F.col("i") + first)
        whole = whole & here & (F.col(f"_last_{name}") == F.col("i") + last)
    return rows.withColumns(built).where(whole)


def lookback_frames(series, keys, lookback, value="value"):
    """Context of the ``lookback`` steps before each target step of the same run; a missing step gives no frame."""
    rows = framed(series, keys, lookback, 0, {"context": (value, -lookback, -1)})
    return rows.select(*keys, "i", "context", F.col(value).alias("target"))


def future_blocks(series, keys, horizons, block, value="value"):
    """Blocks of ``block`` steps that begin at horizon h after each context end.

    The row of step i closes its context at i - 1, so horizon 1 starts at i.
    """
    rows, w = halo(series, keys, 0, max(horizons) + block - 2)
    built = {}
    for h in horizons:
        frame = w.rowsBetween(h - 1, h + block - 2)
        whole = (F.min("i").over(frame) == F.col("i") + h - 1) & (F.max("i").over(frame) == F.col("i") + h + block - 2)
        built[f"_h{h}"] = F.when(whole, F.collect_list(value).over(frame))
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("block")) for h in horizons
    ])
    rows = rows.withColumns(built).where("_own").select(*keys, "i", F.explode(pairs).alias("b"))
    return rows.select(*keys, "i", "b.horizon", "b.block").where(F.size("block") == block)


def history_future_frames(series, keys, history, future, value="value", action=None):
    """History ends at i, future starts at i + 1; the action at t predicts t + 1."""
    columns = {"history": (value, -(history - 1), 0), "future": (value, 1, future)}
    if action:
        columns["actions"] = (action, 0, future - 1)
    rows = framed(series, keys, history - 1, future, columns)
    return rows.select(*keys, "i", *columns)


def encode_actions(steps, actions, keys):
    """Action state of each step of its run and target.

    ``actions``: one row per (run, target) interval ``[start_i, stop_i)`` with
    kind and scaled magnitude. The stop step keeps kind and phase only.
    """
    active = (F.col("i") >= F.col("start_i")) & (F.col("i") < F.col("stop_i"))
    stop = F.col("i") == F.col("stop_i")
    duration = (F.col("stop_i") - F.col("start_i")).cast("double")
    phase = (
        F.when(F.col("i") == F.col("start_i"), "start").when(active, "active").when(stop, "stop")
    )
    hit = active | stop
    return steps.join(actions, keys, "left").select(
        *keys, "i",
        F.coalesce(~hit, F.lit(True)).alias("no_action"),
        F.coalesce(hit, F.lit(False)).alias("applicable"),
        F.when(hit, F.col("kind")).alias("kind"),
        phase.alias("phase"),
        F.when(active, F.col("scaled_magnitude")).otherwise(0.0).alias("magnitude"),
        F.when(active, (F.col("i") - F.col("start_i")) / duration).otherwise(0.0).alias("elapsed"),
        F.when(active, (F.col("stop_i") - F.col("i")) / duration).otherwise(0.0).alias("remaining"),
    )


def robust_scale(df, keys, value):
    """Median and 1.4826 MAD per key; falls back to population std, then to 1.

    The input is read once, into a written table of value counts; median, absolute
    deviations and std come from that table.
    """
    keys = list(keys)
    counts = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w")))

    def beside(left, right):
        return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))

    center = skew.exact_quantiles(counts, keys, value, {"location": 0.5}, weight="_w")
    center = materialize(center)
    off = beside(counts, center).withColumn("_dev", F.abs(F.col(value) - F.col("location")))
    mad = skew.exact_quantiles(off, keys, "_dev", {"_mad": 0.5}, weight="_w")
    mean = counts.groupBy(*keys).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("_m"))
    sq = (F.col(value) - F.col("_m")) * (F.col(value) - F.col("_m")) * F.col("_w")
    spread = beside(counts, mean).groupBy(*keys).agg(F.sqrt(F.sum(sq) / F.sum("_w")).alias("_sd"))
    scale = (
        F.when(MAD_TO_SIGMA * F.col("_mad") > EPS, MAD_TO_SIGMA * F.col("_mad"))
        .when(F.col("_sd") > EPS, F.col("_sd"))
        .otherwise(1.0)
    )
    return beside(beside(center, mad), spread).select(*keys, "location", scale.alias("scale"))


def standard_scale(df, keys, value):
    """Mean and population std per key; zero std becomes 1."""
    sd = F.stddev_pop(value)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("location"), F.when(sd > EPS, sd).otherwise(1.0).alias("scale")
    )


def apply_scale(df, fit, keys, value, out="z"):
    """Scale by a fitted table; ``fit`` has one row per key, e.g. per feature."""
    joined = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    return joined.withColumn(out, (F.col(value) - F.col("location")) / F.col("scale")).drop(
        "location", "scale"
    )


def invert_scale(df, fit, keys, z, out="value"):
    joined = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    return joined.withColumn(out, F.col(z) * F.col("scale") + F.col("location")).drop(
        "location", "scale"
    )


def repair_isolated_outliers(rows, sample, value, threshold, consensus_rank):
    """Replace outliers seen in fewer than ``consensus_rank`` features of a row.

    The replacement is the median of the row's other features. ``sample`` names
    one feature row, so a window holds as many rows as there are features.
    """
    w = Window.partitionBy(*sample)
    out = F.abs(F.col(value)) > threshold
    marked = rows.withColumn("_out", out).withColumn("_n", F.count_if("_out").over(w))
    marked = marked.withColumn("repaired", F.col("_out") & (F.col("_n") < consensus_rank))
    median = F.median(F.when(~F.col("repaired"), F.col(value))).over(w)
    return marked.withColumn(
        "fixed_value", F.when(F.col("repaired"), median).otherwise(F.col(value))
    ).drop("_out", "_n")


def rebuild_trajectory(frames, keys, tolerance=1e-6):
    """Steps from overlapping contexts; copies must agree, and steps be gap-free."""
    steps = frames.select(
        *keys, "i", F.size("context").alias("_n"), F.posexplode("context").alias("_p", "v")
    ).select(*keys, (F.col("i") - F.col("_n") + F.col("_p")).alias("i"), "v")
    merged = steps.groupBy(*keys, "i").agg(
        F.min("v").alias("value"), (F.max("v") - F.min("v")).alias("_gap"),
        F.count(F.lit(1)).alias("copies"),
    )
    # The last step of a series has none after it, and a step before a gap at a block's end sees none.
    ends = merged.groupBy(*keys).agg(F.max("i").alias("_end"))
    merged, w = halo(merged.join(ends, list(keys)), keys, 0, 1)
    nxt = F.lead("i").over(w)
    return merged.withColumn("agrees", F.col("_gap") <= tolerance).withColumn(
        "gap_free", F.coalesce(nxt == F.col("i") + 1, F.col("i") == F.col("_end"))
    ).where("_own").drop("_gap", "_own", "_block", "_end")


def held_out_folds(df, group, groups):
    """One copy of a row for each fold that does not hold its group out."""
    folds = F.array(*[F.lit(g) for g in groups])
    return df.withColumn("fold", F.explode(F.array_remove(folds, F.col(group))))


def shortest_period(schedule):
    """Shortest prefix of an integer schedule that repeats to its whole length."""
    n = F.size(schedule)
    fits = F.filter(
        F.sequence(F.lit(1), n),
        lambda p: F.forall(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(schedule, i) == F.get(schedule, i % p),
        ),
    )
    return F.slice(schedule, F.lit(1), F.element_at(fits, 1))


def largest_level_held_out(df, pair, level):
    """Hold out the pairs at the largest level; a pair must carry one level."""
    pairs = df.groupBy(pair).agg(F.min(level).alias("level"), F.max(level).alias("_hi"))
    top = pairs.agg(F.max("_hi").alias("_top"))
    return pairs.crossJoin(F.broadcast(top)).select(
        pair, "level", (F.col("level") == F.col("_hi")).alias("constant"),
        (F.col("_hi") == F.col("_top")).alias("held_out"),
    )
