"""Span trees: parent links, depth, exact paths, coverage."""

from pyspark.sql import functions as F

from tidegauge.session import materialize


def structure(spans):
    """Per trace: spans, repeated span ids, missing parents."""
    parents = spans.select("trace", F.col("span").alias("parent")).distinct().withColumn("_ok", F.lit(True))
    rows = spans.join(parents, ["trace", "parent"], "left")
    return rows.groupBy("trace").agg(
        F.count(F.lit(1)).alias("spans"),
        (F.count(F.lit(1)) - F.count_distinct("span")).alias("repeated"),
        F.count_if(F.col("parent").isNotNull() & F.col("_ok").isNull()).alias("missing_parents"),
    ).withColumn("valid", (F.col("repeated") == 0) & (F.col("missing_parents") == 0))


def depths(spans):
    """Depth of each span, counted up the parent links; NULL on and below a cycle.

    Each round doubles the jump, so rounds grow with the logarithm of the depth. A
    jump past the number of spans means a cycle, and what still climbs is on or
    below one. Rounds are written, which keeps the plan short.
    """
    known = spans.select("trace", F.col("span").alias("up")).distinct().withColumn("_known", F.lit(True))
    rows = materialize(
        spans.select("trace", "span", F.col("parent").alias("up")).join(known, ["trace", "up"], "left")
        .select("trace", "span", F.when(F.col("_known"), F.col("up")).alias("up"))
        .withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0))
    )
    jump, total = 1, rows.count()
    while jump <= total and not rows.where(F.col("up").isNotNull()).isEmpty():
        far = rows.select("trace", F.col("span").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        rows = materialize(rows.join(far, ["trace", "up"], "left").select(
            "trace", "span", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")
        ))
        jump *= 2
    return rows.select("trace", "span", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def exact_path(spans, names):
    """Does a trace hold each named span once, each the child of the one before,
    with starts that do not fall and ends not before starts.

    Only spans of the path's names are gathered; a name that repeats fails before.
    """
    named = spans.where(F.col("name").isin(*names))
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    counts = named.groupBy("trace", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(position.alias("p"), "span", "parent", "start", "end")).alias("s"),
    )
    rows = counts.groupBy("trace").agg(
        F.max("n").alias("top"), F.array_sort(F.collect_list("s")).alias("path")
    )
    follows = F.forall(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda j: (F.get("path", j)["parent"] == F.get("path", j - 1)["span"])
        & (F.get("path", j)["start"] >= F.get("path", j - 1)["start"]),
    ) if len(names) > 1 else F.lit(True)
    ends = F.forall("path", lambda s: s["end"] >= s["start"])
    complete = (F.col("top") == 1) & (F.size("path") == len(names))
    return rows.select(
        "trace",
        F.when(complete, follows & ends & F.get("path", 0)["parent"].isNull()).otherwise(False).alias("exact"),
    )


def coverage(accepted, completed):
    """Share of accepted traces that are also completed; 0 when none was accepted."""
    hit = accepted.select("trace").distinct().join(
        completed.select("trace").distinct().withColumn("_ok", F.lit(1)), "trace", "left"
    )
    n = F.count(F.lit(1))
    return hit.agg(
        n.alias("accepted"), F.count("_ok").alias("completed"),
        F.when(n > 0, F.count("_ok") / n).otherwise(0.0).alias("ratio"),
    )
