"""Log records matched to declared count features."""

from pyspark.sql import functions as F

# Attributes that a log feature may filter on.
SAFE_ATTRIBUTES = [
    "deployment.environment.name", "event.name", "event_type", "service.name",
    "service.namespace", "service.version",
]

SPEC_SCHEMA = "name string, filter map<string,string>, min_severity int"


def feature_spec(spark, rows):
    """Declared features ``(name, attribute filter, minimum severity)``; unsafe ones fail."""
    for name, wanted, severity in rows:
        unsafe = sorted(set(wanted) - set(SAFE_ATTRIBUTES))
        if unsafe:
            raise ValueError(f"feature {name!r} filters unsafe attributes {unsafe}")
        if not wanted and severity is None:
            raise ValueError(f"feature {name!r} needs an attribute or severity filter")
        if severity is not None and not 1 <= severity <= 24:
            raise ValueError(f"feature {name!r}: severity outside 1..24")
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def contains(actual, expected):
    """All expected key = value pairs are present."""
    return F.forall(
        F.map_entries(expected),
        lambda e: F.coalesce(F.element_at(actual, e["key"]) == e["value"], F.lit(False)),
    )


def matched_features(records, spec):
    """Each record with the array of feature names it matches.

    The spec is a declared list, a few rows long; it is folded into one literal
    array so that matching needs no join and no row multiplication.
    """
    wanted = []
    for r in spec.collect():
        cond = F.lit(True)
        for key, value in sorted((r["filter"] or {}).items()):
            cond = cond & F.coalesce(F.element_at("attributes", key) == value, F.lit(False))
        if r["min_severity"] is not None:
            cond = cond & (F.col("severity") >= r["min_severity"])
        wanted.append(F.when(cond, F.lit(r["name"])))
    return records.withColumn("features", F.array_compact(F.array(*wanted)))


def dense_counts(records, spec, period):
    """Zero-filled count per (run, window, feature); a record counts in every match."""
    hits = (
        matched_features(records, spec)
        .select("run", "window_end", F.explode("features").alias("feature"))
        .groupBy("run", "window_end", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = records.groupBy("run").agg(
        F.min("window_end").alias("_lo"), F.max("window_end").alias("_hi")
    ).select("run", F.explode(F.sequence("_lo", "_hi", F.lit(period))).alias("window_end"))
    names = spec.select(F.col("name").alias("feature"))
    return (
        ends.crossJoin(F.broadcast(names))
        .join(hits, ["run", "window_end", "feature"], "left")
        .select("run", "window_end", "feature", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def match_totals(records, spec):
    hit = F.size("features") > 0
    return matched_features(records, spec).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"),
    )
