"""Compiled window matrices as files: long rows with masks, and one row that describes them.

``cells`` holds (run, window_end, feature, value, observed, reset), one row for each cell; a missing or non-finite
value is NULL. ``about`` holds the format version, the feature names and their schema id, the digest of the capture
and the quality counts. Reading checks all of it on the executors before any row is handed on.
"""

import hashlib

from pyspark.sql import functions as F

VERSION = 1
CELLS = "run bigint, window_end bigint, feature string, value double, observed boolean, reset boolean"
ABOUT = "version int, features array<string>, schema_id string, capture_sha256 string, quality map<string, bigint>"


def schema_id(features):
    """Identity of a list of feature names, in order."""
    return hashlib.sha256(",".join(features).encode()).hexdigest()


def write(cells, folder, features, capture_sha256, flagged_points=0):
    """Write a compiled matrix: rows of ``run, window_end, feature, value, reset``, of the named features only."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = cells.where(F.col("feature").isin(*features)).select(
        F.col("run").cast("bigint").alias("run"), F.col("window_end").cast("bigint").alias("window_end"), "feature",
        F.when(finite, F.col("value")).alias("value"), finite.alias("observed"), F.coalesce("reset", F.lit(False)).alias("reset"),
    )
    rows.write.parquet(f"{folder}/cells")
    back = cells.sparkSession.read.schema(CELLS).parquet(f"{folder}/cells")
    counts = back.agg(F.count_if(~F.col("observed")).alias("missing"), F.count_if("reset").alias("resets"))
    about = counts.select(
        F.lit(VERSION).alias("version"), F.array(*[F.lit(f) for f in features]).alias("features"), F.lit(schema_id(features)).alias("schema_id"),
        F.lit(capture_sha256).alias("capture_sha256"),
        F.create_map(F.lit("missing_cells"), "missing", F.lit("reset_cells"), "resets", F.lit("flagged_points"), F.lit(flagged_points).cast("bigint")).alias("quality"),
    )
    about.coalesce(1).write.parquet(f"{folder}/about")


def read(spark, folder):
    """(cells, about) of a written matrix; a broken one is an error.

    The mask must say exactly which values are finite, every window of a run must hold each feature once and no other,
    and the schema id and the quality counts must be those of the cells.
    """
    about = spark.read.schema(ABOUT).parquet(f"{folder}/about").collect()
    if len(about) != 1 or about[0].version != VERSION:
        raise ValueError(f"no compiled matrix of version {VERSION}")
    about = about[0]
    cells = spark.read.schema(CELLS).parquet(f"{folder}/cells")
    names = list(about.features)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    known = F.coalesce(F.col("feature").isin(*names), F.lit(False))
    # Partial counts per window leave one short row for each window to shuffle.
    windows = cells.groupBy("run", "window_end").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("feature").alias("d"), F.count_if(~known).alias("unknown"),
        F.count_if(~F.col("observed").eqNullSafe(finite)).alias("masked"), F.count_if(~F.col("observed")).alias("missing"), F.count_if("reset").alias("resets"),
    )
    wide = (F.col("n") != len(names)) | (F.col("d") != len(names)) | (F.col("unknown") > 0)
    seen = windows.agg(F.count_if(wide).alias("axes"), F.sum("masked").alias("masked"), F.sum("missing").alias("missing"), F.sum("resets").alias("resets")).first()
    if seen.masked:
        raise ValueError(f"{seen.masked} cells: the observed mask must say exactly which values are finite")
    if seen.axes:
        raise ValueError(f"{seen.axes} windows do not hold each feature once")
    if schema_id(names) != about.schema_id:
        raise ValueError("the schema id is not that of the feature names")
    if (seen.missing or 0, seen.resets or 0) != (about.quality["missing_cells"], about.quality["reset_cells"]):
        raise ValueError("the quality counts are not those of the cells")
    return cells, about


def to_json(cells):
    """One JSON document per run: window ends, and for each feature its values (null where missing) and masks."""
    per = cells.groupBy("run", "feature").agg(F.sort_array(F.collect_list(F.struct("window_end", "value", "observed", "reset"))).alias("w"))
    pick = lambda name: F.transform("w", lambda x: x[name]).alias(name)
    parts = F.struct("feature", F.transform("w", lambda x: x["window_end"]).alias("window_end_unix_nano"), pick("value"), pick("observed"), pick("reset"))
    return per.groupBy("run").agg(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.sort_array(F.collect_list(parts)).alias("features")), {"ignoreNullFields": "false"}).alias("json"))
