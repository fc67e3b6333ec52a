"""Content-addressed snapshots, file manifests, detection events, inventories."""

import json

from pyspark.sql import functions as F


def table_digest(df):
    """Order-free digest of a table: rows, xor and sum of row hashes, as one row."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"),
    )


def snapshot_key(df, meta):
    """Hash of the meaning (sorted JSON of ``meta``), the schema and the data digest."""
    text = json.dumps({"meta": meta, "schema": df.schema.simpleString()}, sort_keys=True)
    return table_digest(df).select(
        F.sha2(F.concat_ws("|", F.lit(text), F.col("rows").cast("string"), F.col("xor").cast("string"), "sum"), 256).alias("key"),
        "rows",
    )


def write_snapshot(df, root, meta):
    """Write a table under its own hash; an existing snapshot is never overwritten."""
    key = snapshot_key(df, meta).first().key
    path = f"{root}/{key}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_snapshot(spark, path, schema, meta):
    """Read a snapshot back; its digest must give the name of its folder."""
    df = spark.read.schema(schema).parquet(path)
    if snapshot_key(df, meta).first().key != path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"snapshot {path} does not match its digest")
    return df


def verify_manifest(spark, folder, manifest, pattern="*", depth=1):
    """Files of a folder against declared ``path, sha256``: missing, unexpected, changed.

    ``path`` is the last ``depth`` parts of a file's path.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder)
        .select(F.substring_index("path", "/", -depth).alias("path"), F.sha2("content", 256).alias("_found"))
    )
    both = manifest.join(files, "path", "full_outer")
    status = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected")
        .when(F.col("_found") != F.col("sha256"), "changed").otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def detection_events(scored, evidence, kind, version, schema_id):
    """Nested detection events: one per (run, window) with its evidence and quality counts."""
    top = evidence.groupBy("run", "window_end").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", F.col("feature").alias("name"), F.col("evidence").alias("magnitude"),
            F.when(F.col("signed") >= 0, "increase").otherwise("decrease").alias("direction"),
        ))).alias("_t")
    )
    feats = F.transform("_t", lambda x: F.struct(x["name"].alias("name"), x["magnitude"].alias("magnitude"), x["direction"].alias("direction")))
    empty = F.array().cast("array<struct<name:string,magnitude:double,direction:string>>")
    return scored.join(top, ["run", "window_end"], "left").select(
        "run", F.lit(kind).alias("model_kind"), F.sha2(F.lit(version), 256).alias("model_version"),
        F.sha2(F.lit(schema_id), 256).alias("feature_schema_id"),
        F.col("window_end").alias("window_end_unix_nano"), "score", "threshold", "alert",
        F.coalesce(feats, empty).alias("top_features"), "data_quality",
    )


def event_violations(events):
    """Broken rules of detection events, one row per event and rule."""
    names = F.transform("top_features", lambda x: x["name"])
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    rules = {
        "model kind is empty": F.col("model_kind") != "", "model version is no hash": sha("model_version"),
        "schema id is no hash": sha("feature_schema_id"),
        "window end is not positive": F.col("window_end_unix_nano") > 0,
        "score is not finite": finite("score"), "threshold is not finite": finite("threshold"),
        "feature names repeat": F.size(F.array_distinct(names)) == F.size(names),
        "alert without evidence": ~F.col("alert") | (F.size("top_features") > 0),
        "negative quality count": F.forall(F.map_values("data_quality"), lambda x: x >= 0),
    }
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules.items()
    ]))
    return events.select("run", "window_end_unix_nano", F.explode(broken).alias("violation"))


def inventory(catalog, files, extractors):
    """Normalised corpus records from a catalog and the text of its artifacts.

    ``catalog``: corpus, campaign, source_campaign, stack, status, role, extractor, path;
    ``files``: path, content (text), sha256; ``extractors``: name -> (JSON schema,
    {field: Column of the parsed ``j``}). Unknown extractors fail.
    """
    names = [r.extractor for r in catalog.select("extractor").distinct().limit(len(extractors) + 1).collect()]
    unknown = sorted(set(names) - set(extractors))
    if unknown:
        raise ValueError(f"unknown extractors {unknown}")
    joined = catalog.join(files, "path", "left")
    out = None
    for name, (schema, fields) in sorted(extractors.items()):
        part = joined.where(F.col("extractor") == name).withColumn("j", F.from_json("content", schema))
        part = part.select(
            *catalog.columns, "sha256", *[c.alias(f) for f, c in fields.items()]
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
