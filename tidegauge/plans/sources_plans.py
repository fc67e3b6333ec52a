"""Readers and writers run on files that Spark derives from the given tables."""

import uuid

from pyspark.sql import functions as F

from tidegauge.plans.registry import query
from tidegauge.plans.views import GRID, PTS
from tidegauge.session import shared_folder
from tidegauge.sources import otlp, snapshots


def folder_for(t, name):
    root = shared_folder(t.spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
    return f"{root}/tidegauge/{name}-{uuid.uuid4().hex}"


def text_value(c):
    return F.struct(c.cast("string").alias("stringValue"))


def attribute(key, c):
    return F.struct(F.lit(key).alias("key"), text_value(c).alias("value"))


def metric_lines(t):
    """Each event as one export request with one gauge point."""
    p = t.points
    point = F.struct(
        F.col("t").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"), "flags",
        F.array(attribute("seq", F.col("seq"))).alias("attributes"),
    )
    metric = F.struct(
        F.col("feature").alias("name"), F.lit("1").alias("unit"),
        F.struct(F.array(point).alias("dataPoints")).alias("gauge"),
    )
    scope = F.struct(
        F.struct(F.lit("app").alias("name"), F.lit("1.0").alias("version")).alias("scope"),
        F.array(metric).alias("metrics"),
    )
    res = F.struct(
        F.struct(F.array(attribute("run", F.col("run"))).alias("attributes")).alias("resource"),
        F.array(scope).alias("scopeMetrics"),
    )
    return p.select("run", "seq", F.to_json(F.struct(F.array(res).alias("resourceMetrics"))).alias("value"))


def log_lines(t):
    p = t.points
    record = F.struct(
        F.col("t").cast("string").alias("timeUnixNano"), (F.col("k") % 24 + 1).alias("severityNumber"),
        text_value(F.concat(F.lit("value "), F.col("k").cast("string"))).alias("body"),
        F.array(attribute("event.name", F.col("feature"))).alias("attributes"),
        F.when(F.col("k") < 50, F.lpad(F.hex("seq"), 32, "0")).alias("traceId"),
    )
    scope = F.struct(F.struct(F.lit("app").alias("name")).alias("scope"), F.array(record).alias("logRecords"))
    res = F.struct(
        F.struct(F.array(attribute("service.name", F.concat(F.lit("svc"), F.col("run").cast("string")))).alias("attributes")).alias("resource"),
        F.array(scope).alias("scopeLogs"),
    )
    return p.select("run", "seq", F.to_json(F.struct(F.array(res).alias("resourceLogs"))).alias("value"))


def span_lines(t):
    from tidegauge.plans.sequences import spans_of

    s = spans_of(t)
    span = F.struct(
        F.col("trace").cast("string").alias("traceId"), F.col("span").cast("string").alias("spanId"),
        F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("parentSpanId"), "name",
        F.col("start").cast("string").alias("startTimeUnixNano"), F.col("end").cast("string").alias("endTimeUnixNano"),
        F.struct(F.col("status").alias("code")).alias("status"),
        F.array(attribute("entity.id", F.col("name"))).alias("attributes"),
    )
    res = F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
    return s.select(F.to_json(F.struct(F.array(res).alias("resourceSpans"))).alias("value"))


def written(t, lines, name):
    path = folder_for(t, name)
    lines.select("value").write.text(path)
    return path


@query("S1_otlp_metric_scan", f"""
WITH {PTS} SELECT feature AS metric_name, t, value AS double_value, flags, '"' || run || '"' AS run, '"' || seq || '"' AS seq, 'gauge' AS kind FROM pts""")
def metric_scan(t):
    good, _ = otlp.metric_rows(otlp.read_lines(t.spark, written(t, metric_lines(t), "metrics")))
    return good.select(
        "metric_name", "t", "double_value", "flags", F.col("resource_attributes")["run"].alias("run"),
        F.col("point_attributes")["seq"].alias("seq"), "kind",
    )


@query("S2_otlp_log_scan", f"""
WITH {PTS} SELECT t, CAST(k % 24 + 1 AS INTEGER) AS severity, 'value ' || k AS body, '"' || feature || '"' AS event_name,
  '"svc' || run || '"' AS service, CASE WHEN k < 50 THEN lpad(upper(to_hex(seq)), 32, '0') ELSE '' END AS trace_id FROM pts""")
def log_scan(t):
    good, _ = otlp.log_rows(otlp.read_lines(t.spark, written(t, log_lines(t), "logs")))
    return good.select(
        "t", "severity", "body", F.col("attributes")["event.name"].alias("event_name"),
        F.col("resource_attributes")["service.name"].alias("service"), "trace_id",
    )


@query("S3_otlp_span_scan", """
SELECT CAST(conv_id AS VARCHAR) AS trace, CAST(turn AS VARCHAR) AS span, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) END AS parent,
  role AS name, role AS entity, CASE WHEN role = 'system' THEN 2 ELSE 0 END AS status, turn * 1000000000 AS start,
  turn * 1000000000 + len(text) * 2000000 AS "end" FROM conversations""")
def span_scan(t):
    good, _ = otlp.span_rows(otlp.read_lines(t.spark, written(t, span_lines(t), "spans")))
    return good.drop("file")


@query("S6_malformed_row_quarantine", """
SELECT CASE event_id % 20 WHEN 0 THEN 'not a readable JSON object' WHEN 1 THEN 'metric name is empty'
  WHEN 2 THEN 'metric kind is missing' WHEN 3 THEN 'number point must have exactly one value' ELSE 'ok' END AS problem, count(*) AS n
FROM events GROUP BY 1""")
def quarantine(t):
    k = F.col("seq") % 20
    v = F.col("value")
    broken = (
        F.when(k == 0, F.expr("substr(value, 1, 40)"))
        .when(k == 1, F.regexp_replace(v, r'"name":"(click|error|purchase|signup|view)"', '"name":""'))
        .when(k == 2, F.regexp_replace(v, '"gauge":', '"other":'))
        .when(k == 3, F.regexp_replace(F.regexp_replace(v, '"asDouble":[^,]*,', ""), '"flags":1', '"flags":0'))
        .otherwise(v)
    )
    lines = metric_lines(t).withColumn("value", broken)
    rows = otlp.metric_table(otlp.read_lines(t.spark, written(t, lines, "broken")))
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("S7_multi_run_scan", """
WITH c AS (SELECT 'case-' || (user_id % 16) AS case_id, count(*) AS points FROM events WHERE user_id % 16 <> 5 GROUP BY 1),
m AS (SELECT DISTINCT 'case-' || (user_id % 16) AS case_id FROM events WHERE user_id % 16 <> 9)
SELECT coalesce(c.case_id, m.case_id) AS case_id, CASE WHEN c.case_id IS NULL THEN 'capture missing' WHEN m.case_id IS NULL THEN 'not declared' ELSE 'matched' END AS status, points
FROM c FULL JOIN m USING (case_id)""")
def multi_run(t):
    case = F.concat(F.lit("case-"), (F.col("run") % 16).cast("string"))
    root = folder_for(t, "cases")
    metric_lines(t).where("run % 16 <> 5").select("value", case.alias("case")).write.partitionBy("case").text(root)
    declared = folder_for(t, "manifests")
    t.points.where("run % 16 <> 9").select(case.alias("case_id")).distinct().write.json(declared)
    good, _ = otlp.metric_rows(otlp.read_lines(t.spark, root))
    cases = good.withColumn("case_id", F.regexp_extract("file", r"case=([^/]+)/", 1))
    manifests = t.spark.read.schema("case_id string").json(declared).withColumn("_declared", F.lit(True))
    counts = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("points"))
    return otlp.join_manifests(cases, manifests).join(counts, "case_id", "left")


def extractors():
    return {
        "orders": ("n bigint, levels array<string>", {
            "run_count": F.col("j.n") * 2, "levels": F.array_sort("j.levels")}),
        "customers": ("count bigint, segments array<string>", {
            "run_count": F.col("j.count"), "levels": F.array_sort("j.segments")}),
    }


@query("S8_catalog_inventory", """
SELECT 'o' || o_orderpriority AS corpus, count(*) * 2 AS run_count, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS levels FROM orders GROUP BY 1
UNION ALL SELECT 'c' || c_nationkey, count(*), array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') FROM customer GROUP BY 1""")
def catalog_inventory(t):
    """Artifacts written as JSON files, read through a catalog by extractor."""
    a = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("o_orderstatus").alias("levels")
    ).select(F.concat(F.lit("o"), "o_orderpriority").alias("corpus"), F.lit("orders").alias("extractor"),
             F.to_json(F.struct("n", "levels")).alias("content"))
    b = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("count"), F.collect_set("c_mktsegment").alias("segments")
    ).select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("corpus"), F.lit("customers").alias("extractor"),
             F.to_json(F.struct("count", "segments")).alias("content"))
    root = folder_for(t, "artifacts")
    key = F.md5("corpus")
    rows = a.unionByName(b).withColumn("path", key)
    rows.select("content", "path").write.partitionBy("path").text(root)
    files = t.spark.read.text(root).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"path=([0-9a-f]+)", 1).alias("path"),
        F.col("value").alias("content"), F.sha2("value", 256).alias("sha256"),
    )
    found = snapshots.inventory(rows.select("corpus", "extractor", "path"), files, extractors())
    return found.select("corpus", "run_count", F.array_join("levels", ",").alias("levels"))


@query("S11_detection_event_sink", f"""
WITH {GRID}, s AS (SELECT run, window_end, max(value) AS score, count(*) FILTER (NOT observed) AS missing FROM grid GROUP BY ALL)
SELECT run, window_end AS window_end_unix_nano, score, score > 150 AS alert, CAST(CASE WHEN score > 150 THEN
  (SELECT count(*) FROM grid g WHERE g.run = s.run AND g.window_end = s.window_end AND g.value > 100) ELSE 0 END AS BIGINT) AS features, missing
FROM s WHERE score IS NOT NULL""")
def event_sink(t):
    s = t.grid.groupBy("run", "window_end").agg(
        F.max("value").alias("score"), F.count_if(~F.col("observed")).alias("missing")
    ).where("score IS NOT NULL").withColumn("threshold", F.lit(150.0)).withColumn(
        "alert", F.col("score") > 150
    ).withColumn("data_quality", F.create_map(F.lit("missing_cells"), F.col("missing")))
    ev = t.grid.where("value > 100").join(s.where("alert").select("run", "window_end"), ["run", "window_end"]).select(
        "run", "window_end", "feature", F.col("value").alias("evidence"), F.col("value").alias("signed"),
        (-F.col("value")).alias("rank"),
    )
    out = snapshots.detection_events(s, ev, "peak", "v1", "daily")
    path = folder_for(t, "detections")
    out.write.parquet(path)
    back = t.spark.read.schema(out.schema).parquet(path)
    clean = back.join(snapshots.event_violations(back).select("run", "window_end_unix_nano"), ["run", "window_end_unix_nano"], "left_anti")
    return clean.select(
        "run", "window_end_unix_nano", "score", "alert", F.size("top_features").cast("bigint").alias("features"),
        F.col("data_quality")["missing_cells"].alias("missing"),
    )


@query("S12_content_addressed_snapshot", """
SELECT count(*) AS "rows", true AS verified FROM orders""")
def snapshot(t):
    root = folder_for(t, "snapshots")
    meta = {"table": "orders", "version": 1}
    path = snapshots.write_snapshot(t.orders, root, meta)
    back = snapshots.load_snapshot(t.spark, path, t.orders.schema, meta)
    return snapshots.table_digest(back).select("rows", F.lit(True).alias("verified"))


@query("S13_file_manifest_check", """
SELECT 'ok' AS status, count(DISTINCT user_id % 16) AS files FROM events WHERE user_id % 16 NOT IN (3, 5)
UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'changed', count(DISTINCT user_id % 16) FROM events WHERE user_id % 16 = 3
UNION ALL SELECT 'unexpected', count(DISTINCT user_id % 16) FROM events WHERE user_id % 16 = 5""")
def manifest_check(t):
    """Files of one bucket each; one declared hash is wrong, one file undeclared, one absent."""
    root = folder_for(t, "files")
    bucket = (F.col("user_id") % 16).alias("bucket")
    t.events.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).repartition("bucket").select(
        F.to_json(F.struct("bucket", "n")).alias("value"), "bucket"
    ).write.partitionBy("bucket").text(root)
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.txt"
    ).load(root).select(
        F.substring_index("path", "/", -2).alias("path"), F.sha2("content", 256).alias("sha256"),
        F.regexp_extract("path", r"bucket=([0-9]+)", 1).cast("int").alias("b"),
    )
    declared = found.where("b <> 5").select(
        "path", F.when(F.col("b") == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256")
    )
    absent = t.spark.range(1).select(F.lit("absent.txt").alias("path"), F.sha2(F.lit("x"), 256).alias("sha256"))
    checked = snapshots.verify_manifest(t.spark, root, declared.unionByName(absent), "*.txt", depth=2)
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
