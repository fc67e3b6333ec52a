"""OTLP JSON-lines readers: metrics, logs and traces to flat rows.

Every reader gives the good rows and a quarantine of located problems, so that
nothing is dropped unseen. The same functions take a streaming frame of lines.
"""

from functools import reduce

from pyspark.sql import functions as F

from tidegauge.functions.attributes import attribute_map, attribute_problem, exactly_one, number_fields

KV = (
    "array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:string,"
    "doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>>>"
)
POINT = (
    f"struct<startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:string,flags:int,"
    f"count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,attributes:{KV}>"
)
METRICS = (
    f"resourceMetrics array<struct<resource:struct<attributes:{KV}>,scopeMetrics:array<struct<"
    f"scope:struct<name:string,version:string>,metrics:array<struct<name:string,unit:string,"
    f"gauge:struct<dataPoints:array<{POINT}>>,"
    f"sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<{POINT}>>,"
    f"histogram:struct<aggregationTemporality:int,dataPoints:array<{POINT}>>,"
    f"exponentialHistogram:string,summary:string>>>>>>"
)
LOGS = (
    f"resourceLogs array<struct<schemaUrl:string,resource:struct<attributes:{KV},"
    f"droppedAttributesCount:int>,scopeLogs:array<struct<schemaUrl:string,scope:struct<name:string,"
    f"version:string,attributes:{KV},droppedAttributesCount:int>,logRecords:array<struct<"
    f"timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
    f"bytesValue:string,arrayValue:string,kvlistValue:string>,attributes:{KV},traceId:string,"
    f"spanId:string,flags:int,droppedAttributesCount:int>>>>>>"
)
SPANS = (
    f"resourceSpans array<struct<resource:struct<attributes:{KV}>,scopeSpans:array<struct<"
    f"scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,"
    f"parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"status:struct<code:int>,attributes:{KV}>>>>>>"
)
CORRUPT = "_corrupt_record"
KINDS = ["gauge", "sum", "histogram"]
REFUSED = ["exponentialHistogram", "summary"]


def read_lines(spark, path):
    """Lines of capture files with the file they came from; blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.length(F.trim("value")) > 0)


def stream_lines(spark, folder, **options):
    """The same lines as a file stream."""
    source = spark.readStream.format("text").options(**options).load(folder)
    return source.select("value", F.col("_metadata.file_path").alias("file")).where(
        F.length(F.trim("value")) > 0
    )


def _parse(lines, schema):
    parsed = F.from_json(
        "value", f"{schema}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull() | ~F.trim("value").startswith("{")
    return lines.withColumn("r", parsed).withColumn(
        "problem", F.when(F.coalesce(bad, F.lit(True)), "not a readable JSON object")
    )


def _first_problem(*reasons):
    return reduce(lambda a, b: F.coalesce(a, b), reasons)


def _each(items):
    """One row per item of a sound row; a row with a problem stays one row, so that one pass finds all."""
    return F.explode(F.when(F.col("problem").isNull(), items).otherwise(F.array(F.lit(None))))


def metric_table(lines):
    """One row per data point and per problem of a metrics capture, from one reading of each line.

    ``problem`` is NULL for a good point; of a row with a problem, only ``file`` and ``problem`` mean something.
    """
    top = _parse(lines, METRICS)
    res = top.select("file", "problem", _each(F.col("r.resourceMetrics")).alias("res"))
    scoped = res.select("file", "problem", F.col("res.resource.attributes").alias("ra"), _each(F.col("res.scopeMetrics")).alias("s"))
    m = scoped.select("file", "problem", "ra", "s.scope", _each(F.col("s.metrics")).alias("m"))
    present = sum((F.col(f"m.{k}").isNotNull().cast("int") for k in KINDS[1:] + REFUSED), F.col("m.gauge").isNotNull().cast("int"))
    refused = F.col("m.exponentialHistogram").isNotNull() | F.col("m.summary").isNotNull()
    reason = (
        F.when(F.coalesce(F.col("m.name"), F.lit("")) == "", "metric name is empty")
        .when(present > 1, "more than one metric kind").when(present == 0, "metric kind is missing")
        .when(refused, "metric kind is not supported")
    )
    m = m.withColumn("problem", _first_problem(F.col("problem"), reason, attribute_problem(F.col("ra"))))
    kind = reduce(lambda a, k: F.when(F.col(f"m.{k}").isNotNull(), k).otherwise(a), KINDS, F.lit(None).cast("string"))
    points = F.coalesce(*[F.col(f"m.{k}.dataPoints") for k in KINDS])
    p = m.select(
        "file", "problem", F.col("m.name").alias("metric_name"), F.coalesce("m.unit", F.lit("")).alias("unit"),
        kind.alias("kind"),
        F.coalesce("m.sum.aggregationTemporality", "m.histogram.aggregationTemporality", F.lit(0)).alias("temporality"),
        F.coalesce("m.sum.isMonotonic", F.lit(False)).alias("monotonic"),
        attribute_map(F.col("ra")).alias("resource_attributes"),
        F.coalesce("scope.name", F.lit("")).alias("scope_name"),
        F.coalesce("scope.version", F.lit("")).alias("scope_version"),
        _each(points).alias("p"),
    )
    time = F.col("p.timeUnixNano").try_cast("bigint")
    start = F.col("p.startTimeUnixNano").try_cast("bigint")
    as_int, as_double, number_ok = number_fields(F.col("p"))
    count = F.col("p.count").try_cast("bigint")
    flags = F.coalesce("p.flags", F.lit(0))
    is_hist = F.col("kind") == "histogram"
    reason = (
        F.when(time.isNull(), "point time is missing or not a whole number")
        .when(F.col("p.startTimeUnixNano").isNotNull() & start.isNull(), "start time is not a whole number")
        .when(~is_hist & ~number_ok, "number point must have exactly one value")
        .when(is_hist & count.isNull() & (flags.bitwiseAND(1) == 0), "histogram point has no count")
    )
    p = p.withColumn("problem", _first_problem(F.col("problem"), reason, attribute_problem(F.col("p.attributes"))))
    return p.select(
        "file", "problem", "metric_name", "unit", "kind", "temporality", "monotonic", time.alias("t"),
        start.alias("start_t"), flags.alias("flags"), "resource_attributes",
        attribute_map(F.col("p.attributes")).alias("point_attributes"), "scope_name", "scope_version",
        F.when(~is_hist, as_int).alias("int_value"), F.when(~is_hist, as_double).alias("double_value"),
        F.when(is_hist, count).alias("hist_count"), F.when(is_hist, F.col("p.sum")).alias("hist_sum"),
        F.transform("p.bucketCounts", lambda x: x.cast("bigint")).alias("bucket_counts"),
        F.col("p.explicitBounds").alias("explicit_bounds"),
    )


def metric_rows(lines):
    """The good points of a metrics capture, and its problems."""
    rows = metric_table(lines)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select("file", "problem")


def log_rows(lines):
    """One row per log record or per problem of a logs capture."""
    top = _parse(lines, LOGS)
    bad = top.where("problem IS NOT NULL").select("file", "problem")
    res = top.where("problem IS NULL").select("file", F.explode("r.resourceLogs").alias("res"))
    scoped = res.select("file", "res", F.explode("res.scopeLogs").alias("s"))
    rec = scoped.select("file", "res", "s", F.explode("s.logRecords").alias("l"))
    time = F.col("l.timeUnixNano").try_cast("bigint")
    lists = [F.col("res.resource.attributes"), F.col("s.scope.attributes"), F.col("l.attributes")]
    body = F.col("l.body")
    kinds = [body[f] for f in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")]
    reason = F.when(time.isNull(), "record time is missing or not a whole number").when(
        body.isNotNull() & ~exactly_one(kinds), "record body must have exactly one value"
    )
    rec = rec.withColumn("problem", _first_problem(reason, *[attribute_problem(x) for x in lists]))
    bad = bad.unionByName(rec.where("problem IS NOT NULL").select("file", "problem"))
    none, zero = F.lit(""), F.lit(0)
    good = rec.where("problem IS NULL").select(
        "file", time.alias("t"), F.col("l.observedTimeUnixNano").try_cast("bigint").alias("observed_t"),
        F.coalesce("l.severityNumber", zero).alias("severity"),
        F.coalesce("l.severityText", none).alias("severity_text"),
        F.coalesce(body["stringValue"], *[x.cast("string") for x in kinds[1:]]).alias("body"),
        body["stringValue"].isNotNull().alias("body_is_text"),
        attribute_map(lists[0]).alias("resource_attributes"), attribute_map(lists[2]).alias("attributes"),
        F.coalesce("s.scope.name", none).alias("scope_name"),
        F.coalesce("s.scope.version", none).alias("scope_version"),
        F.coalesce("l.traceId", none).alias("trace_id"), F.coalesce("l.spanId", none).alias("span_id"),
        F.coalesce("l.flags", zero).alias("flags"),
        F.coalesce("l.droppedAttributesCount", zero).alias("dropped_attributes"),
        F.coalesce("res.schemaUrl", none).alias("resource_schema_url"),
        F.coalesce("res.resource.droppedAttributesCount", zero).alias("resource_dropped_attributes"),
        attribute_map(lists[1]).alias("scope_attributes"),
        F.coalesce("s.scope.droppedAttributesCount", zero).alias("scope_dropped_attributes"),
        F.coalesce("s.schemaUrl", none).alias("scope_schema_url"),
    )
    return good, bad


def span_rows(lines, entity_key="entity.id"):
    """One row per span or per problem of a traces capture."""
    top = _parse(lines, SPANS)
    bad = top.where("problem IS NOT NULL").select("file", "problem")
    res = top.where("problem IS NULL").select("file", F.explode("r.resourceSpans").alias("res"))
    s = res.select("file", F.explode("res.scopeSpans").alias("s")).select("file", F.explode("s.spans").alias("p"))
    start, end = F.col("p.startTimeUnixNano").try_cast("bigint"), F.col("p.endTimeUnixNano").try_cast("bigint")
    reason = F.when(
        ~F.coalesce((start >= 0) & (end >= start), F.lit(False)), "span times are missing or out of order"
    )
    s = s.withColumn("problem", _first_problem(reason, attribute_problem(F.col("p.attributes"))))
    bad = bad.unionByName(s.where("problem IS NOT NULL").select("file", "problem"))
    entity = F.element_at(F.map_from_entries(F.transform(
        F.coalesce("p.attributes", F.array().cast(KV)), lambda e: F.struct(e["key"], e["value"]["stringValue"])
    )), entity_key)
    good = s.where("problem IS NULL").select(
        "file", F.coalesce("p.traceId", F.lit("")).alias("trace"), F.coalesce("p.spanId", F.lit("")).alias("span"),
        F.nullif(F.col("p.parentSpanId"), F.lit("")).alias("parent"),
        F.coalesce("p.name", F.lit("")).alias("name"), F.coalesce(entity, F.lit("")).alias("entity"),
        F.coalesce("p.status.code", F.lit(0)).alias("status"), start.alias("start"), end.alias("end"),
    )
    return good, bad


def require_clean(rows, quarantine):
    """Strict mode: any quarantined row fails the job with its place and reason."""
    place = F.concat_ws(": ", "file", "problem")
    checked = quarantine.select(F.raise_error(place).cast("boolean").alias("_x")).groupBy().agg(
        F.count("_x").alias("_bad")
    )
    return rows.crossJoin(F.broadcast(checked)).where("_bad = 0").drop("_bad")


def case_of(file, pattern=r"/([^/]+)/[^/]+$"):
    """Case id of a capture file: the folder it lies in."""
    return F.regexp_extract(file, pattern, 1)


def join_manifests(cases, manifests, key="case_id"):
    """Captured cases beside declared ones, with what is missing or extra."""
    a = cases.select(key).distinct().withColumn("_c", F.lit(True))
    both = manifests.join(a, key, "full_outer")
    status = F.when(F.col("_c").isNull(), "capture missing").when(
        F.col("_declared").isNull(), "not declared"
    ).otherwise("matched")
    return both.withColumn("status", status).drop("_c", "_declared")
