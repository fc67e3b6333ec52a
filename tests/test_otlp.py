"""OTLP readers and window compile against worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import compile as windows_compile
from tidegauge.operators import windows
from tidegauge.sources import otlp

SECOND = 1_000_000_000


def num(t, start=None, flags=None, **value):
    p = {"timeUnixNano": str(t), **value}
    if start is not None:
        p["startTimeUnixNano"] = str(start)
    if flags is not None:
        p["flags"] = flags
    return p


def hist(t, start, count, total):
    return {"startTimeUnixNano": str(start), "timeUnixNano": str(t), "count": str(count), "sum": total}


def request(*metrics):
    return {"resourceMetrics": [{
        "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]},
        "scopeMetrics": [{"scope": {"name": "s", "version": "1"}, "metrics": list(metrics)}],
    }]}


PERIOD = 2 * SECOND
CAPTURE = request(
    {"name": "queue.depth", "unit": "1", "gauge": {"dataPoints": [
        num(SECOND, asInt="12"), num(2 * SECOND, asInt="7"), num(5 * SECOND, asInt="3"),
        num(6 * SECOND, flags=1, asInt="50"), num(10 * SECOND, asInt="8")]}},
    {"name": "sent", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [
        num(t * SECOND, start * SECOND, asInt=total) for t, start, total in ((2, 0, "100"), (4, 0, "160"), (6, 0, "160"), (8, 7, "20"), (10, 7, "50"))]}},
    {"name": "drops", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [
        num(2 * SECOND, 0, asInt="4"), num(6 * SECOND, 4 * SECOND, asInt=1)]}},
    {"name": "batch", "histogram": {"aggregationTemporality": 1, "dataPoints": [
        hist(4 * SECOND, 2 * SECOND, 8, 36.0), hist(10 * SECOND, 8 * SECOND, 2, 11.0)]}},
    {"name": "wait", "histogram": {"aggregationTemporality": 2, "dataPoints": [
        hist(2 * SECOND, 0, 4, 10.0), hist(4 * SECOND, 0, 9, 40.0), hist(8 * SECOND, 7 * SECOND, 3, 9.0), hist(10 * SECOND, 7 * SECOND, 5, 15.0)]}},
)
SPEC = [
    {"name": "depth", "metric_name": "queue.depth", "statistic": "gauge_last",
     "resource": {"service.name": '"shop"'}},
    {"name": "sent_rate", "metric_name": "sent", "statistic": "sum_rate"},
    {"name": "drop_rate", "metric_name": "drops", "statistic": "sum_rate"},
    {"name": "batch_mean", "metric_name": "batch", "statistic": "histogram_mean"},
    {"name": "batches_rate", "metric_name": "batch", "statistic": "histogram_count_rate"},
    {"name": "wait_mean", "metric_name": "wait", "statistic": "histogram_mean"},
]
WANT = {
    2: [7.0, None, 2.0, None, None, None],
    4: [None, 30.0, None, 4.5, 4.0, 6.0],
    6: [3.0, 0.0, 0.5, None, None, None],
    8: [None, None, None, None, None, None],
    10: [8.0, 15.0, None, 5.5, 1.0, 3.0],
}


def write(tmp_path, *lines):
    f = tmp_path / "capture.jsonl"
    f.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(f)


@pytest.fixture(scope="module")
def compiled(spark, tmp_path_factory):
    path = write(tmp_path_factory.mktemp("otlp"), CAPTURE)
    good, bad = otlp.metric_rows(otlp.read_lines(spark, path))
    assert bad.count() == 0
    points = good.withColumn("run", F.lit(1)).cache()
    return points, windows_compile.compile_windows(points, SPEC, PERIOD).cache()


def test_compiled_windows(compiled):
    points, table = compiled
    got = {(r.window_end // SECOND, r.feature): r for r in table.collect()}
    assert len(got) == 30
    for w, row in WANT.items():
        for f, value in zip(SPEC, row):
            assert got[w, f["name"]].value == value
    assert {k for k, r in got.items() if r.reset} == {(8, "sent_rate"), (8, "wait_mean")}
    q = windows_compile.quality(table, points).first()
    assert (q.flagged_points, q.reset_points, q.missing_cells) == (1, 2, 16)


def test_unmatched_and_shared(spark, compiled):
    points, _ = compiled
    extra = [*SPEC, {"name": "nothing", "metric_name": "absent", "statistic": "gauge_last"}]
    matched = windows_compile.match_features(points, extra)
    assert [r.feature for r in windows_compile.unmatched_features(matched, extra, spark).collect()] == ["nothing"]
    assert windows_compile.shared_streams(matched).count() == 0


def test_bounded_fill(compiled):
    _, table = compiled
    depth = table.where("feature = 'depth'")
    rows = windows.forward_fill(depth, ["run", "feature"], 1, "reset").orderBy("window_end").collect()
    assert [r.filled for r in rows] == [7.0, 7.0, 3.0, 3.0, 8.0]
    assert [r.imputed for r in rows] == [False, True, False, True, False]
    none = windows.forward_fill(depth, ["run", "feature"], 0, "reset").orderBy("window_end").collect()
    assert [r.violation for r in none] == [False, True, False, True, False]


def test_close_totals_beyond_double_precision(spark, tmp_path):
    """Totals near 2^60 differ by three, which doubles cannot tell apart."""
    total = 2**60 + 1
    points = [num(2 * SECOND, 0, asInt=str(total)), num(4 * SECOND, 0, asInt=str(total + 3))]
    path = write(tmp_path, request({"name": "n", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": points}}))
    good, _ = otlp.metric_rows(otlp.read_lines(spark, path))
    spec = [{"name": "n_rate", "metric_name": "n", "statistic": "sum_rate"}]
    out = windows_compile.compile_windows(good.withColumn("run", F.lit(1)), spec, PERIOD)
    assert [r.value for r in out.where("observed").collect()] == [1.5]


def test_malformed_rows_are_located(spark, tmp_path):
    point = {"dataPoints": [num(SECOND, asDouble=1.0)]}
    path = write(
        tmp_path, "{broken", "[1, 2]", request({"name": "", "gauge": point}),
        request({"name": "a"}), request({"name": "b", "gauge": point, "sum": point}),
        request({"name": "c", "summary": {"dataPoints": []}}),
        request({"name": "d", "gauge": {"dataPoints": [num(SECOND)]}}),
        request({"name": "e", "gauge": {"dataPoints": [num(SECOND, flags=1)]}}),
        request({"name": "f", "gauge": {"dataPoints": [num(SECOND, asInt="1", asDouble=1.0)]}}),
        request({"name": "g", "gauge": {"dataPoints": [{**num(SECOND, asDouble=1.0), "attributes": [
            {"key": "k", "value": {"stringValue": "a"}}, {"key": "k", "value": {"stringValue": "b"}}]}]}}),
    )
    good, bad = otlp.metric_rows(otlp.read_lines(spark, path))
    assert [r.metric_name for r in good.collect()] == ["e"]
    assert sorted(r.problem for r in bad.collect()) == sorted([
        "not a readable JSON object", "not a readable JSON object", "metric name is empty",
        "metric kind is missing", "more than one metric kind", "metric kind is not supported",
        "number point must have exactly one value", "number point must have exactly one value",
        "duplicate attribute key",
    ])
    with pytest.raises(Exception, match="capture.jsonl"):
        otlp.require_clean(good, bad).collect()


def test_log_and_span_rows(spark, tmp_path):
    record = {
        "timeUnixNano": "200", "severityNumber": 17, "body": {"stringValue": "failed 3"},
        "attributes": [{"key": "event.name", "value": {"stringValue": "fail"}},
                       {"key": "window", "value": {"intValue": "1"}},
                       {"key": "nested", "value": {"arrayValue": {"values": [{"intValue": "2"}]}}}],
        "traceId": "ab", "droppedAttributesCount": 2,
    }
    path = write(tmp_path, {"resourceLogs": [{"schemaUrl": "u", "resource": {}, "scopeLogs": [
        {"scope": {"name": "s"}, "logRecords": [record, {"timeUnixNano": "300"}]}]}]})
    good, bad = otlp.log_rows(otlp.read_lines(spark, path))
    rows = good.orderBy("t").collect()
    assert bad.count() == 0
    assert (rows[0].severity, rows[0].body, rows[0].trace_id, rows[0].dropped_attributes) == (17, "failed 3", "ab", 2)
    assert rows[0].attributes["window"] == "1" and rows[0].attributes["event.name"] == '"fail"'
    assert rows[0].attributes["nested"] == '{"values":[{"intValue":"2"}]}'
    assert (rows[1].severity, rows[1].body, rows[1].resource_schema_url) == (0, None, "u")
    spans = tmp_path / "spans"
    spans.mkdir()
    path = write(spans, {"resourceSpans": [{"scopeSpans": [{"spans": [
        {"traceId": "t", "spanId": "a", "name": "n", "startTimeUnixNano": "1", "endTimeUnixNano": "5",
         "attributes": [{"key": "entity.id", "value": {"stringValue": "api"}}]},
        {"traceId": "t", "spanId": "b", "parentSpanId": "a", "startTimeUnixNano": "9", "endTimeUnixNano": "5"},
    ]}]}]})
    good, bad = otlp.span_rows(otlp.read_lines(spark, path))
    r = good.first()
    assert (r.span, r.parent, r.entity, r.status, r.start, r.end) == ("a", None, "api", 0, 1, 5)
    assert bad.count() == 1


def test_a_metric_line_is_read_once_for_points_and_problems(spark, tmp_path):
    point = '{"timeUnixNano":"1","asDouble":2.0}'
    line = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"a","gauge":{"dataPoints":[%s,{"asDouble":1.0}]}},{"name":"","gauge":{"dataPoints":[%s]}}]}]}]}' % (point, point)
    path = str(tmp_path / "lines")
    spark.createDataFrame([(line,), ("broken",), ('{"resourceMetrics":[]}',)], "value string").write.text(path)
    found = otlp.metric_table(otlp.read_lines(spark, path)).groupBy("problem").count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.problem: r["count"] for r in found.collect()} == {
        None: 1, "point time is missing or not a whole number": 1, "metric name is empty": 1, "not a readable JSON object": 1,
    }
