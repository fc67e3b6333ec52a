"""Streams must give what the batch forms give, and keep state between micro-batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import counters
from tidegauge.streaming import stateful, windows
from tidegauge.streaming.run import drain


def stream_of(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counter_rates_equal_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "run bigint, t bigint, seq bigint, start_t bigint, flags bigint, total bigint"
    s = 1_000_000_000
    batches = [
        [(1, 1 * s, 1, 0, 0, 40), (1, 2 * s, 2, 0, 0, 52), (2, 1 * s, 3, None, 0, 5)],
        [(1, 4 * s, 5, 9, 0, 13), (1, 3 * s, 4, 9, 0, 6), (2, 2 * s, 6, 0, 0, 3)],
        [(1, 5 * s, 7, 9, 1, 0), (1, 6 * s, 8, 9, 0, 19), (2, 3 * s, 9, 0, 0, 6)],
    ]
    got, _ = drain(stateful.counter_rates(stream_of(spark, str(tmp_path / "in"), schema, batches)))
    batch = counters.cumulative_intervals(
        spark.createDataFrame([r for b in batches for r in b], schema), ["run"], ["total"], ["total"]
    )
    want = batch.select(
        "run", "seq", (F.col("d_total") / ((F.col("t") - F.col("prev_t")) / 1e9)).alias("rate"), "reset"
    )
    key = lambda r: (r.run, r.seq)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    rates = {key(r): r.rate for r in got.collect()}
    assert rates[1, 2] == 12.0 and rates[1, 5] == 7.0 and rates[1, 8] == 3.0 and rates[2, 9] == 3.0
    assert {key(r) for r in got.collect() if r.reset} == {(1, 4), (2, 6)}


def test_latched_cusum_alerts_once(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "run bigint, t bigint, seq bigint, increment double"
    x = [1.5, 2.0, -5.0, 3.0, -1.0, 4.5, -20.0, 6.0]
    rows = [(1, i, i, v) for i, v in enumerate(x)]
    got, _ = drain(stateful.latched_cusum(
        stream_of(spark, str(tmp_path / "in"), schema, [rows[:3], rows[3:6], rows[6:]]), 4.0
    ))
    got = sorted(got.collect(), key=lambda r: r.seq)
    assert [r.cusum for r in got] == [1.5, 3.5, 0, 3, 2, 6.5, 0, 6]
    assert [r.seq for r in got if r.alert] == [5]


def test_windows_are_right_closed_and_drop_late_rows(spark, tmp_path):
    schema = "run bigint, t bigint, seq bigint, value double"
    s = 1_000_000_000
    batches = [
        [(1, s, 0, 1.0), (1, s + 1, 1, 2.0), (1, 2 * s, 2, 3.0)],
        [(1, 9 * s, 3, 4.0), (1, 2 * s - 5, 4, 9.0)],
        [(1, 20 * s, 6, 5.0)],
        [(1, s, 5, 7.0)],
    ]
    out, query = drain(windows.last_in_window(
        stream_of(spark, str(tmp_path / "in"), schema, batches), ["run"], s, "2 seconds"
    ))
    got = {r.window_end // s: (r.value, r.n) for r in out.collect()}
    assert got == {1: (1.0, 1), 2: (3.0, 3), 9: (4.0, 1)}
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
    assert dropped == 1


def test_templates_update_mode(spark, tmp_path):
    batches = [[("node joined after 3 tries",), ("cache warmed",)], [("node joined after 8 tries",)]]
    s = stream_of(spark, str(tmp_path / "in"), "body string", batches)
    out, _ = drain(windows.template_counts(s, "body"), "update", ["template"])
    assert {r.template: r.n for r in out.collect()} == {"node joined after <*> tries": 2, "cache warmed": 1}


def test_trace_sessions_close_after_a_quiet_gap(spark, tmp_path):
    s = 1_000_000_000
    schema = "trace bigint, `end` bigint, parent string"
    batches = [[(1, s, None), (1, 2 * s, "a"), (2, s, None)], [(2, 4 * s, "a"), (3, 100 * s, None)], [(3, 200 * s, "x")]]
    out, _ = drain(windows.closed_traces(
        stream_of(spark, str(tmp_path / "in"), schema, batches), "5 seconds", "10 seconds"
    ))
    got = {r.trace: (r.spans, r.roots, r.last_end // s) for r in out.collect()}
    assert got[1] == (2, 1, 2) and got[2] == (2, 1, 4)


def test_a_finished_input_leaves_no_window_or_session_open(spark, tmp_path):
    from tidegauge.plans import streams
    from tidegauge.plans.views import Tables

    rows = [(k, f"2024-01-{1 + k // 4:02d} {6 * (k % 4):02d}:00:01", k % 3, "view", float(k), "{}") for k in range(40)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    got = streams.all_streaming_windows(t).collect()
    assert sum(r.n for r in got) == 40 and max(r.value for r in got) == 39.0 and all(r.run is not None for r in got)
    assert sorted(streams.streaming_windows(t).collect()) == sorted(got)
    late = streams.streaming_late_rows(t).first()
    assert (late.windows, late.points, late.late_rows) == (len(got), 40, 4)
    sessions = streams.all_streaming_sessions(t).collect()
    assert sum(r.spans for r in sessions) == 40 and all(r.trace is not None for r in sessions)
    whole = streams.streaming_sessions(t).collect()
    assert sorted((r.trace, r.spans, r.last_end) for r in whole) == sorted((r.trace, r.spans, r.last_end) for r in sessions)


def test_session_paths_need_one_root_and_parents_inside(spark, tmp_path):
    s = 1_000_000_000
    schema = "trace bigint, `end` bigint, span string, parent string"
    rows = [(1, s, "a", None), (1, 2 * s, "b", "a"), (2, s, "a", None), (2, s, "b", "x"), (3, s, "a", None), (3, s, "b", None), (4, s, "a", "b")]
    stream = stream_of(spark, str(tmp_path / "in"), schema, [rows, [(9, 900 * s, "z", None)]])
    out, _ = drain(windows.closed_traces(stream, "10 seconds", "1 second", paths=True))
    assert {r.trace: r.valid_path for r in out.collect()} == {1: True, 2: False, 3: False, 4: False}


class _Held:
    """A value state that counts its calls; each is a round trip to the engine."""

    def __init__(self):
        self.value, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


@pytest.mark.parametrize("kind", ["cusum", "rate"])
def test_a_key_costs_two_state_calls_a_batch_and_missing_times_come_last(kind):
    processor = stateful.LatchedCusum(30.0) if kind == "cusum" else stateful.CounterRate()
    processor.state = _Held()
    columns = ["t", "seq", "increment", "start_t", "flags", "total"]
    first = pd.DataFrame([(3e9, 4, 5.0, 0, 0, 9.0), (None, 2, -50.0, 0, 1, 9.0), (1e9, 3, 20.0, 0, 0, 4.0)], columns=columns)
    second = pd.DataFrame([(3e9, 1, 10.0, 0, 0, 6.0)], columns=columns)
    out = [pd.concat(processor.handleInputRows((7,), iter(frames), None)) for frames in ([first, second], [second])]
    assert processor.state.calls == ["get", "update"] * 2
    assert [o["seq"].tolist() for o in out] == [[3, 1, 4, 2], [1]]
    if kind == "cusum":
        assert [o["cusum"].tolist() for o in out] == [[20.0, 30.0, 35.0, 0.0], [10.0]]
        assert [o["alert"].tolist() for o in out] == [[False, False, True, False], [False]]
    else:
        assert np.isnan(out[0]["rate"][0]) and out[0]["rate"][1] == 1.0 and out[0]["reset"].tolist() == [False] * 4
