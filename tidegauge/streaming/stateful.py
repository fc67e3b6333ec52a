"""Per-key state on streams: counter rates with resets, and latched CUSUM alerts.

Rows of a key are sorted by time inside a micro-batch; points older than the
watermark are dropped before they reach the state. State is a few numbers per key
and expires after ``ttl_ms`` without input.
"""

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ordered(rows, *columns):
    """Arrays of a key's columns by time and sequence number, missing times last, in the order of arrival where both are equal.

    A key has few rows in a batch: its cost is that of the calls, so the frame is neither joined nor sorted as a frame.
    """
    frames = list(rows)
    pdf = frames[0] if len(frames) == 1 else pd.concat(frames)
    by = np.lexsort((pdf["seq"].to_numpy(), pdf["t"].to_numpy()))
    return [pdf[c].to_numpy()[by] for c in columns]


def filled(values):
    """Whole numbers, zero for missing ones."""
    return np.where(pd.isna(values), 0, values).astype(np.int64)


class CounterRate(StatefulProcessor):
    """Rate and reset of a cumulative counter against the last valid point.

    State: start time of the last point (flagged or not), and time and total of the
    last valid point of the running segment.
    """

    def __init__(self, ttl_ms=None):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.state = handle.getValueState(
            "last", "start_t bigint, t bigint, total bigint", ttlDurationMs=self.ttl_ms
        )

    def handleInputRows(self, key, rows, timerValues):
        starts, times, totals, flags, seq = ordered(rows, "start_t", "t", "total", "flags", "seq")
        start, t, total = self.state.get() or (None, None, None)
        starts, totals, times, n = filled(starts), filled(totals), times.astype(np.int64), len(seq)
        changed = starts != np.concatenate(([starts[0] if start is None else start], starts[:-1]))
        segment = np.cumsum(changed)
        valid = (flags.astype(np.int64) & 1) == 0
        # The last valid row before each row; -1 is the one that the state holds.
        at = np.where(valid, np.arange(n), -1)
        before = np.concatenate(([-1], np.maximum.accumulate(at)[:-1]))
        held = total is not None
        last_t, last_total = np.where(before >= 0, times[before], t if held else 0), np.where(before >= 0, totals[before], total if held else 0)
        same = valid & np.where(before >= 0, segment[before] == segment, held & (segment == 0))
        dropped = same & (totals < last_total)
        rate = np.full(n, np.nan)
        ok = same & ~dropped
        rate[ok] = (totals[ok] - last_total[ok]) / ((times[ok] - last_t[ok]) / 1e9)
        newest = int(at.max())
        if newest >= 0 and segment[newest] == segment[-1]:
            t, total = int(times[newest]), int(totals[newest])
        elif segment[-1] > 0:
            t = total = None
        self.state.update((int(starts[-1]), t, total))
        yield pd.DataFrame({"run": key[0], "seq": seq.astype(np.int64), "rate": rate, "reset": changed | dropped})

    def close(self):
        pass


class LatchedCusum(StatefulProcessor):
    """Resettable evidence per run, with one alert at the first crossing."""

    def __init__(self, threshold, ttl_ms=None):
        self.threshold = threshold
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.state = handle.getValueState("s", "s double, alerted boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        increments, seq = ordered(rows, "increment", "seq")
        s, alerted = self.state.get() or (0.0, False)
        # Reset at zero: the running sum less its lowest value so far, as far as that is below zero.
        total = s + np.cumsum(increments.astype(float))
        cusum = total - np.minimum(0.0, np.minimum.accumulate(total))
        over = np.flatnonzero(cusum > self.threshold)
        alert = np.zeros(len(seq), dtype=bool)
        if len(over) and not alerted:
            alert[over[0]] = True
        self.state.update((float(cusum[-1]), bool(alerted or len(over))))
        yield pd.DataFrame({"run": key[0], "seq": seq.astype(np.int64), "cusum": cusum, "alert": alert})

    def close(self):
        pass


def counter_rates(points, ttl_ms=None):
    """``points``: run, t, seq, start_t, flags, total. One row per point."""
    return points.groupBy("run").transformWithStateInPandas(
        statefulProcessor=CounterRate(ttl_ms), outputStructType="run bigint, seq bigint, rate double, reset boolean",
        outputMode="append", timeMode="processingTime" if ttl_ms else "none",
    )


def latched_cusum(points, threshold, ttl_ms=None):
    """``points``: run, t, seq, increment."""
    return points.groupBy("run").transformWithStateInPandas(
        statefulProcessor=LatchedCusum(threshold, ttl_ms),
        outputStructType="run bigint, seq bigint, cusum double, alert boolean",
        outputMode="append", timeMode="processingTime" if ttl_ms else "none",
    )
