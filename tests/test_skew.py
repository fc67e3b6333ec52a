"""Split scans must equal the plain window, with one key holding a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidegauge.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1200
    data = [
        (1 if i % 3 == 0 else int(rng.integers(2, 30)), int(t), i,
         float(np.round(rng.normal(), 3)), None if rng.random() < 0.5 else float(i))
        for i, t in enumerate(rng.integers(0, 700, n))
    ]
    return spark.createDataFrame(data, "k long, t long, seq long, x double, g double").cache()


@pytest.mark.parametrize("keys", [["k"], []])
def test_scans_equal_plain_window(rows, keys):
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    by, order = F.col("t"), ["t", "seq"]
    want = {
        (r.k, r.seq): r
        for r in rows.select(
            "k", "seq", F.sum("x").over(upto).alias("s"), F.lag("x").over(w).alias("p"),
            F.last("g", True).over(upto).alias("g"), F.row_number().over(w).alias("rn"),
        ).collect()
    }
    plan = skew.plan_split(rows, keys, by, limit=50)
    assert plan.split
    got = skew.running_sum(rows, keys, order, by, {"s": F.col("x")}, limit=50)
    got = skew.previous(got, keys, order, by, {"p": F.col("x")}, limit=50)
    got = skew.last_known(got, keys, order, by, {"lg": F.col("g")}, limit=50)
    got = skew.running_count(got, keys, order, by, limit=50).collect()
    assert len(got) == len(want)
    for r in got:
        ref = want[(r.k, r.seq)]
        assert r.s == pytest.approx(ref.s, abs=1e-9)
        assert (r.p, r.lg, r.rn) == (ref.p, ref.g, ref.rn)


@pytest.mark.parametrize("limit", [50, 10_000])
def test_cusum_equals_recurrence(rows, limit):
    got = skew.resettable_cusum(rows, ["k"], ["t", "seq"], F.col("t"), F.col("x"), limit=limit)
    state = {}
    for r in sorted(got.collect(), key=lambda r: (r.t, r.seq)):
        state[r.k] = max(0.0, state.get(r.k, 0.0) + r.x)
        assert r.cusum == pytest.approx(state[r.k], abs=1e-9)


@pytest.mark.parametrize("limit", [50, 10_000])
def test_exact_quantiles(rows, limit):
    got = skew.exact_quantiles(rows, ["k"], "x", {"m": 0.5, "p": 0.95}, limit).collect()
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, []).append(r.x)
    assert len(got) == len(by_key)
    for r in got:
        assert r.m == pytest.approx(np.quantile(by_key[r.k], 0.5))
        assert r.p == pytest.approx(np.quantile(by_key[r.k], 0.95))


def test_cusum_worked_example(spark):
    df = spark.createDataFrame(
        [(i, x) for i, x in enumerate([4.0, -1.5, -7.0, 0.5, 2.0, -1.0])], "i int, x double"
    )
    out = skew.resettable_cusum(df, [], ["i"], F.col("i"), F.col("x"), limit=2).orderBy("i")
    assert [r.cusum for r in out.collect()] == [4, 2.5, 0, 0.5, 2.5, 1.5]
