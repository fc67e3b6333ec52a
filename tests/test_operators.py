"""Worked examples and invariants of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import numbers, text
from tidegauge.functions.attributes import numeric_attribute
from tidegauge.operators import (
    alerts, calibration, design, events, features, frames, graph, linear, logs, retrieval, sketch,
    traces, windows,
)


def one(df):
    return df.first()[0]


def test_normalized_body(spark):
    bodies = [
        "Volume 8 attached to 0f8fad5b-d9cb-469f-a165-70867728950e via 0xCAFE01 after  12.25 ms",
        "volume 31 attached to 7c9e6679-7425-40de-944b-e07fc1f90ae7 via beefcafe77 after\t3 ms ",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = {r[0] for r in df.select(text.normalize_body(F.col("b"))).collect()}
    assert got == {"volume <num> attached to <uuid> via <hex> after <num> ms"}


def test_template_masks_and_counts(spark):
    lines = ["node joined after 12 tries", "node joined after 7 tries", "cache warmed", "peer 10.2.0.9 gone7"]
    df = spark.createDataFrame([(x,) for x in lines], "b string")
    got = {r.template: (r.n, r.payload_bytes) for r in events.log_templates(df, "b").collect()}
    assert got == {"node joined after <*> tries": (2, 35), "cache warmed": (1, 20), "peer <*> gone7": (1, 22)}


@pytest.mark.parametrize("limit", [3, 1000])
def test_vocabulary_is_sorted_and_unknown_is_zero(spark, limit):
    words = ["b", "a", "élan", "zz", "a", "ab", "日本", "Z"]
    v = events.fit_vocabulary(spark.createDataFrame([(w,) for w in words], "template string"), limit=limit)
    got = {r.template: r.template_id for r in v.collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    coded = events.encode(spark.createDataFrame([("a",), ("new",)], "template string"), v)
    assert {r.template: r.template_id for r in coded.collect()} == {"a": got["a"], "new": 0}


def test_numeric_attribute_rejects_booleans(spark):
    df = spark.createDataFrame([('{"a": 3}',), ('{"a": true}',), ('{"a": "3"}',), ("{}",), ('{"a": 2.5}',)], "j string")
    got = [r[0] for r in df.select(numeric_attribute(F.col("j"), "$.a")).collect()]
    assert got == [3.0, None, None, None, 2.5]


def test_conformal_and_higher_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(30)], "m double")
    assert one(alerts.conformal_threshold(df, "m", 0.05)) == 29.0
    assert one(alerts.conformal_threshold(df.limit(5), "m", 0.05)) == float("inf")
    for q in (0.5, 0.9, 0.95, 0.99):
        assert one(alerts.higher_quantile(df, "m", q)) == np.quantile(np.arange(30.0), q, method="higher")


def test_survival_cdf(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3],), ([0.8, 0.01, 0.02],)], "h array<double>")
    got = [r[0] for r in df.select(calibration.survival_cdf(F.col("h"))).collect()]
    assert np.allclose(got, [[0.1, 0.28, 0.496], [0.8, 0.802, 0.80596]])


def test_schedule_period(spark):
    df = spark.createDataFrame([([5, 7, 5, 7],), ([1, 2, 3],), ([4, 4, 4],), ([1, 2, 1],)], "s array<int>")
    got = [r[0] for r in df.select(frames.shortest_period(F.col("s"))).collect()]
    assert got == [[5, 7], [1, 2, 3], [4], [1, 2]]


def test_counter_window_worked_example(spark):
    """A fifth of a second with six workers; then all counters fall back."""
    zero = {n: 0 for n in features.COUNTERS}
    after = zero | {"api_requests": 24, "api_latency_us": 60_000, "api_errors": 3, "api_busy_us": 300_000, "worker_busy_us": 240_000, "database_rows": 9}
    rows = [(1, 0, *zero.values()), (1, 1, *[after[n] for n in features.COUNTERS]), (1, 2, *zero.values())]
    df = spark.createDataFrame(rows, "run int, t int, " + ", ".join(f"{n} bigint" for n in features.COUNTERS))
    a, b = features.counter_window(df, "run", "t", 0.2, 6).orderBy("t").collect()
    assert a.request_rate == pytest.approx(120) and a.request_latency_ms == pytest.approx(2.5)
    assert a.error_rate == pytest.approx(0.125) and a.api_concurrency_mean == pytest.approx(1.5)
    assert a.worker_busy_fraction == pytest.approx(0.2) and a.db_write_rate == pytest.approx(45)
    assert a.monotonic and not b.monotonic and a.redis_enqueue_latency_ms == 0.0


def test_log_windows_by_index_and_time(spark):
    df = spark.createDataFrame([("0",), ("2",), ("3",), ("x",), (None,)], "w string")
    rows = windows.assign_index(df, "w", 3).collect()
    assert [r.window for r in rows] == [0, 2, None, None, None]
    assert [r.violation for r in rows] == [False, False, True, True, True]
    b = spark.createDataFrame(
        [(1, 0, "start"), (1, 200, "window"), (1, 400, "window"), (1, 600, "window"), (1, 700, "drain")],
        "run int, t bigint, role string",
    )
    t = spark.createDataFrame([(1, x) for x in (-1, 0, 200, 201, 400, 600, 601, 700, 701)], "run int, t bigint")
    got = {r.t: (r.status, r.window) for r in windows.place_by_boundaries(t, b).collect()}
    assert got == {
        -1: ("outside", None), 0: ("placed", 0), 200: ("placed", 0), 201: ("placed", 1), 400: ("placed", 1),
        600: ("placed", 2), 601: ("drain", None), 700: ("drain", None), 701: ("outside", None),
    }


def test_unsafe_log_features_are_refused(spark):
    with pytest.raises(ValueError, match="unsafe"):
        logs.feature_spec(spark, [("a", {"body": "x"}, None)])
    with pytest.raises(ValueError, match="needs"):
        logs.feature_spec(spark, [("a", {}, None)])
    with pytest.raises(ValueError, match="severity"):
        logs.feature_spec(spark, [("a", {}, 25)])


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(w)) for k, w in zip(rng.zipf(1.3, 3000) % 400, rng.random(3000))]
    df = spark.createDataFrame(rows, "k bigint, w double")
    r = sketch.error_report(df, "k", "w", width=64, depth=3, seed=2).collect()
    assert len(r) == len({k for k, _ in rows})
    assert all(x.excess >= -1e-9 for x in r) and any(x.excess > 0 for x in r)


def test_leaks_at_any_depth(spark):
    payloads = [
        '{"a":{"b":["x","secret"]}}', '{"a":"not secret here"}', '{"Fault_kind":1}', '{"a":"fault"}',
        '{"a":"say \\"fault\\": 1"}', '{"a":["ok",{"deep":{"ground_truth_x":null}}]}', '{"a":"x, \\"secret\\" y"}',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = {r.i for r in design.leaks(df, "p", ["fault", "ground_truth"], ["secret"]).collect()}
    assert got == {0, 2, 5}
    long = spark.createDataFrame([(1, '{"a":"' + 'line \\n "q\\" '.replace('"q', "'q") * 20_000 + '","b":"secret"}')], "i int, p string")
    assert design.leaks(long, "p", ["fault"], ["secret"]).count() == 1


def test_span_trees(spark):
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "b"), (2, "x", "gone"), (2, "y", "x"), (3, "r", None), (3, "r", None)]
    rows += [(4, f"s{i:02d}", f"s{i - 1:02d}" if i else None) for i in range(14)]
    spans = spark.createDataFrame(rows, "trace int, span string, parent string")
    s = {r.trace: (r.spans, r.repeated, r.missing_parents, r.valid) for r in traces.structure(spans).collect()}
    assert s == {1: (3, 0, 0, True), 2: (2, 0, 1, False), 3: (2, 1, 0, False), 4: (14, 0, 0, True)}
    d = {(r.trace, r.span): r.depth for r in traces.depths(spans.where("trace <> 3")).collect()}
    assert [d[1, x] for x in "abc"] == [0, 1, 2] and (d[2, "x"], d[2, "y"]) == (0, 1)
    assert [d[4, f"s{i:02d}"] for i in range(14)] == list(range(14))
    deep = [(5, f"d{i}", f"d{i - 1}" if i else None) for i in range(70)] + [(6, "p", "q"), (6, "q", "p"), (6, "r", "q"), (6, "top", None)]
    got = {(r.trace, r.span): r.depth for r in traces.depths(spark.createDataFrame(deep, "trace int, span string, parent string")).collect()}
    assert [got[5, f"d{i}"] for i in range(70)] == list(range(70))
    assert [got[6, x] for x in ("p", "q", "r", "top")] == [None, None, None, 0]


def test_exact_paths(spark):
    def path(trace, *spans):
        return [(trace, *s) for s in spans]

    good = [("p", "a", None, 1, 9), ("q", "b", "a", 2, 5), ("r", "c", "b", 2, 3)]
    rows = path(1, *good) + path(2, *good[:2]) + path(3, *good, ("q", "z", "a", 3, 4))
    rows += path(4, good[0], ("q", "b", "x", 2, 5), good[2]) + path(5, good[0], good[1], ("r", "c", "b", 1, 3))
    rows += path(6, *good, ("other", "o", "a", 1, 2)) + path(7, good[0], good[1], ("r", "c", "b", 4, 3))
    spans = spark.createDataFrame(rows, "trace int, name string, span string, parent string, start bigint, `end` bigint")
    got = {r.trace: r.exact for r in traces.exact_path(spans, ["p", "q", "r"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}


def test_reachability_settles_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {(r.source, r.target) for r in graph.reachable(e).collect()}
    assert got == {(s, t) for s in "abc" for t in "abcd"}


def test_exact_sign_flip_against_enumeration(spark):
    import itertools

    d = [-0.4, 0.1, -0.9, -0.2, 0.3]
    df = spark.createDataFrame([(x,) for x in d], "d double")
    r = calibration.exact_sign_flip(df, "d").first()
    sums = [sum(s * x for s, x in zip(signs, d)) for signs in itertools.product((1, -1), repeat=5)]
    assert (r.patterns, r.as_extreme) == (32, sum(s <= sum(d) + 1e-9 for s in sums))
    with pytest.raises(ValueError, match="no pair"):
        calibration.exact_sign_flip(df.limit(0), "d")


def test_sign_flip_beyond_enumeration(spark):
    """Thirty pairs of one size: the number of negative signs is binomial."""
    from math import comb

    df = spark.createDataFrame([(-0.5,)] * 19 + [(0.5,)] * 11, "d double")
    r = calibration.exact_sign_flip(df, "d").first()
    want = sum(comb(30, j) for j in range(19, 31))
    assert (r.patterns, r.as_extreme) == (1 << 30, want) and r.p_value == pytest.approx(want / (1 << 30), rel=1e-12)


def test_gaps_of_a_long_trace(spark):
    from tidegauge.operators import sequences

    spans = spark.createDataFrame([(1, i, i * 10_000_000, i * 10_000_000 + 4_000_000) for i in range(50)], "trace int, span int, start bigint, `end` bigint")
    rows = sorted(sequences.span_gaps(spans, "trace").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 51))
    assert [r.gap_from_previous_ms for r in rows] == [0.0] + [6.0] * 49
    assert [r.time_to_next_ms for r in rows] == [6.0] * 49 + [0.0]


def test_binomial_tail_of_many_trials(spark):
    cases = [(200_000, 1e6, 0.2), (199_000, 1e6, 0.2), (201_500, 1e6, 0.2), (1000, 5000.0, 0.2), (5000, 5000.0, 0.2), (0, 5000.0, 0.2), (7, 40.0, 0.2)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k bigint, n double, p double")
    got = [r[0] for r in df.orderBy("i").select(numbers.binomial_lower_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]

    def exact(k, n, p):
        import math

        j = np.arange(0, k + 1)
        terms = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p) for x in j[-60_000:]]
        return math.fsum(map(math.exp, terms))

    assert np.allclose(got, [exact(*c) for c in cases], rtol=1e-7, atol=1e-12)


def test_binomial_tail_and_hit(spark):
    from math import comb

    df = spark.createDataFrame([(2, 10.0), (0, 5.0), (5, 5.0)], "k int, n double")
    got = [r[0] for r in df.select(numbers.binomial_lower_tail(F.col("k"), F.col("n"), F.lit(0.15))).collect()]
    want = [sum(comb(int(n), j) * 0.15**j * 0.85 ** (n - j) for j in range(k + 1)) for k, n in [(2, 10), (0, 5), (5, 5)]]
    assert np.allclose(got, want)
    df = spark.createDataFrame([(6, 2), (4, 3)], "n int, a int")
    got = [r[0] for r in df.select(numbers.random_hit_at_k(F.col("n"), F.col("a"), 3)).collect()]
    assert np.allclose(got, [1 - comb(4, 3) / comb(6, 3), 1.0])


def test_gram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    keys = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(keys, x)], "k int, v array<double>").repartition(5)
    assert np.allclose(linear.gram_matrices(df, "v", 4), x.T @ x)
    for k, g in linear.gram_matrices(df, "v", 4, ["k"]).items():
        assert np.allclose(g, x[keys == k].T @ x[keys == k])
    w = linear.solve_ridge(x.T @ x, [0, 1], [2], 0.5, free=1)
    assert np.allclose(linear.residual_mse(x.T @ x, [0, 1], [2], w, 300), np.mean((x[:, 2] - x[:, :2] @ w[:, 0]) ** 2))


@pytest.mark.parametrize("blocks", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6))
    x[7] = x[3]
    labels = rng.integers(0, 3, 90)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, int(labels[i]), [float(v) for v in u[i]]) for i in range(90)], "id bigint, label int, vector array<double>")
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    ranked = retrieval.rank_candidates(retrieval.candidates(df, df, 3))
    top = {}
    for r in ranked.where("rank <= 3").orderBy("query_id", "rank").collect():
        top.setdefault(r.query_id, []).append(r.bank_id)
    order = {i: sorted(range(90), key=lambda j: (-round(sims[i, j], 12), j))[:89] for i in range(90)}
    assert all(top[i] == order[i][:3] for i in range(90))
    for r in retrieval.class_margin(retrieval.candidates(df, df, 1)).collect():
        best = order[r.query_id][0]
        other = max(sims[r.query_id, j] for j in order[r.query_id] if labels[j] != labels[best])
        assert r.margin == pytest.approx(sims[r.query_id, best] - other)
    for r in retrieval.first_relevant_rank(df, df).collect():
        want = next(p + 1 for p, j in enumerate(order[r.id]) if labels[j] == labels[r.id])
        assert r.first_rank == want


def test_rows_are_copied_once_per_strip(spark):
    df = spark.range(400).select("id", F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("vector")).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = retrieval._over_bank(df, df, lambda q, b: [[q.num_rows], [b.num_rows]], "q bigint, b bigint").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.q * r.b for r in rows) == 400 * 400
    assert sum(r.q + r.b for r in rows) <= 2 * 4 * 400


def test_near_ties_and_copies_are_told_apart_in_double(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=6)
    # Steps of 1e-10 are lost in single precision; ids 20 to 24 are copies.
    x = [base + 1e-10 * i * np.eye(6)[i % 6] for i in range(20)] + [base] * 5 + [rng.normal(size=6) for _ in range(200)]
    u = np.array([v / np.linalg.norm(v) for v in x])
    labels = [i % 3 if i % 7 else None for i in range(len(u))]
    df = spark.createDataFrame([(i, labels[i], v.tolist()) for i, v in enumerate(u)], "id bigint, label int, vector array<double>")
    sims = np.array([(v * u).sum(axis=1) for v in u])
    np.fill_diagonal(sims, -np.inf)
    order = [sorted((j for j in range(len(u)) if j != i), key=lambda j: (-sims[i, j], j)) for i in range(len(u))]
    found = retrieval.rank_candidates(retrieval.candidates(df, df, 3)).where("rank <= 3").collect()
    assert {(r.query_id, r.rank): (r.bank_id, r.bank_label) for r in found} == {(i, k + 1): (order[i][k], labels[order[i][k]]) for i in range(len(u)) for k in range(3)}
    for r in retrieval.first_relevant_rank(df, df).collect():
        want = next((p + 1 for p, j in enumerate(order[r.id]) if labels[r.id] is not None and labels[j] == labels[r.id]), None)
        assert r.first_rank == want


def test_a_risk_curve_compares_all_pairs_once(spark, tmp_path):
    from tidegauge.plans import ranking
    from tidegauge.plans.views import Tables

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    curve = ranking._risk_curve(Tables(spark, str(tmp_path)))
    assert "CoGroups" not in curve._jdf.queryExecution().toString()
    last = curve.orderBy("threshold").first()
    assert last.accepted + last.controls == 40


def test_isolated_outliers_are_repaired(spark):
    rows = [(1, 0, "a", 9.0), (1, 0, "b", 1.0), (1, 0, "c", 2.0), (1, 0, "d", 0.0), (1, 1, "a", 9.0), (1, 1, "b", 9.0), (1, 1, "c", 0.0)]
    df = spark.createDataFrame(rows, "run int, i int, feature string, z double")
    got = {(r.i, r.feature): (r.fixed_value, r.repaired) for r in frames.repair_isolated_outliers(df, ["run", "i"], "z", 3.0, 2).collect()}
    assert got[0, "a"] == (1.0, True) and got[1, "a"] == (9.0, False) and got[0, "b"] == (1.0, False)


def test_frames_do_not_cross_runs(spark):
    df = spark.createDataFrame([(r, "f", i, float(i)) for r in (1, 2) for i in range(36)], "run int, feature string, i bigint, value double")
    f = frames.lookback_frames(df, ["run", "feature"], 6)
    assert {r["run"]: r["count"] for r in f.groupBy("run").count().collect()} == {1: 30, 2: 30}
    assert all(r.context == [r.i - 6 + j for j in range(6)] and r.target == r.i for r in f.collect())


def test_derangement_has_no_self_match(spark):
    df = spark.createDataFrame([(s, k) for s in (1, 2, 3) for k in range(s * 10, s * 10 + 5)] + [(9, 99)], "s int, k int")
    got = design.derangement(df, ["s"], "k").collect()
    assert all(r.donor != r.k for r in got) and [r.k for r in got if r.donor is None] == [99]
    assert sorted(r.donor for r in got if r.donor is not None) == sorted(r.k for r in got if r.donor is not None)
