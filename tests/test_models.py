"""Stored models, the event report, compiled matrices, centred moments, frames over blocks and two-sample distances."""

import datetime
import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import calibration, detectors, drift, frames, linear, models, reports, windows
from tidegauge.sources import matrices


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("tidegauge.maxGroupRows", "7")
    yield
    spark.conf.unset("tidegauge.maxGroupRows")


def series_rows(lengths=(40, 23, 3)):
    rng = random.Random(1)
    return [(run, i, rng.random(), i % 3) for run, n in enumerate(lengths) for i in range(n)]


def test_frames_over_blocks_equal_plain_slices(spark, small_blocks):
    rows = series_rows()
    df = spark.createDataFrame(rows, "run int, i bigint, value double, n int")
    by = {(r, i): v for r, i, v, _ in rows}
    got = {(r.run, r.i): (r.context, r.target) for r in frames.lookback_frames(df, ["run"], 5).collect()}
    assert got == {(r, i): ([by[r, i - 5 + k] for k in range(5)], by[r, i]) for r, i in by if i >= 5}
    found = frames.future_blocks(df, ["run"], [1, 4], 2).collect()
    want = {(r, i, h): [by[r, i + h - 1], by[r, i + h]] for r, i in by for h in (1, 4) if (r, i + h) in by}
    assert {(r.run, r.i, r.horizon): r.block for r in found} == want and len(found) == len(want)
    found = frames.history_future_frames(df, ["run"], 4, 3, action="n").collect()
    want = {(r, i): ([by[r, i + k] for k in range(-3, 1)], [by[r, i + k] for k in (1, 2, 3)], [(i + k) % 3 for k in range(3)]) for r, i in by if i >= 3 and (r, i + 3) in by}
    assert {(r.run, r.i): (r.history, r.future, r.actions) for r in found} == want


def test_a_missing_step_gives_no_frame(spark, small_blocks):
    rows = [r for r in series_rows((30,)) if r[1] not in (6, 13, 14)]
    df = spark.createDataFrame(rows, "run int, i bigint, value double, n int")
    have = {r[1] for r in rows}
    assert {r.i for r in frames.lookback_frames(df, ["run"], 3).collect()} == {i for i in have if {i - 1, i - 2, i - 3} <= have}


def frame_rows(spark, n=60, features=3, lookback=4, runs=5):
    rng = np.random.default_rng(2)
    rows = []
    for run in range(runs):
        x = np.cumsum(rng.normal(size=(n, features)), axis=0)
        rows += [(run, i, x[i - lookback : i].ravel().tolist(), x[i].tolist()) for i in range(lookback, n)]
    return spark.createDataFrame(rows, "run int, i bigint, context array<double>, target array<double>")


def test_models_score_alike_after_writing_and_reading(spark, tmp_path):
    f = frame_rows(spark)
    unit = spark.createDataFrame([("a", 0.5, 2.0), ("b", 0.0, 1.0), ("c", 1.0, 3.0)], "feature string, location double, scale double")
    fitted = {
        "p": models.fit_persistence(f, 3), "r": models.fit_robust(f, unit), "w": models.fit_ridge(f, 3, 4),
        "l": models.fit_latent(f, 3, 4), "c": models.fit_latent(f, 3, 4, coherent=True),
    }
    folder = f"{tmp_path}/models"
    models.save(spark, fitted, folder)
    for name, model in fitted.items():
        again = models.load(spark.newSession(), folder, name)
        assert (again.kind, again.digest(), again.parameter_count()) == (model.kind, model.digest(), model.parameter_count())
        a, b = (sorted(tuple(r) for r in models.score(f, m).select("run", "i", "score", "alert").collect()) for m in (model, again))
        assert a == b and 0 < sum(r[3] for r in a) < len(a)


def test_ridge_model_equals_a_direct_solve(spark):
    f = frame_rows(spark)
    rows = f.collect()
    x = np.array([[*r.context, 1.0] for r in rows])
    y = np.array([r.target for r in rows])
    penalty = np.diag([1e-2] * 12 + [0.0])
    w = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    want = {(r.run, r.i): s for r, s in zip(rows, np.sqrt(((y - x @ w) ** 2).mean(axis=1)))}
    got = {(r.run, r.i): r.score for r in models.score(f, models.fit_ridge(f, 3, 4)).collect()}
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize(("change", "message"), [
    ({"version": 2}, "version"), ({"kind": "other"}, "unknown kind"), ({"numbers": {"features": 3.0, "threshold": 9.0}}, "digest"), ({"parameters": 7}, "digest"),
])
def test_changed_or_unknown_models_are_refused(spark, tmp_path, change, message):
    row = models.Model("persistence", {"features": 3, "threshold": 1.0}).to_row("m")
    names = ("name", "kind", "version", "numbers", "arrays", "parameters", "digest")
    stored = {**dict(zip(names, row)), **change}
    spark.createDataFrame([tuple(stored[n] for n in names)], models.SCHEMA).write.parquet(f"{tmp_path}/m")
    with pytest.raises(ValueError, match=message):
        models.load(spark, f"{tmp_path}/m", "m")
    with pytest.raises(ValueError, match="no model"):
        models.load(spark, f"{tmp_path}/m", "x")


def plain_report(rows, faults, noise, features, lookback, k=3):
    """Points, events, attribution and episodes of one detector, by loops."""
    phase = {}
    for run, i, *_ in rows:
        fault = next((f for f in faults if f[0] == run and f[1] <= i < f[2]), None)
        calm = any(r == run and a <= i < b for r, a, b in noise)
        phase[run, i] = "structural" if fault else "noise" if calm else "normal"
    by = {(r[0], r[1]): r for r in rows}
    rate = lambda p: sum(by[x][3] for x in by if phase[x] == p) / max(1, sum(q == p for q in phase.values()))
    hits, recalls, delays, events = [], [], [], 0
    for run, start, stop, affected in faults:
        inside = sorted(i for r, i in by if r == run and start <= i < stop)
        if not inside:
            continue
        events += 1
        first = next((i for i in inside if by[run, i][3]), None)
        if first is None:
            recalls.append(0.0)
            continue
        delays.append(first - inside[0])
        near = np.array([by[run, i][4] for i in range(first - lookback + 1, first + 1) if (run, i) in by])
        size = np.floor(np.abs(near).mean(axis=0) * 1e6 + 0.5) / 1e6
        top = sorted(range(len(features)), key=lambda p: (size[p], features[p]), reverse=True)[:k]
        found = sum(features[p] in affected for p in top)
        hits.append(found > 0)
        recalls.append(found / min(k, len(affected)))
    episodes = []
    for run in {r[0] for r in rows}:
        alerts = [i for r, i in sorted(by) if r == run and by[r, i][3]]
        for _, group in itertools.groupby(enumerate(alerts), key=lambda x: x[1] - x[0]):
            episodes.append(any(phase[run, i] == "structural" for _, i in group))
    return {
        "noise_alert_rate": rate("noise"), "normal_alert_rate": rate("normal"), "structural_alert_rate": rate("structural"), "events": events,
        "detected": len(delays), "mean_delay": np.mean(delays), "hit_at_3": np.mean(hits), "recall_at_3": np.mean(recalls),
        "episodes": len(episodes), "false_episodes": episodes.count(False),
    }


def test_event_report_equals_loops(spark, small_blocks):
    rng = random.Random(6)
    names = ["a", "b", "c", "d", "e"]
    rows = [(run, i, rng.random(), rng.random() < 0.3, [rng.random() for _ in names]) for run in range(6) for i in range(5, 60)]
    faults = [(run, s, s + 6, rng.sample(names, rng.randint(1, 4))) for run in range(5) for s in (10 + run, 40)]
    noise = [(run, 20, 28) for run in range(6)]
    scored = spark.createDataFrame([("x", *r, False) for r in rows], "detector string, run int, i bigint, score double, alert boolean, evidence array<double>, signed boolean")
    spans = spark.createDataFrame([(r, "structural", a, b, c) for r, a, b, c in faults] + [(r, "routine_noise", a, b, []) for r, a, b in noise], "run int, phase string, start_i bigint, stop_i bigint, affected array<string>")
    got = reports.event_report(scored, spans, names, 4).first()
    for name, value in plain_report(rows, faults, noise, names, 4).items():
        assert got[name] == pytest.approx(value), name


def test_broken_matrices_are_refused(spark, tmp_path):
    names = ["a", "b"]
    cells = [(1, w, f, v, w == 2) for w in (1, 2) for f, v in (("a", 1.5), ("b", float("nan")))]
    df = spark.createDataFrame(cells, "run bigint, window_end bigint, feature string, value double, reset boolean")
    digest = hashlib.sha256(b"x").hexdigest()
    matrices.write(df, f"{tmp_path}/good", names, digest, 3)
    back, about = matrices.read(spark, f"{tmp_path}/good")
    assert sorted(map(str, back.collect())) == sorted(map(str, (r for r in back.collect()))) and back.where("observed").count() == 2
    assert about.quality == {"missing_cells": 2, "reset_cells": 2, "flagged_points": 3} and about.capture_sha256 == digest
    assert '"value":[null,null]' in matrices.to_json(back).first().json
    for name, change, message in (
        ("mask", lambda d: d.withColumn("observed", F.lit(True)), "mask"), ("axes", lambda d: d.where("NOT (window_end = 1 AND feature = 'a')"), "once"),
        ("quality", lambda d: d.withColumn("reset", F.lit(False)), "quality"),
    ):
        change(back).write.parquet(f"{tmp_path}/{name}/cells")
        spark.read.parquet(f"{tmp_path}/good/about").write.parquet(f"{tmp_path}/{name}/about")
        with pytest.raises(ValueError, match=message):
            matrices.read(spark, f"{tmp_path}/{name}")


def test_moments_keep_digits_beside_large_means_and_keys_stay_on_executors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = 1e8 + rng.normal(size=(4000, 2))
    x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=4000)
    df = spark.createDataFrame([(i % 300, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>").repartition(6)
    monkeypatch.setattr(linear, "MERGE", 2)
    m = linear.one_moments(df, "v", 2)
    assert m.n == 4000 and np.allclose(m.covariance()[1], np.cov(x.T, ddof=0), rtol=1e-6)
    w, _ = m.ridge([0], [1], 0.0)
    e = x - x.mean(axis=0)
    assert w[0, 0] == pytest.approx((e[:, 0] @ e[:, 1]) / (e[:, 0] @ e[:, 0]), rel=1e-6)
    fits = linear.keyed_fits(df, "v", ["k"], lambda key, m: pd.DataFrame({"k": [key[0]], "n": [m.n], "spread": [m.covariance()[1][0, 0]]}), "k int, n double, spread double").collect()
    want = {k: x[k::300, 0].var() for k in range(300)}
    assert len(fits) == 300 and all(r.spread == pytest.approx(want[r.k], rel=1e-6) for r in fits)


def test_sign_flip_of_forty_irrational_differences(spark):
    """The whole distribution is symmetric, so the shares of the smaller and of the larger sums add up."""
    rng = np.random.default_rng(7)
    d = rng.normal(size=40) * np.sqrt(2) - 0.3
    p = calibration.exact_sign_flip(spark.createDataFrame([(float(x),) for x in d], "d double"), "d").first()
    assert p.patterns == 1 << 40 and p.p_value == p.as_extreme / 2**40
    draws = (rng.choice((-1, 1), size=(200_000, 40)) * np.abs(d)).sum(axis=1)
    assert p.p_value == pytest.approx((draws <= d.sum()).mean(), abs=0.005)
    with pytest.raises(ValueError, match="62 pairs"):
        calibration.exact_sign_flip(spark.createDataFrame([(1.0,)] * 63, "d double"), "d")


def test_two_samples_of_different_size(spark, small_blocks):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(31, 2)), 1 + 2 * rng.normal(size=(47, 2))
    df = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    lines = [[1.0, 0.0], [0.6, 0.8]]
    got = {r.direction: r.distance for r in drift.sliced_wasserstein(df(a), df(b), lines).collect()}
    for k, line in enumerate(lines):
        # Copies bring both samples to one size.
        want = np.mean((np.sort(np.repeat(a @ line, 47)) - np.sort(np.repeat(b @ line, 31))) ** 2)
        assert got[k] == pytest.approx(want)
    apart = ((a[:, None] - a[None]) ** 2).sum(axis=2)
    want = np.exp(-apart / 4).mean() - 2 * (2 / 3) * np.exp(-(a**2).sum(axis=1) / 6).mean() + 2 / 4
    assert drift.gaussian_prior_mmd(df(a), 2).first().mmd == pytest.approx(want)


def test_a_feature_outside_the_declared_list_is_counted(spark):
    points = spark.createDataFrame([("click",), ("click",), ("sixth",), (None,)], "feature string")
    got = {r.feature: (r.points, r.declared) for r in windows.declared_features(points, ["click", "view"]).collect()}
    assert got == {"click": (2, True), "sixth": (1, False), None: (1, False)}


def test_steps_without_evidence_rank_by_name(spark):
    f = frame_rows(spark, n=12, runs=1)
    rows = models.score(f, models.fit_persistence(f, 3)).collect()
    assert all(abs(sum(e * e for e in r.evidence) / 3 - r.score**2) < 1e-4 for r in rows)
    assert detectors.vector_frames(spark.createDataFrame([(1, i, [float(i)]) for i in range(5)], "run int, i bigint, state array<double>"), 2).count() == 3


def test_scaled_steps_read_the_activity_grid_once_written(spark, tmp_path):
    from tidegauge.plans import baselines
    from tidegauge.plans.views import SCHEMAS, Tables

    rows = [(i, datetime.datetime(2024, 1, 1 + i % 9, 5), i % 3, "view" if i % 2 else "click", float(i), '{"k": 3}') for i in range(60)]
    spark.createDataFrame(rows, SCHEMAS["events"]).write.parquet(str(tmp_path / "events.parquet"))
    steps = baselines.standard_steps(Tables(spark, str(tmp_path)))
    # Fit and scaling both read the written grid, and none of them the events again.
    assert steps.count() == 27 and not [f for f in steps.inputFiles() if "events.parquet" in f]
