"""Operators that the driver's tables don't reach: literal cases, files and stored tables."""

import datetime as dt
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.operators import baseline, checkins, evaluation, features, hrv, joins, models, night, places, scoring, signal, training, windows
from pulselake.sources import records, tables

MODEL = {"features": ["x"], "baseScore": 0.5, "importances": {"x": 1.0}, "normalization": {"mean": {"x": 0.0}, "std": {"x": 1.0}}, "trees": [{"nodeid": 0, "split": "x", "split_condition": 0.0, "yes": 1, "no": 2, "missing": 1, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 1.0}]}]}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- features and models


def test_activity_classes_and_temperature(spark):
    df = frame(spark, [(0.0, 50.0), (0.0, 70.0), (10.0, 70.0), (500.0, 70.0)], "steps double, hr double")
    got = [r[0] for r in df.select(features.activity_from_steps(F.col("steps"), F.lit(300), F.col("hr"))).collect()]
    assert got == ["sleeping", "sedentary", "walking", "active"]
    t = frame(spark, [(1, i * 60_000, 30.0 + i) for i in range(4)] + [(2, 0, 35.0)], "u int, ts_ms long, temperature_c double")
    rows = {r.u: r for r in features.temperature(t, ["u"]).collect()}
    assert (rows[1].temp_mean, rows[1].temp_slope, rows[1].temp_range) == pytest.approx((31.5, 1.0, 3.0)) and rows[2].temp_mean == 33.5
    assert features.temperature(t.where("u = 2"), ["u"], profile="train").first().temp_mean == 0.0


def test_accelerometer_repair_and_gates(spark):
    a = frame(spark, [(1, 0.0, 0.0, 1.0), (1, 0.0, 0.6, 0.8), (2, 0.0, 0.0, 2.0)], "u int, x double, y double, z double")
    rows = {r.u: r for r in features.accelerometer(a, ["u"]).collect()}
    assert rows[1].accel_mean == pytest.approx(1.0) and rows[1].activity_type == "sedentary" and rows[2].accel_mean == 0.0
    bad = frame(spark, [(float("nan"), 1.0), (float("inf"), 2.0), (3.0, None)], "a double, b double")
    assert [r.n_repaired for r in features.repaired(bad, ["a", "b"]).collect()] == [1, 1, 0]
    assert features.valid_rows(bad.withColumn("l", F.lit(1)), "l", [1], ["a"]).count() == 1
    assert features.covered(a, ["u"], 3, 0.6).select("u").distinct().count() == 1
    assert {r.u: r.rate for r in features.sampling_rate(a.withColumn("t", F.col("z") * 10), ["u"], "t").collect()}[2] is None
    assert features.union_all([a, bad]).columns == ["u", "x", "y", "z", "a", "b"]


def test_stress_gate_and_personal_figures(spark):
    w = frame(spark, [(1, 40.0, 800.0, 75.0, 33.0, 5.0), (2, 0.0, 0.0, 0.0, 33.0, 5.0), (3, 40.0, 800.0, 75.0, 33.0, None)], "u int, rmssd double, mean_rr double, hr_mean double, temp_mean double, x double")
    stats = frame(spark, [(1, "x", 6.0, 2.0)], "u int, feature string, mean double, std double")
    got = {r.u: r for r in models.predict_stress(w, ["u"], MODEL, stats, ["u"]).collect()}
    assert got[1].stress_score == round(100 / (1 + math.exp(0.5))) and got[1].contributors[0].direction == "high"  # z = -0.5
    assert got[2].confidence == 0.3 and got[2].contributors == []  # no usable signal: the rules
    assert got[3].stress_score == round(100 / (1 + math.exp(-1.5)))  # a missing value counts as 0
    assert models.predict_stress(w, ["u"], None).first().confidence == 0.6


def test_age_needs_ten_windows_and_says_so(spark):
    w = frame(spark, [(1, 40.0, 800.0, 3.0)] * 12 + [(2, 40.0, 800.0, 3.0)] * 9, "u int, rmssd double, mean_rr double, x double")
    ages = frame(spark, [(1, 20), (2, 30)], "u int, age int")
    got = {r.u: r for r in models.predict_bio_age(w, ["u"], MODEL | {"baseScore": 24.0}, ages).collect()}
    assert (got[1].predicted_age, got[1].age_gap, got[1].confidence, got[1].ready) == (25, 5, 0.2, True)
    assert (got[2].predicted_age, got[2].age_gap, got[2].ready) == (30, None, False)


def test_sustained_and_examples(spark):
    p = frame(spark, [(1, m * 60_000, 80.0 if m != 3 else 60.0) for m in range(0, 30, 1)], "u int, ts_ms long, anxiety_index double")
    got = [r.ts_ms // 60_000 for r in models.sustained(p, ["u"]).where("sustained").orderBy("ts_ms").collect()]
    assert got == list(range(14, 30))
    e = models.best_examples(frame(spark, [(1, 1, 0.7, 10), (1, 1, 0.9, 11), (0, 1, 0.8, 12)], "y int, z int, c double, i int"), [], "y", "z", "c", ["i"], "i")
    assert {(r.right, r.i) for r in e.collect()} == {(True, 11), (False, 12)}
    assert S.age_midpoint(F.lit("35-39")) is not None and spark.range(1).select(S.age_midpoint(F.lit("35-39"))).first()[0] == 37.0


# ---------------------------------------------------------------- nights


def test_previous_delta_resets_after_a_gap(spark):
    e = frame(spark, [(1, 0, 60.0), (1, 1, 62.0), (1, 2, None), (1, 3, 70.0), (1, 4, 71.0)], "u int, n int, m double")
    assert [r.hr_delta_prev for r in night.previous_delta(e, ["u"], "n", "m").orderBy("n").collect()] == [0.0, 2.0, 0.0, 1.0]


def test_epoch_heart_equals_plain(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 600_000, 80))
    v = rng.integers(50, 90, 80).astype(float)
    df = frame(spark, [(1, int(a), float(b)) for a, b in zip(t, v, strict=True)], "u int, t long, bpm double")
    got = {r.epoch: r for r in night.epoch_heart(df, ["u"], F.lit(0), "t", "bpm").collect()}
    for k in range(20):
        centre = k * 30_000 + 15_000
        own = v[(t >= centre - 120_000) & (t < centre + 120_000)]
        assert got[k].hr_mean == pytest.approx(own.mean()) and got[k].hr_sdsd == pytest.approx(np.diff(own).std())


def test_sequence_windows(spark):
    e = frame(spark, [("n", i, [float(i)]) for i in range(50)], "d string, i long, x array<double>")
    w = {r.win: r for r in night.sequence_windows(e, ["d"], "i", "x").collect()}
    assert w[1].n == 9 and len(w[1].x) == 41 and w[1].x[-1] == [49.0]
    assert sorted(r["first"] for r in night.sequence_windows(e, ["d"], "i", "x", 41, 4).collect()) == [0, 4, 8]


# ---------------------------------------------------------------- joins, windows, evaluation


def test_unknown_places_across_bands_and_the_date_line(spark):
    near, far = [(1, 30.50005, 31.0), (1, 10.0, 179.9999), (1, 0.0, 0.0)], [(1, 40.0, 10.0)]
    known = frame(spark, [(1, 30.49995, 31.0), (1, 10.0, -179.9999), (1, 0.0002, 359.9999 - 360), (1, 40.002, 10.0)], "u int, lat double, lon double")
    got = joins.unknown_places(frame(spark, near + far, "u int, lat double, lon double"), known, ["u"]).collect()
    assert [(r.lat, r.lon) for r in got] == [(40.0, 10.0)]


def test_unknown_places_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = np.column_stack([rng.uniform(-80, 80, 40), rng.uniform(-180, 180, 40)])
    a = base[rng.integers(0, 40, 300)] + rng.normal(0, 0.0012, (300, 2))
    cols = [(1, float(x), float(y)) for x, y in a]
    got = {(r.lat, r.lon) for r in joins.unknown_places(frame(spark, cols, "u int, lat double, lon double"), frame(spark, [(1, float(x), float(y)) for x, y in base], "u int, lat double, lon double"), ["u"]).collect()}
    want = {(x, y) for _, x, y in cols if (places._metres(x, y, base[:, 0], base[:, 1]) >= 100).all()}
    assert got == want and 20 < len(want) < 290


def test_lookups(spark):
    t = frame(spark, [("a", 1)], "k string, v int")
    assert joins.looked_up(frame(spark, [("a",)], "k string"), t, "k").first().v == 1
    with pytest.raises(Exception, match="unknown k: b"):
        joins.looked_up(frame(spark, [("b",)], "k string"), t, "k").collect()
    z = joins.zipped(frame(spark, [([1, 2], [3])], "a array<int>, b array<int>"), {"p": "a", "q": "b"}).collect()
    assert [(r.i, r.p, r.q) for r in z] == [(0, 1, 3), (1, 2, None)]


def test_running_centroids_of_places(spark):
    rows = [(1, i * 10, i, lat, 0.0) for i, lat in enumerate((0.0, 1.0, 0.0007, 1.0, 0.0014, 1.0, 0.00095))]  # 78 m, 156 m and 106 m from the first
    got = places.stays(frame(spark, rows, "user_id long, ts_ms long, event_id long, lat double, lon double")).orderBy("arrival").collect()
    assert [r.place for r in got] == [0, 1, 0, 1, 2, 1, 0]


def test_thresholds_gate_and_metrics(spark):
    p = frame(spark, [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2), (0, 0.1)], "y int, p double")
    best = evaluation.pick_threshold(p, "y", "p", points=6).first()
    assert best.threshold == pytest.approx(0.6) and best.f1 == pytest.approx(6 / 7)
    assert evaluation.pick_threshold(p, "y", "p", "youden", 6).first().youden == pytest.approx(2 / 3)
    assert evaluation.pick_threshold(p.limit(0), "y", "p").count() == 0
    close = frame(spark, [(0, 0.5), (1, 0.5 + 1e-9), (1, None)], "y int, p double")
    assert evaluation.pick_threshold(close, "y", "p", points=2, digits=None).first().f1 == 1.0 > evaluation.pick_threshold(close, "y", "p", points=2).first().f1
    m = evaluation.class_metrics(frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, z string").withColumn("g", F.lit(1)), ["g"], "y", "z").first()
    assert (m.accuracy, m.macro_f1) == pytest.approx((0.5, (0.5 + 2 / 3 + 0) / 3))
    folded = evaluation.folds(frame(spark, [(i % 7,) for i in range(70)], "s int"), "s", 3)
    assert folded.groupBy("s").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_normalise_prefers_the_users_own(spark):
    df = frame(spark, [(1, 4.0), (2, 4.0)], "u int, x double")
    out = {r.u: r.x for r in scoring.normalise(df, frame(spark, [(1, "x", 2.0, 2.0), (2, "x", 2.0, 0.0)], "u int, feature string, mean double, std double"), ["u"], MODEL).collect()}
    assert out == {1: 1.0, 2: 4.0}


def test_baseline_is_due(spark):
    w, b = frame(spark, [(u,) for u in (1, 2, 3) for _ in range(50 if u < 3 else 5)], "user_id long"), frame(spark, [(1, 90_000_000)], "user_id long, computed_at long")
    assert [r.user_id for r in baseline.due(w, b, 100_000_000).collect()] == [2]


def test_series_figures_equal_plain_loops():
    rng = np.random.default_rng(1)
    x = 800 + 40 * np.sin(np.arange(90) / 3) + rng.normal(0, 20, 90)
    n, tol, a, b = len(x), 0.2 * x.std(ddof=1), 0, 0
    for i in range(n - 2):
        for j in range(i + 1, n - 2):
            if abs(x[i] - x[j]) < tol and abs(x[i + 1] - x[j + 1]) < tol:
                b += 1
                a += j < n - 3 and abs(x[i + 2] - x[j + 2]) < tol
    assert hrv.sample_entropy(x) == pytest.approx(-math.log(a / b))
    t = np.concatenate([[0], np.cumsum(x) / 1000])
    m = int(t[-1] * 4)
    v = np.interp(np.arange(m) / 4, t[:-1], x)
    v = (v - v.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / (m - 1)))
    lf = sum(abs(sum(v[k] * np.exp(-2j * np.pi * f * k / m) for k in range(m))) ** 2 / (m * 4) for f in range(m // 2) if 0.04 <= f * 4 / m < 0.15)
    assert hrv.spectrum(x)["lf"] == pytest.approx(lf)
    assert 0.3 < hrv.dfa_alpha(rng.normal(0, 1, 300)) < 0.8 < hrv.dfa_alpha(np.cumsum(rng.normal(0, 1, 300)))


# ---------------------------------------------------------------- check-ins


def test_texts_of_a_checkin(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(checkins.cleaned_tip(F.lit("- 1. Take a walk outside\nmore"))) == "Take a walk outside"
    assert one(checkins.cleaned_tip(F.lit("* ok"), "none")) == "none"
    assert one(checkins.alert_text(F.lit("hrv_low"), F.lit(-2.34))) == "Low variability (2.3 deviations)"
    assert one(checkins.context_lines(*[F.lit(x) for x in (70, 30, 50, 20)], F.lit(None), F.lit(6.25), F.lit(""))).split("\n")[-1] in ("hours slept: 6.3", "hours slept: 6.2")
    risks = checkins.risk_codes(*[F.lit(float(x)) for x in (80, 60, 20, 5, 40, -0.5)], F.array(F.lit("work"), F.lit("general")))
    assert one(risks) == ["words_and_body_stressed", "poor_sleep", "themes:work", "compound:low_hrv+high_stress+anxiety+short_sleep"]
    joy = F.create_map(F.lit("joy"), F.lit(0.8), F.lit("calm"), F.lit(0.8))
    assert one(checkins.insight_codes(F.lit(-0.5), joy, F.lit(10), F.lit(20))) == ["words_stressed_body_steady", "feels_joy", "hrv_low"]


# ---------------------------------------------------------------- training


def test_splits_and_searches(spark):
    df = frame(spark, [(i, i % 10, i % 3 == 0) for i in range(300)], "i int, s int, y boolean")
    f = training.stratified_folds(df, "y", "i", 5, parts=2)
    assert max(r["count"] for r in f.groupBy("fold").count().collect()) <= 64
    v = training.subject_split(df, "s", 0.4)
    assert v.groupBy("s").agg(F.count_distinct("is_validation").alias("n")).where("n > 1").count() == 0
    assert len(list(training.leave_one_out(df, "s"))) == 10
    best, loss = training.swarm(lambda p: (p["a"] - 2) ** 2, {"a": (-5.0, 5.0)}, 10, 20)
    assert loss < 0.01 and abs(best["a"] - 2) < 0.1
    assert training.pack(lambda p: (p["a"] - 2) ** 2, {"a": (-5.0, 5.0)}, 10, 20)[1] < 0.01
    assert training.smallest_within(frame(spark, [(2, 0.80), (3, 0.895), (5, 0.9)], "k int, score double"), "k", "score").first().k == 3
    m = training.transfer_matrix({"a": df, "b": df}, lambda d: 1, lambda m, d: 0.5)
    assert [(x, y) for x, y, _ in m] == [("a", "b"), ("b", "a")]


def test_trials_side_by_side(spark):
    import threading
    import time

    running, most = set(), []

    def loss(p):
        running.add(threading.get_ident())
        most.append(len(running))
        got = spark.range(20).select(F.sum(F.pow(F.col("id") / 20 - p["a"], 2)).alias("s")).first().s + (p["b"] - 1) ** 2
        time.sleep(0.05)
        running.discard(threading.get_ident())
        return got

    for search in (training.swarm, training.pack):
        serial = search(loss, {"a": (0.0, 1.0), "b": (0.0, 2.0)}, 4, 2)
        assert max(most) == 1
        most.clear()
        assert search(loss, {"a": (0.0, 1.0), "b": (0.0, 2.0)}, 4, 2, parallel=4) == serial
        assert max(most) > 1
        most.clear()
    with pytest.raises(ZeroDivisionError):
        training.side_by_side(lambda x: 1 / x, [1, 0], 2)


def test_boosted_trees_and_their_portable_form(spark):
    rows = [(i, float(i % 20), float(i % 7), int(i % 20 > 9)) for i in range(400)]
    df = frame(spark, rows, "i int, a double, b double, y int")
    fitted = training.boosted(df, ["a", "b"], "y", rounds=5, depth=3)
    p = training.predicted(fitted, df, ["a", "b"])
    assert evaluation.binary_metrics(p.withColumn("g", F.lit(1)), ["g"], "y", "prob").first().accuracy == 1.0
    q = scoring.score_trees(df, training.portable(fitted, ["a", "b"]), "again")
    far = training.parity(p, q, ["i"], "prob", "again").first()
    assert far.n == 400 and far.worst < 1e-9
    cv = training.cross_validated(training.stratified_folds(df, "y", "i", 2), "fold", 2, ["a", "b"], "y", parallel=2, rounds=2, depth=2)
    assert cv.count() == 400
    effect = {r.feature: r.effect for r in training.occlusion(df, ["a", "b"], lambda d, out: d.withColumn(out, F.col("a") * 2), ["i"]).collect()}
    assert effect["b"] == 0 and effect["a"] == pytest.approx(19.0)


def test_attributions_and_recalibration(spark):
    a = frame(spark, [("x", 1.0, 2.0), ("x", -1.0, -2.0), ("y", -0.5, 1.0), ("y", 0.5, -1.0)], "feature string, value double, x double")
    ranks = training.attribution_ranks(a)
    assert [(r.feature, r["rank"], r.direction) for r in ranks.orderBy("rank").collect()] == [("x", 1, 1), ("y", 2, -1)]
    assert training.physiological_agreement(ranks, {"x": 1, "y": 1}).first().agreement == pytest.approx(2 / 3)
    p = frame(spark, [(i, 3.0 * i + 1, float(i)) for i in range(50)], "i int, y double, p double")
    assert all(r.calibrated == pytest.approx(r.y) for r in training.recalibrated(p, "y", "p", "i").collect())


# ---------------------------------------------------------------- signals


def test_beats_from_signals(spark):
    t = np.arange(0, 60, 1 / 64)
    pulse = np.sin(2 * np.pi * 1.25 * t) + 0.4 * np.sin(2 * np.pi * 0.1 * t)
    ecg = np.zeros(250 * 30)
    ecg[::200] = 1.0
    ecg = np.convolve(ecg, np.hanning(9), "same")
    ecg[5::50] = np.nan
    df = frame(spark, [(1, pulse.tolist()), (2, None)], "w int, x array<double>")
    for kind in ("pulse", "fine_pulse"):
        got = {r.w: r.rr for r in signal.beats(df, ["w"], "x", kind, 64.0).collect()}
        assert len(got[1]) > 65 and np.mean(got[1]) == pytest.approx(800, abs=2) and not got[2]
    rr = signal.beats(frame(spark, [(1, ecg.tolist())], "w int, x array<double>"), ["w"], "x", "ecg", 250.0).first().rr
    assert len(rr) > 30 and np.median(rr) == pytest.approx(800)
    assert signal.shapes(df.where("w = 1"), ["w"], "x").first().rise_mean == pytest.approx(0.4, abs=0.03)
    assert len(signal.at_rate(df.where("w = 1"), ["w"], "x", 64.0, 32.0).first().x) == 1920
    g = (1 + 0.5 * (np.arange(320) % 32 == 0)).tolist()
    assert signal.steps(frame(spark, [(1, g)], "w int, x array<double>"), ["w"], "x").first().step_count == 9  # the first isn't a peak


def test_band_pass_keeps_its_band():
    t = np.arange(0, 60, 1 / 64)
    for f, kept in ((2.0, 1.0), (0.05, 0.0), (25.0, 0.0)):
        y = signal.bandpass(np.sin(2 * np.pi * f * t), 64, 0.5, 8.0)[640:-640]
        assert np.abs(y).max() == pytest.approx(kept, abs=0.02)


def test_channels_of_several_rates(spark):
    df = frame(spark, [("s", list(range(64 * 25)), list(range(4 * 25)))], "s string, bvp array<int>, temp array<int>")
    rows = signal.multi_rate(df, "bvp", 64, {"temp": 4}, 10, ["s"]).orderBy("win").collect()
    assert [r.win for r in rows] == [0, 1] and rows[1].bvp[0] == 640 and rows[1].temp == list(range(40, 80))
    labels = frame(spark, [("s", i, 1 if i < 5 else 2) for i in range(14)], "s string, i long, label int")
    assert [r.label for r in signal.labels_at_rate(labels, ["s"], "i", "label", 7, 1).orderBy("i").collect()] == [1, 2]


# ---------------------------------------------------------------- files


def test_study_files(spark, tmp_path):
    (tmp_path / "S1").mkdir()
    (tmp_path / "S1" / "HR.csv").write_text("100.0\n2.0\n60\n61\n62\n")
    (tmp_path / "S1" / "BVP.csv").write_text("2024-01-01 00:00:10\n64\n1\n")
    (tmp_path / "S1" / "tags.csv").write_text("5.5\n")
    e = spark_rows(records.read_e4(spark, f"{tmp_path}/*/[HB]*.csv", ["v"]))
    assert [(r.signal, r.t, r.v) for r in e if r.signal == "HR"] == [("HR", 100.0, 60.0), ("HR", 100.5, 61.0), ("HR", 101.0, 62.0)]
    assert [r.t for r in e if r.signal == "BVP"] == [dt.datetime(2024, 1, 1, 0, 0, 10, tzinfo=dt.UTC).timestamp()]
    assert [(r.subject, r.t) for r in records.read_tags(spark, f"{tmp_path}/*/tags.csv").collect()] == [("S1", 5.5)]
    (tmp_path / "a.csv").write_text("f,condition\n1,0\n2,3\n")
    assert [r.stress_binary for r in records.read_rated_csv(spark, f"{tmp_path}/a.csv").orderBy("f").collect()] == [0, 1]
    got = records.read_renamed(spark, f"{tmp_path}/a.csv", {"f": "x", "gone": "y"}).orderBy("x").collect()
    assert [(r.x, r.y) for r in got] == [(1.0, None), (2.0, None)]
    (tmp_path / "12_hr.txt").write_text("t,hr\n0.5,60\n1.5,61\n")
    assert [(r.subject, r.t, r.hr) for r in records.read_timed_text(spark, f"{tmp_path}/12_hr.txt", ["t", "hr"]).orderBy("t").collect()] == [("12", 0.5, 60.0), ("12", 1.5, 61.0)]
    (tmp_path / "S1" / "ibi_rest.csv").write_text("0.8\n0.9\n")
    (tmp_path / "S1" / "ibi_other.csv").write_text("0.7\n")
    assert {(r.subject, r.trial, r.label) for r in records.read_trials(spark, f"{tmp_path}/S1/ibi_*.csv", {"rest": 0}).collect()} == {("S1", "rest", 0)}
    (tmp_path / "c7.csv").write_text("timestamp,date,activity\n2024-01-01 00:00:00,2024-01-01,5\n")
    assert records.read_actigraphy(spark, f"{tmp_path}/c7.csv").first().subject == "c7"
    one = spark.range(1).select(records.seconds(F.lit(1.7e12)), records.snapped_start(F.lit(10_890.0), F.lit(100.0))).first()
    assert tuple(one) == (1.7e9, 10_900.0)
    missing = records.features_or(spark, [(f"{tmp_path}/none*", None), (f"{tmp_path}/a.csv", records.read_rated_csv)], None)
    assert missing.count() == 2


def spark_rows(df):
    return df.orderBy("signal", "i").collect()


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        tone = (20000 * np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)).astype("<i2")
        tone[2000:4000] = 0
        w.writeframes(np.repeat(tone, 2).tobytes())
    df = records.read_wav(spark, f"{tmp_path}/*.wav")
    assert len(df.first().x) == 16000
    v = signal.voices(df, ["path"]).first()
    assert v.pauses == 1 and v.pitch_mean == pytest.approx(200, abs=3) and 0.2 < v.pause_mean < 0.26


def test_records_and_generators(spark):
    hr = frame(spark, [(1, 5, None, [(6, 60.0), (7, 61.0)]), (1, 50, "w", [])], "user_id long, start_ms long, source string, samples array<struct<time_ms:long,bpm:double>>")
    assert [(r.ts_ms, r.source) for r in records.heart_rate(hr, "user_id", 0, 10).collect()] == [(6, "unknown"), (7, "unknown")]
    t = frame(spark, [(1, 5, None), (1, 6, 36.5)], "user_id long, ts_ms long, temp double")
    assert [r.temp for r in records.point_records(t, "user_id", "temp", 0, 10, 0).orderBy("ts_ms").collect()] == [0.0, 36.5]
    s = frame(spark, [(1, 5, 9, None, [(5, 9, 6), (9, 10, 42)])], "user_id long, start_ms long, end_ms long, source string, stages array<struct<start_ms:long,end_ms:long,stage:int>>")
    assert [r.stage for r in records.stage_rows(records.sleep_records(s, "user_id", 0, 10), "user_id").collect()] == ["deep", "unknown"]
    day = records.mock_day(spark, 2, 0, 600_000)
    assert (day["hr"].count(), day["hrv"].count(), day["temp"].count()) == (240, 4, 20) and day["hr"].where("bpm < 95 or bpm >= 115").count() == 0
    f = records.labelled_features(spark, 3, 40, {"rmssd": (40.0, 10.0)}, {"rmssd": -30.0}, {"rmssd": (5.0, 200.0)})
    means = {r.stress_binary: r.m for r in f.groupBy("stress_binary").agg(F.avg("rmssd").alias("m")).collect()}
    assert f.where("stress_binary = 1").count() == 3 * 14 and means[0] - means[1] > 15
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, f.repartition(7).collect()))


# ---------------------------------------------------------------- stored tables


def test_store(spark, tmp_path):
    day = 86_400_000
    s = tables.Store(spark, str(tmp_path))
    assert s.read("points").count() == 0
    s.append("points", frame(spark, [(1, d * day, 1.0, 2.0) for d in range(40)], "user_id long, ts_ms long, lat double, lon double"))
    assert s.retain(40 * day, {"points": 30})["points"] == 10 and s.read("points").count() == 30
    s.upsert("checkins", frame(spark, [(1, "a", day, "hi", "{}"), (1, "b", day, "ho", '{"x": 1, "y": [2]}')], "user_id long, id string, ts_ms long, transcript string, meta string"))
    s.upsert("checkins", frame(spark, [(1, "a", day, "again", "{}")], "user_id long, id string, ts_ms long, transcript string, meta string"))
    assert {(r.id, r.transcript) for r in s.read("checkins").collect()} == {("a", "again"), ("b", "ho")}
    s.patch("checkins", "meta", frame(spark, [(1, "b", dt.date(1970, 1, 2), '{"x": {"z": 3}}')], "user_id long, id string, date date, patch string"))
    assert {r.id: r.meta for r in s.read("checkins").collect()} == {"a": "{}", "b": '{"y":[2],"x":{"z":3}}'}
    v = "user_id long, ts_ms long, departure_ms long, lat double, lon double, place int"
    s.append("visits", frame(spark, [(1, 5 * day + h, 0, 0.0, 0.0, 0) for h in (1, 2, 3)], v))
    s.rederive("visits", frame(spark, [(1, 5 * day + 2, 9, 0.0, 0.0, 7)], v), 5 * day + 2, 5 * day + 3)
    assert sorted((r.ts_ms - 5 * day, r.place) for r in s.read("visits").collect()) == [(1, 0), (2, 7)]
    s.rederive("visits", frame(spark, [], v), 5 * day, 6 * day)
    assert s.read("visits").count() == 0
    s.export(f"{tmp_path}/out", 0, 100 * day)
    assert {r.transcript for r in spark.read.json(f"{tmp_path}/out/checkins").collect()} == {tables.REDACTED}
    s.delete_all(1)
    assert s.read("points").count() == 0 and s.read("checkins").count() == 0
    tables.write_model(spark, f"{tmp_path}/model", MODEL)
    assert tables.read_model(spark, f"{tmp_path}/model") == MODEL
    key = F.lit("0123456789abcdef")
    assert spark.range(1).select(tables.unguarded(tables.guarded(F.lit("héllo"), key), key)).first()[0] == "héllo"


def test_a_night_average_at_a_half_follows_the_order(spark):
    beats = [97.85, 71.82, 74.83]
    assert math.floor((beats[0] + beats[1] + beats[2]) / 3 + 0.5) != math.floor((beats[2] + beats[1] + beats[0]) / 3 + 0.5)  # by rounding
    for given in (beats, beats[::-1]):
        df = spark.createDataFrame([(1, given.index(b), b, None) for b in given][::-1], "user_id long, event_id long, bpm double, rmssd double")
        total = 0.0
        for b in given:
            total += b
        got = night.night_heart(df.repartition(3), ["user_id"], order=["event_id"]).collect()
        assert [tuple(r) for r in got] == [(1, math.floor(total / 3 + 0.5), min(beats), 0, 0.0)]
