"""Literal cases of single operators."""

import pytest
from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.functions import text as T
from pulselake.operators import hrv, places, scoring, windows


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_sentiment(spark):
    texts = ("very happy", "not happy", "stressed overwhelmed", "")
    got = one(spark, *[T.sentiment(T.tokens(F.lit(t))) for t in texts])
    assert got == pytest.approx((0.671531, -0.463342, -0.801996, 0.0), abs=1e-6)


def test_distances_and_scores(spark):
    p = [F.lit(float(x)) for x in (30, 31, 30.05, 31.05)]
    got = one(spark, S.haversine(*p), S.half_up(F.lit(-2.5)), S.watch_stress(F.lit(95.0), F.lit(65.0)), S.effectiveness(*[F.lit(float(x)) for x in (80, 40, 30, 36)]))
    assert got == pytest.approx((7354.0585, -2, 50.0, 0.81), abs=1e-3)


def test_time_domain(spark):
    rows = [("a", i, float(x)) for i, x in enumerate((800, 810, 790, 805, 795, 850))] + [("b", i, 800.0) for i in range(4)]
    got = {r.u: r for r in hrv.time_domain(spark.createDataFrame(rows, "u string, i int, rr double"), ["u"], ["i"]).collect()}
    a = got["a"]
    assert (a.mean_rr, a.sdnn, a.rmssd, a.pnn50, a.pnn20) == pytest.approx((808.333333, 21.602469, 27.748874, 20, 20), abs=1e-6)
    assert (a.hr_mean, a.hr_std, a.hr_range, a.cv_rr) == pytest.approx((74.269589, 1.921500, 5.361132, 0.026725), abs=1e-5)
    assert got["b"].mean_rr == got["b"].rmssd == 0


def test_robust_z_and_smoothing(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "g string, x double")
    assert sorted(r.x_rz for r in windows.robust_z(df, ["g"], ["x"]).collect()) == pytest.approx([-1.348982, -0.674491, 0, 0.674491, 65.425604], abs=1e-5)
    rows = [("n", i, c, p) for i, (c, p) in enumerate(zip((0, 1, 0, 1, 1), (0.9, 0.5, 0.5, 0.5, 0.9), strict=True))] + [("o", 0, 1, 0.1)]
    got = windows.smoothed(spark.createDataFrame(rows, "n string, i int, c int, p double"), ["n"], ["i"], "c", "p").orderBy("n", "i").collect()
    assert [r.smoothed for r in got] == [0, 0, 0, 1, 1, 1]


def test_stays_share_a_place_on_return(spark):
    rows = [(1, t, t, lat, 31.0) for t, lat in ((0, 30.0), (1, 30.0), (2, 30.5), (3, 30.5), (4, 30.0))]
    got = sorted((r.arrival, r.departure, r.place) for r in places.stays(spark.createDataFrame(rows, "user_id long, ts_ms long, event_id long, lat double, lon double")).collect())
    assert got == [(0, 1, 0), (2, 3, 1), (4, 4, 0)]


def test_trees_by_expression_and_by_walk_agree(spark, monkeypatch):
    model = {"features": ["x", "y"], "baseScore": 0.1, "trees": [{"nodeid": 0, "split": "x", "split_condition": 5.0, "yes": 1, "no": 2, "children": [
        {"nodeid": 1, "leaf": 0.5}, {"nodeid": 2, "split": "y", "split_condition": 1.0, "yes": 3, "no": 4, "children": [{"nodeid": 3, "leaf": -0.5}, {"nodeid": 4, "leaf": 1.5}]}]}]}
    df = spark.createDataFrame([(1.0, 0.0), (6.0, 0.0), (6.0, 2.0), (None, 2.0), (6.0, None)], "x double, y double")
    for missing in ("yes", "no"):
        monkeypatch.setattr(scoring, "MOST_EXPRESSION_NODES", 400)
        by_expression = [r.prob for r in scoring.score_trees(df, model, missing=missing).collect()]
        monkeypatch.setattr(scoring, "MOST_EXPRESSION_NODES", 0)
        assert [r.prob for r in scoring.score_trees(df, model, missing=missing).collect()] == pytest.approx(by_expression)
