"""Folds over ordered rows: keys as they are, of any type, null or huge; states carried over batches."""

import random

import pytest
from pyspark.sql import functions as F

from pulselake.operators import places, windows

BIG = 9_007_199_254_740_992


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain(rows, passes):
    """(key, order) of the rows that pass, by a loop; rows: (key, order, value)."""
    out, last = set(), {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        if v is not None and v == v and (k not in last or passes(last[k], v)):
            last[k] = v
            out.add((k, o))
    return out


@pytest.mark.parametrize("keys", [[None, BIG, BIG + 1], ["", None, "a", "ä"], [1, 2, 3]])
def test_triggers_and_cooldowns_equal_loops(spark, tiny_batches, keys):
    rng = random.Random(str(keys))
    rows = [(rng.choice(keys), i, rng.choice([None, float("nan"), *[float(x) for x in range(20)]]), 10 * i + rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame([(*r, {"x": [r[1]]}) for r in rows], f"k {'string' if isinstance(keys[0], str) else 'long'}, i int, v double, at long, extra map<string,array<int>>")
    got = windows.triggered(df, ["k"], ["i"], "v", 7.0)
    assert got.columns == [*df.columns, "hit"] and got.count() == 300
    assert {(r.k, r.i) for r in got.where("hit").collect()} == plain([(k, i, v) for k, i, v, _ in rows], lambda a, b: abs(b - a) >= 7)
    cool = windows.cooled_down(df, ["k"], ["i"], "at", 145)
    assert {(r.k, r.i) for r in cool.where("let_through").collect()} == plain([(k, i, t) for k, i, _, t in rows], lambda a, b: b - a >= 145)
    assert {(r.k, r.i, r.extra["x"][0]) for r in cool.collect()} == {(k, i, i) for k, i, *_ in rows}


def test_huge_times_are_not_rounded(spark):
    rows = [(None, BIG), (None, BIG + 1), (None, BIG + 3), (None, None)]
    got = windows.cooled_down(spark.createDataFrame(rows, "k long, at long"), ["k"], ["at"], "at", 2).where("let_through").collect()
    assert sorted(r.at for r in got) == [BIG, BIG + 3]


def test_several_keys_of_odd_types(spark, tiny_batches):
    rows = [(float("nan"), [1], 1, 5.0), (float("nan"), [1], 2, 6.0), (None, None, 3, 1.0), (None, None, 4, 1.0), (0.5, [2], 5, 0.0), (0.5, [3], 6, 0.0)]
    got = windows.triggered(spark.createDataFrame(rows, "a double, b array<int>, i int, v double"), ["a", "b"], ["i"], "v", 7.0)
    assert sorted(r.i for r in got.where("hit").collect()) == [1, 3, 5, 6]


def test_smoothing_equals_a_loop(spark, tiny_batches):
    rng = random.Random(2)
    rows = [(rng.choice([None, "n", "o"]), i, rng.choice([0, 0, 1, 2, None]), rng.choice([0.3, 0.5, 0.9, None])) for i in range(400)]
    want = {}
    for night in (None, "n", "o"):
        own = [r for r in rows if r[0] == night]
        out = [c for *_, c, _ in own]
        for k in range(1, len(own) - 1):
            p, c, n, conf = out[k - 1], own[k][2], own[k + 1][2], own[k][3]
            if None not in (p, c, n, conf) and p == n and c != p and conf < 0.6:
                out[k] = p
        want |= {r[1]: c for r, c in zip(own, out, strict=True)}
    df = spark.createDataFrame(rows, "night string, i int, c int, p double")
    got = windows.smoothed(df, ["night"], ["i"], "c", "p")
    assert {r.i: r.smoothed for r in got.collect()} == want and got.schema["smoothed"].dataType == df.schema["c"].dataType


def test_stays_of_odd_users(spark, tiny_batches):
    points = [(0, 30.0), (1, 30.0), (2, 30.5), (3, 30.5), (4, 30.0)]
    rows = [(u, t, t, lat, 31.0) for u in (None, BIG, BIG + 1) for t, lat in points] + [(BIG, 5, 5, None, 31.0)]
    got = places.stays(spark.createDataFrame(rows, "user_id long, ts_ms long, event_id long, lat double, lon double"))
    want = [(0, 1, 0), (2, 3, 1), (4, 4, 0)]
    assert sorted((str(r.user_id), r.arrival, r.departure, r.place) for r in got.collect()) == sorted((str(u), *w) for u in (None, BIG, BIG + 1) for w in want)
    assert places.stays(got.select("user_id", F.col("arrival").alias("ts_ms"), F.col("place").alias("event_id"), "lat", "lon").limit(0)).count() == 0


def test_figures_of_a_series_take_many_groups_in_one_call(spark):
    import numpy as np

    from pulselake.operators import hrv

    rng = np.random.default_rng(5)
    sizes = {None: 40, 9_007_199_254_740_993: 70, 9_007_199_254_740_992: 25, 3: 12, 4: 1}
    rows = [(k, i, float(800 + 90 * rng.standard_normal())) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k long, i long, rr double")
    for profile in (hrv.DEVICE, hrv.TRAIN):
        out = hrv.series_features(df, ["k"], ["i"], profile)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {r.k: list(r)[1:] for r in out.collect()}
        assert got.keys() == sizes.keys()
        for k in sizes:
            x = np.array([r[2] for r in rows if r[0] == k])
            long = len(x) >= 10
            assert np.allclose(got[k], [*hrv.spectrum(x, profile=profile).values(), hrv.sample_entropy(x) if long else 0.0, hrv.dfa_alpha(x) if long else 0.0], atol=1e-12)
