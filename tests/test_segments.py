"""Split folds against the ordered ones: hot keys, null and huge keys, long stretches without a hit."""

import random

import numpy as np
import pytest

from pulselake.operators import segments, windows
from pulselake.operators.segments import Transition

BIG = 9_007_199_254_740_992


@pytest.mark.parametrize("absolute", [True, False])
def test_transitions_equal_running_through(absolute):
    rng = np.random.default_rng(int(absolute))
    for trial in range(60):
        n = int(rng.integers(0, 60))
        values = np.sort(rng.integers(0, 300, n)).astype(float) if trial % 3 == 0 else rng.integers(0, 40, n).astype(float)
        t = Transition(7.0, absolute)
        for part in np.array_split(values, 4):
            t.add(part)
        for state in (None, *range(-10, 60, 3), 1000.0):
            assert t.end(state) == windows._far(values, state, 7.0, absolute)[1], (trial, state)


def rows_of(seed, n):
    """A third of all rows are one user's; nulls and NaNs among the values."""
    rng = random.Random(seed)
    users = [BIG] * 4 + [None, BIG + 1, *range(6)]
    out, walk = [], 0.0
    for i in range(n):
        walk += rng.uniform(-1.5, 1.6)
        out.append((rng.choice(users), i, rng.choice([None, float("nan"), *[walk] * 12]), i * 3 + rng.randrange(3), f"row{i}"))
    return out


def test_split_folds_equal_ordered_ones(spark):
    rows = rows_of(1, 3000)
    df = spark.createDataFrame(rows, "u long, i int, v double, at long, extra string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            for name, column, least in (("triggered", "v", 7.0), ("cooled_down", "at", 500)):
                want = getattr(windows, name)(df, ["u"], ["i"], column, least, "hit")
                got = getattr(segments, name)(df, ["u"], ["i"], column, least, "hit")
                assert got.columns == want.columns
                a, b = sorted(map(str, got.collect())), sorted(map(str, want.collect()))
                assert a == b and any("hit=True" in x for x in a)
                assert segments.triggered(df.limit(0), ["u"], ["i"], "v", 7.0).count() == 0
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_users_rows_are_in_many_even_tasks(spark):
    df = spark.range(20_000).selectExpr("1 AS u", "id AS i", "CAST(id % 97 AS DOUBLE) AS v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = segments.triggered(df, ["u"], ["i"], "v", 50.0)
        sizes = [n for n in got.rdd.glom().map(len).collect() if n]
        assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
        assert got.where("hit").count() == windows.triggered(df, ["u"], ["i"], "v", 50.0).where("hit").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
