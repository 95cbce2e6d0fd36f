"""Event-time epochs against the batch operators and a plain loop, over shuffled arrivals."""

import random

import numpy as np
import pytest

from pulselake.streaming import epochs

FIELDS = "user_id long, ms long, kind string, value double"
BIG = 9_007_199_254_740_993
T0 = 1_700_000_000_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def night(user, start, minutes, seed):
    """Heart samples every 5 s with a gap of ten minutes, motion every second, in order of time; an end marker."""
    rng = random.Random(seed)
    out = []
    for s in range(0, minutes * 60, 5):
        if not minutes * 20 < s < minutes * 20 + 600:
            out.append((user, start + s * 1000 + rng.randrange(900), "heart", float(rng.randrange(50, 90))))
        out += [(user, start + (s + k) * 1000 + rng.randrange(900), "motion", 1 + rng.random()) for k in range(5)]
    return [*out, (user, start + minutes * 60_000, "end", None)]


def plain(rows):
    out = {}
    for user in {r[0] for r in rows}:
        own = sorted((m, k, v) for u, m, k, v in rows if u == user and m is not None)
        begin = -1
        for end in [m for m, k, _ in own if k == "end"]:
            part = [r for r in own if begin <= r[0] < end and r[1] != "end" and r[2] is not None]
            begin, mean = end, None
            for e in range(part[0][0] // 30_000 * 30_000, end, 30_000):
                h = np.array([v for m, k, v in part if k == "heart" and e + 15_000 - 120_000 <= m < e + 15_000 + 120_000])
                a = np.array([v for m, k, v in part if k == "motion" and e <= m < e + 30_000])
                if not len(h):
                    mean = None
                    continue
                d = np.abs(np.diff(a))
                out[user, e] = (len(h), h.mean(), h.std(), h.min(), h.max(), h.max() - h.min(), np.diff(h).std() if len(h) > 2 else 0.0, h.mean() - mean if mean is not None else 0.0, *((d.sum(), d.max(), a.std()) if len(a) > 1 else (0.0, 0.0, 0.0)))
                mean = h.mean()
    return out


def figures(rows):
    return {(r.user_id, r.epoch): (r.n, *[r[f] for f in epochs.FIGURES]) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def run(spark, folder, name, batches, late, checkpoint=None):
    """Each batch is a file and a micro-batch of its own; what came out after each."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(folder / name))
        stream = spark.readStream.schema(FIELDS).parquet(str(folder / name))
        q = epochs.night_epochs(stream, ["user_id"], late=late).writeStream.format("parquet").option("path", str(folder / f"{name}-out")).option("checkpointLocation", str(folder / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        out.append(spark.read.schema("user_id long, epoch long, n long, " + ", ".join(f"{f} double" for f in epochs.FIGURES)).parquet(str(folder / f"{name}-out")).collect())
    return out


def test_stored_epochs_equal_a_loop(spark):
    rows = [*night(1, T0, 40, 1), *night(1, T0 + 7_200_000, 12, 2), *night(None, T0, 11, 3), *night(BIG, T0 + 5_000, 10, 4), *night(BIG - 1, T0, 10, 5), (1, None, "heart", 60.0), (1, T0 + 5, "heart", None), (2, T0, "heart", 60.0)]
    same(figures(epochs.stored_night_epochs(spark.createDataFrame(rows, FIELDS), ["user_id"]).collect()), plain([r for r in rows if r[0] != 2]))


def test_streamed_epochs_over_shuffled_arrivals_and_restarts(spark, tmp_path, rocks):
    rows = [*night(1, T0, 40, 1), *night(1, T0 + 3_000_000, 12, 2), *night(None, T0, 11, 3), *night(BIG, T0 + 5_000, 12, 4), *night(BIG - 1, T0, 12, 5)]
    rng = random.Random(7)
    # Arrival by time with up to four minutes of delay, in five batches; the query starts anew from its checkpoint for each.
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(240_000))
    step = len(arrival) // 5 + 1
    batches = [arrival[i : i + step] for i in range(0, len(arrival), step)]
    push = [(5, T0 + 20_000_000, "motion", 1.0)]  # someone else's later sample moves the watermark on
    after = run(spark, tmp_path, "shuffled", [*batches, push], "5 minutes")
    same(figures(after[-1]), plain(rows))
    assert 0 < len(after[2]) < len(after[-1])  # epochs came out on the way
    assert len(figures(after[-1])) == len(after[-1])  # and only once


def test_an_epoch_closes_135_seconds_after_its_start(spark, tmp_path, rocks):
    start = T0 // 30_000 * 30_000
    rows = [(1, start + 1_000, "heart", 60.0)]
    before, after, ended = run(spark, tmp_path, "closing", [[*rows, (2, start + 134_999, "motion", 1.0)], [(2, start + 135_000, "motion", 1.0)], [(1, start + 40_000 + 135_000, "end", None), (2, start + 600_000, "motion", 1.0)]], "0 seconds")
    assert before == [] and [(r.user_id, r.epoch, r.n, r.hr_mean) for r in after] == [(1, start, 1, 60.0)]
    assert [(r.epoch - start) // 30_000 for r in sorted(ended, key=lambda r: r.epoch)] == [0, 1, 2, 3]  # as far as the sample reaches


def test_motion_samples_of_one_time_count_in_order_of_their_values(spark):
    rows = [(1, T0, "heart", 60.0), *[(1, T0 + 1_000 + m, "motion", v) for m, v in ((0, 5.0), (0, 1.0), (10, 5.0))], (1, T0 + 60_000, "end", None)]
    for given in (rows, rows[::-1]):
        got = figures(epochs.stored_night_epochs(spark.createDataFrame(given, FIELDS).coalesce(1), ["user_id"]).collect())
        assert got[1, T0 // 30_000 * 30_000][8] == 4.0


def test_a_gap_of_years_costs_nothing():
    """A key's epochs are worked out where samples reach, not through every epoch of a gap."""
    heart = np.array([[T0, 60.0], [T0 + 4_000, 66.0], [T0 + 30_000 * 10**12, 70.0]])
    columns, mean = epochs.NightEpochs._closed({"heart": heart, "motion": np.zeros((0, 2))}, T0 // 30_000, T0 // 30_000 + 2 * 10**12, None)
    assert columns[1].tolist()[:5] == [2] * 5 and len(columns[0]) == 5 + 8 and mean is None
    assert columns[2].tolist()[:5] == [63.0] * 5 and columns[8].tolist() == [0.0] * 13
