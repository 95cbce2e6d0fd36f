"""Streams against plain twins."""

import pytest
from pyspark.sql import functions as F

from pulselake.streaming import stateful


@pytest.fixture
def event_stream(spark, tmp_path):
    rows = [(1, 1_700_000_000_000 + 20_000 * i, float(i * 3 % 17), i) for i in range(40)] + [(2, 1_700_000_000_000 + 90_000 * i, float(i), 100 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "user_id long, ms long, value double, event_id long").withColumn("ts", F.timestamp_millis("ms"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in stream.sparkSession.table(name).collect()]


def test_throttle_and_trigger(event_stream, tmp_path):
    rows, stream = event_stream
    for name, op, passes in (("kept", stateful.throttled, lambda l, t, v: t - l[0] >= 60_000), ("hit", stateful.triggered, lambda l, t, v: abs(v - l[1]) >= 7)):
        want, last = [], {}
        for u, t, v, i in sorted(rows, key=lambda r: (r[0], r[1])):
            if u not in last or passes(last[u], t, v):
                last[u] = (t, v)
                want.append((u, t, v, i))
        assert sorted(drained(op(stream, "user_id", "ms", "value", "event_id"), tmp_path, name)) == sorted(want)


def test_tumbling_matches_batch(event_stream, tmp_path):
    rows, stream = event_stream
    got = {(r[0], int(r[1].timestamp() * 1000)): (r[3], r[7]) for r in drained(stateful.tumbling(stream, ["user_id"], "ts", "value"), tmp_path, "epochs", "complete")}
    want = {}
    for u, t, v, _ in rows:
        want.setdefault((u, t // 30_000 * 30_000), []).append(v)
    assert {k[0] for k in got} == {1, 2}
    assert sorted((k[0], n) for k, (_, n) in got.items()) == sorted((k[0], len(v)) for k, v in want.items())


def test_once_a_day(event_stream, tmp_path):
    _, stream = event_stream
    assert sorted(r[0] for r in drained(stateful.once_a_day(stream, ["user_id"], "ts"), tmp_path, "days")) == [1, 2]


def test_upsert_keeps_the_latest(spark, tmp_path):
    schema = "id long, day string, at long, x long"
    for n, rows in enumerate(([(1, "a", 1, 10), (2, "b", 1, 20)], [(1, "a", 2, 11), (3, "a", 1, 30), (1, "a", 1, 99)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.upsert_latest(stream, str(tmp_path / "out"), ["id"], "at", "day", str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).select("id", "day", "at", "x").collect())
    assert got == [(1, "a", 2, 11), (2, "b", 1, 20), (3, "a", 1, 30)]


def test_gap_reset_smoothing_and_cooldown(event_stream, spark, tmp_path):
    rows, stream = event_stream
    deltas = {r[3]: r[4] for r in drained(stateful.deltas(stream, "user_id", "ms", "value", "event_id", 20_000), tmp_path, "deltas")}
    value = {i: v for _, _, v, i in rows}
    assert all(deltas[i] == (value[i] - value[i - 1] if 0 < i < 40 else 0.0) for i in value)  # user 2's samples are gaps apart
    smooth = {r[3]: r[4] for r in drained(stateful.smoothed_scores(stream, "user_id", "ms", "value", "event_id", 24), tmp_path, "smooth")}
    for i in range(40):
        own = [value[j] for j in range(max(0, i - 23), i + 1)]
        assert smooth[i] == int(sum(own) / len(own) + 0.5)
    kinds = stream.withColumn("kind", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    got = drained(stateful.cooled_down(kinds, "user_id", "kind", "ms", "value", "event_id", 200_000), tmp_path, "alerts")
    want, last = set(), {}
    for u, t, _, i in sorted(rows, key=lambda r: (r[0], r[1])):
        if t - last.get((u, i % 2), -1e15) >= 200_000:
            last[u, i % 2] = t
            want.add(i)
    assert {r[4] for r in got} == want


def test_heart_epochs_equal_batch(event_stream, tmp_path):
    rows, stream = event_stream
    got = {(r[0], int(r[1].timestamp())): (r[2], r[6]) for r in drained(stateful.heart_epochs(stream, ["user_id"], "ts", "value"), tmp_path, "hearts")}
    last = max(t for _, t, _, _ in rows) / 1000
    assert got
    for (u, start), (mean, n) in got.items():
        own = [v for w, t, v, _ in rows if w == u and start + 15 - 120 <= t / 1000 < start + 15 + 120]
        assert n == len(own) and mean == pytest.approx(sum(own) / len(own)) and start + 30 <= last + 120


def test_trailing_and_sessions_equal_batch(event_stream, tmp_path):
    rows, stream = event_stream
    got = drained(stateful.sessions(stream, ["user_id"], "ts", "1 minute", "1 minute"), tmp_path, "sessions", "append")
    assert {(r[0], r[3]) for r in got} <= {(1, 40), (2, 1)} and got  # user 2's samples are 90 s apart
    hops = drained(stateful.trailing(stream, ["user_id"], "ts", "value", "2 minutes", "1 minute"), tmp_path, "hops", "complete")
    for u, at, mean, n in hops:
        end = int(at.timestamp() * 1000)
        own = [v for w, t, v, _ in rows if w == u and end - 120_000 <= t < end]
        assert n == len(own) and mean == pytest.approx(sum(own) / len(own))


def test_null_and_huge_keys_stay_apart(spark, tmp_path):
    big = 9_007_199_254_740_992
    rows = [(u, 1000 * i, float(v), big + i) for u in (None, big, big + 1) for i, v in enumerate((0.0, 5.0, 8.0, float('nan'), 30.0))]
    schema = "user_id long, ms long, value double, event_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drained(stateful.triggered(stream, "user_id", "ms", "value", "event_id"), tmp_path, "odd")
    assert sorted(got, key=str) == sorted([(u, 1000 * i, float(v), big + i) for u in (None, big, big + 1) for i, v in ((0, 0), (2, 8), (4, 30))], key=str)
