"""Baselines that a stream renews: scores change at a renewal only, and a repeated micro-batch changes nothing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from pulselake.streaming import refresh

HOUR = 3_600_000
FIELDS = "user_id long, ts_ms long, rmssd double"


def compute(windows):
    return windows.groupBy("user_id").agg(F.avg("rmssd").alias("usual"), F.count(F.lit(1)).alias("n"))


def score(windows):
    return windows.select("user_id", "ts_ms", (F.col("rmssd") - F.col("usual")).alias("off"))


def test_scores_change_at_a_renewal_only(spark, tmp_path, monkeypatch):
    first = [(1, h * HOUR // 10, 40.0) for h in range(50)] + [(2, 0, 10.0), (None, 0, 5.0)]
    batches = [first, [(1, 20 * HOUR, 80.0), (2, 20 * HOUR, 10.0)], [(1, 31 * HOUR, 80.0)], [(1, 32 * HOUR, 80.0)]]

    def go(rows=None, scorer=score):
        if rows:
            spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
        refresh.scored_against_baselines(stream, str(tmp_path / "out"), str(tmp_path / "ck"), compute, scorer).awaitTermination(120)

    go(batches[0])
    go(batches[1])
    with pytest.raises(StreamingQueryException, match="lost"):  # after the baselines are renewed, before the scores are written
        go(batches[2], lambda w: (_ for _ in ()).throw(OSError("lost")) if w.sparkSession.read.parquet(str(tmp_path / "out" / "baselines")).count() else score(w))
    go()
    go(batches[3])
    got = {(r.user_id, r.ts_ms // HOUR): r.off for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    assert len(spark.read.parquet(str(tmp_path / "out" / "scores")).collect()) == sum(map(len, batches))
    assert got[1, 0] == 0.0 and got[1, 20] == 40.0  # against the first day's mean of 40
    usual = (50 * 40 + 2 * 80) / 52
    assert got[1, 31] == pytest.approx(80 - usual) and got[1, 32] == pytest.approx(80 - usual)  # renewed at hour 31, with the windows so far
    assert got[2, 0] is None and got[2, 20] is None and got[None, 0] is None  # too few windows
    kept = spark.read.parquet(str(tmp_path / "out" / "baselines")).collect()
    assert [(r.user_id, r.n, r.computed_at) for r in kept] == [(1, 52, 31 * HOUR)]
