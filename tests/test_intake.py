"""Wearable batches as a data source, batch and stream; intake of folders: once each, quarantine, no model, broken-off micro-batches."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from pulselake.sources import binary, wearable
from pulselake.streaming import intake

LIGHT = "path string, ts_ms long, lux float, is_outdoors boolean"


def light(folder, name, rows, at=None):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(binary.encode("light", rows))
    if at:
        os.utime(folder / name, ns=(at, at))


def test_batch_source_reads_every_kind(spark, tmp_path):
    wearable.register(spark)
    light(tmp_path / "a", "1.bin", [(1, 5.0), (2, 2000.0)])
    light(tmp_path / "a" / "deep", "2.bin", [(3, 1.0)])
    (tmp_path / "a" / "bad.bin").write_bytes(b"junk")
    (tmp_path / "a" / "3.bin").write_bytes(binary.encode("sleep", [(7, tuple(map(float, range(10))))]))
    (tmp_path / "a" / "4.bin").write_bytes(binary.encode("location", [(8, 1.5, 2.5, 3.0)]))
    df = spark.read.format("wearable_batches").option("kind", "light").option("bytes_per_task", "1").load(str(tmp_path / "a"))
    assert sorted((r.ts_ms, r.lux, r.is_outdoors) for r in df.collect()) == [(1, 5.0, False), (2, 2000.0, True), (3, 1.0, False)]
    assert df.rdd.getNumPartitions() == 5 and df.where("lux > 4").select("ts_ms").count() == 2
    assert [list(r.f) for r in spark.read.format("wearable_batches").option("kind", "sleep").load(f"file://{tmp_path}/a").collect()] == [list(map(float, range(10)))]
    assert [r.latitude for r in spark.read.format("wearable_batches").option("kind", "location").load(str(tmp_path / "a")).collect()] == [1.5]
    assert spark.read.format("wearable_batches").option("kind", "light").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="kind must be one of"):
        spark.read.format("wearable_batches").option("kind", "x").load(str(tmp_path / "a")).count()


def test_stream_source_goes_on_from_its_checkpoint(spark, tmp_path):
    wearable.register(spark)
    hour = 3_600_000_000_000
    t0 = 500_000 * hour

    def drain():
        s = spark.readStream.format("wearable_batches").option("kind", "light").option("horizon_seconds", "3600").load(str(tmp_path / "in"))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.ts_ms for r in spark.read.schema(LIGHT).parquet(str(tmp_path / "out")).collect())

    light(tmp_path / "in", "a.bin", [(1, 1.0)], t0)
    light(tmp_path / "in", "b.bin", [(2, 1.0)], t0 + 5 * hour)
    assert drain() == [1, 2]
    light(tmp_path / "in", "c.bin", [(3, 1.0)], t0 + 5 * hour)  # the time of one that was read
    light(tmp_path / "in", "d.bin", [(4, 1.0)], t0 + 5 * hour - hour // 2)  # earlier than the last, within the horizon
    assert drain() == [1, 2, 3, 4]
    assert drain() == [1, 2, 3, 4]
    light(tmp_path / "in", "e.bin", [(5, 1.0)], t0 + 9 * hour)
    light(tmp_path / "in", "f.bin", [(6, 1.0)], t0 + 7 * hour)
    assert drain() == [1, 2, 3, 4, 5, 6]


def start(spark, tmp_path, **more):
    return intake.consume(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), **more)


def taken(spark, tmp_path, kind="light"):
    schema = {"light": LIGHT, "location": "path string, ts_ms long, latitude double, longitude double, accuracy float", "quarantine": "path string, content binary, why string"}[kind]
    return intake.consumed(spark, str(tmp_path / "out"), kind, schema).collect()


def test_each_file_once_by_its_mark(spark, tmp_path):
    light(tmp_path / "in", "1.bin", [(1, 1.0)])
    (tmp_path / "in" / "2.bin").write_bytes(binary.encode("location", [(2, 1.0, 2.0, 3.0)]))
    (tmp_path / "in" / "3.bin").write_bytes(b"what is this")
    (tmp_path / "in" / "4.bin").write_bytes(binary.encode("light", [(4, 1.0)])[:-3])
    (tmp_path / "in" / "5.bin").write_bytes(b"")
    for more in ((), ("6.bin",)):
        for name in more:
            light(tmp_path / "in", name, [(6, 1.0)])
        start(spark, tmp_path, most_files=2).awaitTermination(180)
    assert sorted(r.ts_ms for r in taken(spark, tmp_path)) == [1, 6] and [r.ts_ms for r in taken(spark, tmp_path, "location")] == [2]
    bad = sorted((os.path.basename(r.path), bytes(r.content), r.why) for r in taken(spark, tmp_path, "quarantine"))
    assert [(n, w) for n, _, w in bad] == [("3.bin", "unknown mark"), ("4.bin", "cut off or malformed")] and bad[0][1] == b"what is this"


def test_broken_off_between_decoding_and_commit(spark, tmp_path, monkeypatch):
    for i in range(4):
        light(tmp_path / "in", f"{i}.bin", [(i, 1.0)])
    landed = intake._landed

    def dies(s, path, rows, number):
        landed(s, path, rows, number)
        if path.endswith("light") and number == 1:
            raise OSError("killed")  # the rows are written, the micro-batch isn't committed

    with monkeypatch.context() as m:
        m.setattr(intake, "_landed", dies)
        with pytest.raises(StreamingQueryException, match="killed"):
            start(spark, tmp_path, most_files=2).awaitTermination(180)
    light(tmp_path / "in", "9.bin", [(9, 1.0)])
    start(spark, tmp_path, most_files=2).awaitTermination(180)
    assert sorted(r.ts_ms for r in taken(spark, tmp_path)) == [0, 1, 2, 3, 9]


def test_waits_for_a_model(spark, tmp_path):
    light(tmp_path / "in", "1.bin", [(1, 1.0)])
    with pytest.raises(StreamingQueryException, match="no model for light"):
        start(spark, tmp_path, ready=lambda kind: kind != "light").awaitTermination(120)
    assert taken(spark, tmp_path) == []
    start(spark, tmp_path).awaitTermination(120)
    assert [r.ts_ms for r in taken(spark, tmp_path)] == [1]


def test_finished_sessions_go_through_the_model_once(spark, tmp_path):
    def session(name, times, final=True):
        d = tmp_path / "nights" / name
        d.mkdir(parents=True, exist_ok=True)
        for i, t in enumerate(times):
            (d / f"batch_{i}.bin").write_bytes(binary.encode("sleep", [(t, (float(t),) * 10)]))
        if final:
            (d / "SESSION.final").write_text("x")

    model = lambda rows: rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("f")[0]).alias("top"))
    go = lambda process: intake.finished_sessions(spark, str(tmp_path / "nights"), str(tmp_path / "staged"), str(tmp_path / "ck"), process).awaitTermination(120)
    session("a", [3, 1, 2])
    session("b", [5], final=False)
    with pytest.raises(StreamingQueryException, match="no model"):
        go(None)
    go(model)
    session("b", [5, 4])
    go(model)
    go(model)
    got = spark.read.schema("session string, n long, top float, batch int").parquet(str(tmp_path / "staged")).collect()
    assert sorted((r.session[-1], r.n, r.top) for r in got) == [("a", 3, 3.0), ("b", 2, 5.0)]
