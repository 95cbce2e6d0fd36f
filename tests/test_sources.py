"""Round trips of the binary batches."""

import base64

from pulselake.sources import binary


def test_binary_round_trip(spark):
    light = [(1000, 200.0), (2000, 25000.0)]
    place = [(5, 30.5, 31.25, 4.0)]
    sleep = [(7, tuple(float(x) for x in range(10)))]
    rows = [("a", binary.encode("light", light)), ("b", binary.encode("location", place)), ("c", binary.encode("sleep", sleep)), ("d", b"bad"), ("e", None), ("f", binary.encode("light", light) + b"tail"), ("g", binary.encode("sleep", sleep) + b"tail")]
    df = spark.createDataFrame([(p, bytearray(x) if x is not None else None) for p, x in rows], "path string, content binary")
    got = sorted(tuple(r) for r in binary.decode(df, "light").collect())
    assert got == [(p, t, lux, lux >= 1000) for p in "af" for t, lux in light]
    assert [tuple(r) for r in binary.decode(df, "location").collect()] == [("b", 5, 30.5, 31.25, 4.0)]
    assert [(r.path, r.ts_ms, list(r.f)) for r in binary.decode(df, "sleep").collect()] == [("c", 7, list(map(float, range(10))))]
    text = spark.createDataFrame([("x", base64.b64encode(rows[0][1]).decode())], "path string, payload string")
    assert binary.from_base64(text, "light").count() == 2


def test_finalised_sessions(spark, tmp_path):
    for s in ("one", "two"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "0.bin").write_bytes(binary.encode("sleep", [(1, (0.0,) * 10)]))
    (tmp_path / "one" / "SESSION.final").write_text("x")
    got = [r.session.rsplit("/", 1)[1] for r in binary.read_finalised_sessions(spark, str(tmp_path)).collect()]
    assert got == ["one"]


def test_small_batches_are_encoded_and_decoded_many_at_a_time(spark, sf_dir):
    import numpy as np

    from pulselake.plans import library
    from pulselake.sources import binary

    rows = np.array([(i, i / 4) for i in range(7)], binary.RECORDS["light"])
    assert binary.encode_all("light", rows, np.array([3, 0, 4])) == [binary.encode("light", r) for r in ([(i, i / 4) for i in range(3)], [], [(i, i / 4) for i in range(3, 7)])]
    many = [(str(i), binary.encode("light", [(i, float(i)), (i + 1, 1000.0)])) for i in range(3000)]
    got = binary.decode(spark.createDataFrame([*many, ("bad", b"SRL1"), ("none", None)], "path string, content binary").coalesce(1), "light")
    assert sorted((int(r.path), r.ts_ms, r.lux) for r in got.collect()) == sorted((i, i + k, v) for i in range(3000) for k, v in ((0, float(i)), (1, 1000.0)))
    plan = library.wearable_batches(spark, sf_dir)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # no call of Python for each batch
