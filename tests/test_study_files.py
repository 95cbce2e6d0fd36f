"""Study files that the tests write themselves; charts; flows of a watch."""

import io
import pickle
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import charts
from pulselake.sources import binary, study_files
from pulselake.streaming import watch


def pack_212(x):
    x = np.append(x, 0) if len(x) % 2 else x
    a, b = (x[0::2] & 0xFFF).astype(int), (x[1::2] & 0xFFF).astype(int)
    return np.stack([a & 255, (a >> 8) | (b >> 8) << 4, b & 255], axis=1).astype(np.uint8).tobytes()


def pack_annotations(rows):
    out, last = b"", 0
    for sample, code in rows:
        step = sample - last
        if not 0 <= step < 1024:
            raw = struct.unpack("<I", struct.pack("<i", step))[0]
            out += struct.pack("<HHH", study_files.SKIP << 10, raw >> 16, raw & 0xFFFF)
            step = 0
        out += struct.pack("<H", code << 10 | step)
        if code == 28:
            out += struct.pack("<H", study_files.AUX << 10 | 3) + b"(AF\0"
        last = sample
    return out + b"\0\0"


def test_wfdb_records(spark, tmp_path):
    rng = np.random.default_rng(0)
    x212, x16 = rng.integers(-2047, 2047, (101, 2)), rng.integers(-30000, 30000, (50, 1))
    x212[3, 1], x16[7, 0] = -2048, -32768
    beats = [(5, 1), (1028, 1), (1029, 28), (90_000, 5), (90_400, 1)]
    (tmp_path / "f1.hea").write_text("f1 2 250/1000(0) 101\n# Age: 23 Sex: M\nf1.dat 212 200(10)/mV 12 0 0 0 0 ECG lead\nf1.dat 212 0 12 5 0 0 0 resp\n")
    (tmp_path / "f1.dat").write_bytes(pack_212(x212.ravel()))
    (tmp_path / "f1.ecg").write_bytes(pack_annotations(beats))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "0002.hea").write_text("0002 1 1000 50\n0002.dat 16+4 100 16 0 0 0 0 ECG\n")
    (tmp_path / "deep" / "0002.dat").write_bytes(b"head" + x16.astype("<i2").tobytes())
    (tmp_path / "alone.hea").write_text("alone 1 100 5\nalone.dat 16\n")
    got = study_files.read_wfdb_beats(spark, str(tmp_path)).orderBy("i").collect()
    assert [(r.record, r.sample, r.code, r.age) for r in got] == [("f1", s, c, 23) for s, c in beats] and got[1].t == 1028 / 250
    signals = {(r.record, r.channel): r for r in study_files.read_wfdb_signals(spark, str(tmp_path)).collect()}
    assert set(signals) == {("f1", "ECG lead"), ("f1", "resp"), ("0002", "ECG")}
    lead = np.where(x212 == -2048, np.nan, x212.astype(float))
    np.testing.assert_allclose(signals["f1", "ECG lead"].x, (lead[:, 0] - 10) / 200)
    np.testing.assert_allclose(signals["f1", "resp"].x, (lead[:, 1] - 5) / 200)
    np.testing.assert_allclose(signals["0002", "ECG"].x, np.where(x16[:, 0] == -32768, np.nan, x16[:, 0] / 100))
    assert signals["0002", "ECG"].rate == 1000 and signals["0002", "ECG"].age is None
    with pytest.raises(ValueError, match="format 8"):
        study_files.wfdb_samples(b"", 8, 1)


def element(kind, data, order="<"):
    if len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, data, array_class, number, dims, order="<"):
    body = element(6, struct.pack(order + "II", array_class, 0), order) + element(5, struct.pack(order + f"{len(dims)}i", *dims), order) + element(1, name.encode(), order) + element(number, data, order)
    return struct.pack(order + "II", 14, len(body)) + body


def mat(*matrices, order="<", compressed=False):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + (b"\0\1IM" if order == "<" else b"\1\0MI")
    packed = [zlib.compress(m) for m in matrices]
    return head + b"".join(struct.pack(order + "II", 15, len(p)) + p for p in packed) if compressed else head + b"".join(matrices)


@pytest.mark.parametrize(("order", "compressed"), [("<", False), ("<", True), (">", False)])
def test_matlab_labels(spark, tmp_path, order, compressed):
    (tmp_path / "night1").mkdir()
    stages = np.array([0, 1, 2, 3, 5], order + "f8")
    raw = mat(matrix("stages", stages.tobytes(), 6, 9, (5, 1), order), matrix("began", "2020-01-02 03:04:05".encode("utf-16-" + ("le" if order == "<" else "be")), 4, 17, (1, 19), order), matrix("small", b"\7", 9, 2, (1, 1), order), matrix("cells", b"", 1, 1, (0, 0), order), order=order, compressed=compressed)
    (tmp_path / "night1" / "labels.mat").write_bytes(raw)
    (tmp_path / "other.mat").write_bytes(mat(matrix("x", b"\1", 9, 2, (1, 1))))
    got = study_files.read_mat_labels(spark, str(tmp_path), "stages", "began").orderBy("i").collect()
    assert [(r.night, r.recorded, r.i, r.t, r.label) for r in got] == [("night1", "2020-01-02 03:04:05", i, 30.0 * i, v) for i, v in enumerate([0, 1, 2, 3, 5])]
    grid = np.arange(6, dtype=order + "i4")
    held = study_files.mat_arrays(mat(matrix("m", grid.tobytes(), 12, 5, (2, 3), order), order=order))
    assert held["m"].tolist() == [[0, 2, 4], [1, 3, 5]]
    with pytest.raises(ValueError, match="not a MATLAB"):
        study_files.mat_arrays(b"x" * 200)


def workbook(rows, strings):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" sheetId="1" r:id="a"/><sheet name="Subject List" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(row) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_labels(spark, tmp_path):
    cell = lambda ref, v, t="n": f'<c r="{ref}" t="{t}"><v>{v}</v></c>'
    rows = [[cell("A1", 0, "s"), cell("B1", 1, "s"), cell("AA1", 2, "s")], [cell("A2", 3, "s"), cell("B2", "12"), cell("AA2", "11.5")], ['<c r="A3" t="inlineStr"><is><t> p2 </t></is></c>', cell("AA3", "20")]]
    (tmp_path / "info.xlsx").write_bytes(workbook(rows, ["subjects", "Morning fatigue score", "Evening Fatigue", "p1"]))
    people = study_files.read_sheet(spark, str(tmp_path / "info.xlsx"), {"subject": "subjects", "morning": "morning fatigue", "evening": "evening fatigue", "none": "nothing"}, "Subject List")
    assert sorted(tuple(r) for r in people.collect()) == [(" p2 ", None, "20", None), ("p1", "12", "11.5", None)]
    assert sorted(tuple(r) for r in study_files.fatigue_labels(people).collect()) == [("p1", "evening", 0), ("p1", "morning", 1), ("p2", "evening", 1)]
    assert study_files.sheet_rows((tmp_path / "info.xlsx").read_bytes()) == []
    assert spark.range(1).select(study_files.exam_label(F.lit(78))).first()[0] == 22


class Hostile:
    def __reduce__(self):
        return (print, ("run",))


def test_wrist_pickles(spark, tmp_path):
    held = {"signal": {"wrist": {"BVP": np.arange(4.0)[:, None], "EDA": np.ones((2, 1)), "TEMP": np.array([[33.5]]), "ACC": np.arange(6, dtype=np.int16).reshape(2, 3)}}, "label": np.array([0, 1, 1]), "subject": "S2"}
    for protocol in (2, 4):
        (tmp_path / f"S{protocol}.pkl").write_bytes(pickle.dumps(held, protocol=protocol))
    got = {(r.subject, r.channel): (r.hz, list(r.x)) for r in study_files.read_wrist_pickles(spark, str(tmp_path)).collect()}
    assert got["S2", "BVP"] == got["S4", "BVP"] == (64, [0, 1, 2, 3]) and got["S2", "ACC_y"] == (32, [1, 4]) and got["S4", "label"] == (700, [0, 1, 1]) and len(got) == 14
    for bad in (pickle.dumps({"label": Hostile()}), pickle.dumps(pickle.loads), b"cos\nsystem\n(S'true'\ntR."):
        with pytest.raises(pickle.UnpicklingError, match="allowed"):
            study_files.unpickled(bad)


def test_charts(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((0.0, 50.0, None, 100.0))] + [("b", 0, 25.0)], "s string, i int, v double")
    got = {(r.s, r.i): (r.x, r.y) for r in charts.line_points(df, ["s"], ["i"], "v", 300.0, 100.0).collect()}
    assert got["a", 1] == (100.0, 50.0) and got["a", 2] == (200.0, None) and got["a", 3] == (300.0, 0.0) and got["b", 0] == (0.0, 75.0)
    spans = spark.createDataFrame([("n", 0, 10, "out_of_bed"), ("n", 10, 30, "sleeping"), ("n", 30, 40, "deep"), ("m", 5, 5, None)], "d string, start_ms long, end_ms long, stage string")
    rows = {(r.d, r.start_ms): (r.row, r.x0, r.x1, r.y) for r in charts.hypnogram(spans, ["d"], width=400.0, height=132.0).collect()}
    assert rows["n", 0] == ("awake", 0.0, 100.0, 21.0) and rows["n", 10] == ("light", 100.0, 300.0, 81.0) and rows["n", 30][0] == "deep" and rows["m", 5] == ("light", 0.0, 0.0, 81.0)
    words = [tuple(r.d) for r in spark.createDataFrame([(61.0,), (60.0,), (40.0,)], "s double").select(charts.day_in_words(F.col("s")).alias("d")).collect()]
    assert words == [("Stressed", 49, 72), ("Okay", 48, 72), ("Good", 32, 68)]
    kept = charts.without_subjects(spark.createDataFrame([("f07",), ("S1",), (None,)], "s string"), "s", ("f07", "f14_a"))
    assert sorted(str(r.s) for r in kept.collect()) == ["None", "S1"]


def test_flows_batches_and_risks(spark, tmp_path):
    (tmp_path / "light").mkdir()
    (tmp_path / "light" / "1.json").write_text('{"user_id": 1, "ts_ms": 1000, "lux": 5}\n{"user_id": 1, "ts_ms": 500, "lux": 7}\nnot json\n{"user_id": 1, "ts_ms": 301000, "lux": 9}\n{"user_id": 2, "ts_ms": 2000}\n{"user_id": 3, "ts_ms": 9000000, "lux": 1}\n')

    def drain(stream, name):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()

    got = drain(watch.batched(watch.read_flow(spark, str(tmp_path / "light"), "light"), "light"), "batches")
    assert sorted((r.user_id, r.n, binary.records("light", bytes(r.content))["ts_ms"].tolist()) for r in got) == [(1, 1, [301000]), (1, 2, [500, 1000])]
    for kind, line, want in (("heart", '{"user_id": 1, "ts_ms": 1, "bpm": 71.9}', (1, 1, 71)), ("location", '{"user_id": 1, "ts_ms": 1, "latitude": 2.5, "longitude": 3.5}', (1, 1, 2.5, 3.5, -1.0)), ("motion", '{"user_id": 1, "ts_ms": 1, "x": 0, "y": 19.6133, "z": 0}', (1, 1, 2.0))):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "1.json").write_text(line)
        assert [tuple(r)[:-1] for r in drain(watch.read_flow(spark, str(tmp_path / kind), kind), f"{kind}-out")] == [pytest.approx(want)]

    fields = "user_id long, ts_ms long, risk_score long, risk_level string, probability double"
    spark.createDataFrame([(1, 1, 10, "low", 0.1), (1, 2, 80, "high", 0.8), (2, 1, 50, "mid", 0.5), (None, 1, 5, "low", 0.05)], fields).coalesce(1).write.parquet(str(tmp_path / "risks"))

    def send(payloads):
        return [p["user_id"] is not None for p in payloads]

    def broken(payloads):
        raise OSError("no watch")

    for name, how in (("sent", send), ("unsent", broken)):
        watch.send_risks(spark.readStream.schema(fields).parquet(str(tmp_path / "risks")), how, str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination(120)
        rows = sorted(((r.user_id, r.risk_score, r.sent, r.why) for r in spark.read.parquet(str(tmp_path / name)).collect()), key=str)
        assert rows == sorted([(1, 80, how is send, None if how is send else "OSError: no watch"), (2, 50, how is send, None if how is send else "OSError: no watch"), (None, 5, False, None if how is send else "OSError: no watch")], key=str)


def test_weekday_means_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), 1_706_000_000 + rng.randrange(20 * 86_400), rng.choice([None, float(rng.randrange(100))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "u long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    as_of = 1_706_000_000 + 18 * 86_400
    got = {(r.u, r.weekday): (r.value, r.n) for r in charts.weekday_means(df, ["u"], "ts", "v", F.timestamp_seconds(F.lit(as_of))).collect()}
    for u in (None, 1, 2):
        for day in range(7):
            own = [v for w, s, v in rows if w == u and v is not None and 0 <= (as_of - s) // 86_400 < 7 and (s // 86_400 + 3) % 7 == day]
            assert got[u, day] == (int(sum(own) / len(own) + 0.5) if own else 0, len(own))
