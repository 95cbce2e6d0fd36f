"""Study files in formats of their own: WFDB records and annotations, MATLAB 5 files, Excel workbooks, pickled wrist signals.

A file, or the few files of one record, is read in one task, from bytes that Spark's binaryFile source brings.
"""

from __future__ import annotations

import io
import pickle
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- WFDB

#: Codes of the annotation format that carry no annotation of their own.
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63


def wfdb_header(text: str) -> dict:
    """Record name, sampling rate, number of samples (None: unknown), signals (file, format, offset, gain, baseline, name) and the
    comments of a header."""
    lines = [x.strip() for x in text.splitlines()]
    comments = [x.lstrip("#").strip() for x in lines if x.startswith("#")]
    rows = [x.split() for x in lines if x and not x.startswith("#")]
    if not rows or len(rows[0]) < 2:
        raise ValueError("a header has a line of the record's name and number of signals")
    first = rows[0]
    rate = float(re.split(r"[/(]", first[2])[0]) if len(first) > 2 else 250.0
    signals = []
    for r in rows[1 : 1 + int(first[1])]:
        fmt = re.match(r"(\d+)(?:x\d+)?(?::\d+)?(?:\+(\d+))?", r[1])
        gain = re.match(r"([-+.\deE]+)(?:\((-?\d+)\))?", r[2]) if len(r) > 2 else None
        zero = int(r[4]) if len(r) > 4 else 0
        scale = float(gain[1]) if gain and float(gain[1]) else 200.0
        signals.append({"file": r[0], "format": int(fmt[1]), "offset": int(fmt[2] or 0), "gain": scale, "baseline": int(gain[2]) if gain and gain[2] else zero, "name": " ".join(r[8:])})
    return {"name": first[0].split("/")[0], "rate": rate, "samples": int(first[3]) if len(first) > 3 else None, "signals": signals, "comments": comments}


def wfdb_samples(raw: bytes, fmt: int, n_signals: int) -> np.ndarray:
    """(samples, signals) of a signal file of format 16 (little-endian words) or 212 (two 12-bit values in three bytes), as doubles;
    the least value of a format is a missing sample."""
    if fmt == 16:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(float)
        x[x == -32768] = np.nan
    elif fmt == 212:
        b = np.frombuffer(raw + b"\0" * (-len(raw) % 3), np.uint8).reshape(-1, 3).astype(np.int32)
        x = np.empty(2 * len(b))
        x[0::2], x[1::2] = b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] >> 4) << 8
        x = np.where(x > 2047, x - 4096, x)[: len(raw) * 2 // 3]
        x[x == -2048] = np.nan
    else:
        raise ValueError(f"signal format {fmt} isn't read")
    return x[: len(x) // n_signals * n_signals].reshape(-1, n_signals)


def wfdb_annotations(raw: bytes) -> list[tuple[int, int]]:
    """(sample, code) of each annotation: words of a code and a time since the one before; long times stand in two further words."""
    out, at, sample = [], 0, 0
    while at + 2 <= len(raw):
        (word,) = struct.unpack_from("<H", raw, at)
        code, step = word >> 10, word & 1023
        at += 2
        if code == 0 and step == 0:
            break
        if code == SKIP:
            if at + 4 > len(raw):
                break
            high, low = struct.unpack_from("<HH", raw, at)
            sample += struct.unpack("<i", struct.pack("<I", high << 16 | low))[0]
            at += 4
        elif code == AUX:
            at += step + step % 2
        elif code not in (NUM, SUB, CHN):
            sample += step
            out.append((sample, code))
    return out


def _stem(path: F.Column) -> F.Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


_BEATS = pa.schema({"record": pa.string(), "i": pa.int64(), "sample": pa.int64(), "t": pa.float64(), "code": pa.int32(), "age": pa.int32()})
_SIGNALS = pa.schema({"record": pa.string(), "channel": pa.string(), "rate": pa.float64(), "age": pa.int32(), "x": pa.list_(pa.float64())})


def _age(comments: list[str]) -> int | None:
    found = next((m for c in comments if (m := re.search(r"[Aa]ge:?\s*(\d+)", c))), None)
    return int(found[1]) if found else None


def _record(t: pa.Table) -> dict[str, bytes]:
    return {p.rsplit(".", 1)[-1].lower(): c for p, c in zip(t["path"].to_pylist(), t["content"].to_pylist(), strict=True)}


def read_wfdb_beats(spark: SparkSession, folder: str, annotator: str = "ecg") -> DataFrame:
    """(record, i, sample, t, code, age) of the annotations of each record below folder that has a header and an annotation
    file; t in seconds, age from the header's comments, if they tell it."""

    def run(t: pa.Table) -> pa.Table:
        files = _record(t)
        if "hea" not in files or annotator not in files:
            return _BEATS.empty_table()
        head = wfdb_header(files["hea"].decode("utf-8", "replace"))
        rows = wfdb_annotations(files[annotator])
        return pa.Table.from_pylist([{"record": head["name"], "i": i, "sample": s, "t": s / head["rate"], "code": c, "age": _age(head["comments"])} for i, (s, c) in enumerate(rows)], _BEATS)

    files = _files(spark, folder, f"*.{{hea,{annotator}}}")
    return files.groupBy(_stem(F.col("path")).alias("stem")).applyInArrow(run, "record string, i long, sample long, t double, code int, age int")


def read_wfdb_signals(spark: SparkSession, folder: str) -> DataFrame:
    """(record, channel, rate, age, x) of the signals of each record below folder, in their physical units; missing samples are
    NaN. A record's signals have to be in one file beside its header, under its name."""

    def run(t: pa.Table) -> pa.Table:
        files = _record(t)
        if "hea" not in files or "dat" not in files:
            return _SIGNALS.empty_table()
        head = wfdb_header(files["hea"].decode("utf-8", "replace"))
        own = head["signals"]
        if not own or len({(s["file"], s["format"]) for s in own}) > 1:
            return _SIGNALS.empty_table()
        x = wfdb_samples(files["dat"][own[0]["offset"] :], own[0]["format"], len(own))[: head["samples"]]
        return pa.Table.from_pylist([{"record": head["name"], "channel": s["name"] or str(k), "rate": head["rate"], "age": _age(head["comments"]), "x": (x[:, k] - s["baseline"]) / s["gain"]} for k, s in enumerate(own)], _SIGNALS)

    return _files(spark, folder, "*.{hea,dat}").groupBy(_stem(F.col("path")).alias("stem")).applyInArrow(run, "record string, channel string, rate double, age int, x array<double>")


# ---------------------------------------------------------------- MATLAB 5

#: Number types of elements, and classes of arrays that are numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MAT_MATRIX, MAT_COMPRESSED, MAT_CHAR = 14, 15, 4
MAT_NUMBERS = range(6, 16)


def mat_arrays(raw: bytes) -> dict[str, np.ndarray | str]:
    """The named number and text arrays of a MATLAB 5 file; arrays of other classes are left out."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB 5 file")
    order = "<" if raw[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray | str] = {}
    for kind, body in _mat_elements(raw[128:], order):
        if kind == MAT_COMPRESSED:
            for inner, part in _mat_elements(zlib.decompress(body), order):
                _mat_matrix(inner, part, order, out)
        else:
            _mat_matrix(kind, body, order, out)
    return out


def _mat_elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # up to four bytes beside their tag
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, raw[at + 4 : at + 4 + size]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != MAT_COMPRESSED else 0)


def _mat_matrix(kind: int, body: bytes, order: str, out: dict) -> None:
    if kind != MAT_MATRIX:
        return
    parts = list(_mat_elements(body, order))
    if len(parts) < 4:
        return
    array_class = struct.unpack_from(order + "I", parts[0][1])[0] & 255
    dims, name = np.frombuffer(parts[1][1], order + "i4"), parts[2][1].decode("latin-1")
    number, data = parts[3]
    if number not in MAT_TYPES or array_class not in (MAT_CHAR, *MAT_NUMBERS):
        return
    values = np.frombuffer(data, order + MAT_TYPES[number])
    if array_class == MAT_CHAR:
        out[name] = data.decode("utf-8", "replace") if number == 16 else "".join(map(chr, values))
    else:
        out[name] = values.reshape(dims, order="F")


def read_mat_labels(spark: SparkSession, folder: str, label: str, start: str, epoch_seconds: float = 30.0, glob: str = "*.mat") -> DataFrame:
    """(night, recorded, i, t, label) of each file below folder: the codes of the array label by epoch, and the text of the array start;
    night is the file's folder. Files without the label array give nothing."""
    schema = pa.schema({"night": pa.string(), "recorded": pa.string(), "i": pa.int64(), "t": pa.float64(), "label": pa.float64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                held = mat_arrays(raw)
                if not isinstance(held.get(label), np.ndarray):
                    continue
                x = held[label].ravel(order="F").astype(float)
                when = held.get(start)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([path.split("/")[-2]] * n, pa.string()), pa.array([when if isinstance(when, str) else None] * n, pa.string()), pa.array(np.arange(n)), pa.array(np.arange(n) * epoch_seconds), pa.array(x)], schema=schema)

    return _files(spark, folder, glob).mapInArrow(run, "night string, recorded string, i long, t double, label double")


# ---------------------------------------------------------------- Excel

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(raw: bytes, sheet: str | None = None) -> list[dict[str, str | None]]:
    """The rows of a sheet (the first, unless named) as texts by the names in its first row. Formulas count by their stored
    values; empty cells are null; columns without a name are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"there is no sheet {sheet!r}")
        path = target[sheets[sheet] if sheet is not None else next(iter(sheets.values()))]
        root = ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
    table = []
    for row in root.iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.iter(f"{_SHEET}c")):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else k
            value = c.find(f"{_SHEET}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
        table.append(cells)
    if not table:
        return []
    head = {k: v.strip() for k, v in table[0].items() if v and v.strip()}
    return [{name: r.get(k) for k, name in head.items()} for r in table[1:] if r]


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None) -> DataFrame:
    """(columns) as texts from every workbook of path. columns: our name to the words that the column's name has to hold, whatever
    their case; a column that isn't there is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"].to_pylist():
                rows = sheet_rows(raw, sheet)
                known = list(rows[0]) if rows else []
                of = {own: next((n for n in known if all(w in n.lower() for w in words.lower().split())), None) for own, words in columns.items()}
                yield pa.RecordBatch.from_pydict({own: pa.array([r[n] if n else None for r in rows], pa.string()) for own, n in of.items()})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def fatigue_labels(people: DataFrame, subject: str = "subject", cutoff: float = 12.0) -> DataFrame:
    """(subject, session, label) of columns morning and evening: 1 from the cutoff on. People without a number are left out."""
    each = F.array(*[F.struct(F.lit(s).alias("session"), F.col(s).try_cast("double").alias("v")) for s in ("morning", "evening")])
    return people.select(F.trim(subject).alias("subject"), F.inline(each)).where("v IS NOT NULL").select("subject", "session", (F.col("v") >= cutoff).cast("int").alias("label"))


def exam_label(grade: F.Column) -> F.Column:
    """How hard an exam was: what is missing to a hundred."""
    return 100 - grade


# ---------------------------------------------------------------- pickled wrist signals

#: Channels of the wrist and the labels, with their rates in Hz.
WRIST_HZ = {"BVP": 64, "EDA": 4, "TEMP": 4, "ACC": 32}
LABEL_HZ = 700
#: All that a pickle may name: what arrays are rebuilt from.
ALLOWED = {(m, n) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for n in ("_reconstruct", "scalar")} | {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}


class ArraysOnly(pickle.Unpickler):
    """Reads arrays, numbers, texts and containers; a pickle that names anything else is refused before it is called."""

    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")
        return super().find_class(module, name)


def unpickled(raw: bytes):
    return ArraysOnly(io.BytesIO(raw), encoding="latin1").load()


def wrist_channels(raw: bytes) -> list[tuple[str, int, np.ndarray]]:
    """(channel, rate, values) of a subject's wrist signals, acceleration by axis, and of the labels."""
    held = unpickled(raw)
    out = []
    for name, hz in WRIST_HZ.items():
        x = np.asarray(held["signal"]["wrist"][name], float)
        if x.ndim > 1 and x.shape[1] > 1:
            out += [(f"{name}_{axis}", hz, x[:, i]) for i, axis in enumerate("xyz"[: x.shape[1]])]
        else:
            out.append((name, hz, x.ravel()))
    return [*out, ("label", LABEL_HZ, np.asarray(held["label"], float).ravel())]


def read_wrist_pickles(spark: SparkSession, folder: str, glob: str = "*.pkl") -> DataFrame:
    """(subject, channel, hz, x) of each pickle below folder; the subject is the file's name. A pickle that names anything but arrays
    fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = wrist_channels(raw)
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * len(rows)), pa.array([c for c, _, _ in rows]), pa.array([h for _, h, _ in rows], pa.int32()), pa.array([x for *_, x in rows], pa.list_(pa.float64()))], names=["subject", "channel", "hz", "x"])

    return _files(spark, folder, glob).mapInArrow(run, "subject string, channel string, hz int, x array<double>")
