"""Little-endian sample batches from wearables: readers over binary files, and the encoders for them.

Fixed values: a batch is a header and fixed-width records.
  sleep 'SRN1':    i32 magic, u16, u16, i64, i32 count, u16 width, u16; records i64 + 10 x f32; exact length
  light 'SRL1':    i32 magic, u16, u16, u32 count; records i64 + f32; trailing bytes are tolerated
  location 'SRG1': i32 magic, u16, u16, u32 count; records i64 + f64 + f64 + f32; trailing bytes are tolerated
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLEEP, LIGHT, LOCATION = b"SRN1", b"SRL1", b"SRG1"
SLEEP_HEAD, ENV_HEAD = "<iHHqiHH", "<iHHI"
SLEEP_WIDTH = 10
RECORDS = {
    "sleep": np.dtype([("ts_ms", "<i8"), ("f", "<f4", (SLEEP_WIDTH,))]),
    "light": np.dtype([("ts_ms", "<i8"), ("lux", "<f4")]),
    "location": np.dtype([("ts_ms", "<i8"), ("latitude", "<f8"), ("longitude", "<f8"), ("accuracy", "<f4")]),
}
MAGIC = {"sleep": SLEEP, "light": LIGHT, "location": LOCATION}
FIELDS = {"sleep": "ts_ms long, f array<float>", "light": "ts_ms long, lux float", "location": "ts_ms long, latitude double, longitude double, accuracy float"}
OUTDOORS_LUX = 1000.0
#: Records of small batches that come out of a decoder together.
TOGETHER = 10_000


def _magic(name: bytes) -> int:
    return int.from_bytes(name, "little")


def records(kind: str, raw: bytes) -> np.ndarray | None:
    """The records of one batch; None if its header, width or length is wrong."""
    dtype, head = RECORDS[kind], SLEEP_HEAD if kind == "sleep" else ENV_HEAD
    if raw is None or len(raw) < struct.calcsize(head):
        return None
    parts = struct.unpack_from(head, raw)
    count = parts[4] if kind == "sleep" else parts[3]
    size = struct.calcsize(head) + count * dtype.itemsize
    if parts[0] != _magic(MAGIC[kind]) or count < 0:
        return None
    if kind == "sleep" and (parts[5] != SLEEP_WIDTH or len(raw) != size) or len(raw) < size:
        return None
    return np.frombuffer(raw, dtype, count=count, offset=struct.calcsize(head))


def encode(kind: str, rows: list[tuple], started_ms: int = 0) -> bytes:
    """One batch of rows (for sleep: (ts_ms, ten floats))."""
    return encode_all(kind, np.array(rows, RECORDS[kind]), np.array([len(rows)]), started_ms)[0]


def encode_all(kind: str, rows: np.ndarray, counts: np.ndarray, started_ms: int = 0) -> list[bytes]:
    """Batches of counts rows each, of RECORDS[kind], one after the other."""
    ends = np.cumsum(counts)
    head = lambda n: struct.pack(SLEEP_HEAD, _magic(SLEEP), 1, 0, started_ms, n, SLEEP_WIDTH, 0) if kind == "sleep" else struct.pack(ENV_HEAD, _magic(MAGIC[kind]), 1, 0, n)
    return [head(int(n)) + rows[end - n : end].tobytes() for n, end in zip(counts, ends, strict=True)]


def decode(files: DataFrame, kind: str, content: str = "content", path: str = "path") -> DataFrame:
    """(path, the kind's fields) of every record of the batches in files; batches that are no such kind give no rows.
    light adds is_outdoors. One batch is one row of files; small ones come out together, so memory is bounded by TOGETHER records
    or a batch."""
    names = RECORDS[kind].names

    def table(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        every = np.concatenate([got for _, got in held])
        cols = [pa.array([p for p, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(got) for _, got in held])))]
        for c in names:
            v = np.ascontiguousarray(every[c])
            cols.append(pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32())) if v.ndim > 1 else pa.array(v))
        return pa.RecordBatch.from_arrays(cols, names=[path, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for p, raw in zip(batch[path], batch[content], strict=True):
                got = records(kind, raw.as_py())
                if got is None or not len(got):
                    continue
                held.append((p.as_py(), got))
                size += len(got)
                if size >= TOGETHER:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    out = files.select(path, content).mapInArrow(run, f"{path} string, {FIELDS[kind]}")
    return out.withColumn("is_outdoors", F.col("lux") >= OUTDOORS_LUX) if kind == "light" else out


def read_batches(spark: SparkSession, folder: str, kind: str, glob: str = "*.bin") -> DataFrame:
    """All batches below folder, in any number of files."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder), kind)


def from_base64(df: DataFrame, kind: str, text: str = "payload", key: str = "path") -> DataFrame:
    """Batches that travel as base64 text."""
    return decode(df.select(F.col(key).cast("string").alias("path"), F.unbase64(text).alias("content")), kind)


def read_finalised_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sleep batches of the session folders that hold a SESSION.final marker. Both lists of folders are DataFrames; the
    markers meet the batches in a join, not on the driver."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    session = F.regexp_replace("path", r"/[^/]+$", "")
    final = every.where(F.col("path").endswith("/SESSION.final")).select(session.alias("_final")).distinct()
    batches = every.where(F.col("path").endswith(".bin"))
    return decode(batches.join(final, session == F.col("_final"), "left_semi"), "sleep").withColumn("session", session)
