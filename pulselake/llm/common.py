"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIRS: dict[str, str] = {}


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="pulselake-")
    return _OWN_DIRS[app]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files survive lost executors and are deleted when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pulselake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores after it what no column of df is called."""
    while name in df.columns:
        name += "_"
    return name


def set_aside(df: DataFrame, taken: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of the names in taken under others, and how to rename them back, so that helper columns clash with none."""
    back = {f"__own{i}": c for i, c in enumerate(df.columns) if c in taken}
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


def discard(*written: DataFrame) -> None:
    """Delete the files of materialized DataFrames that nothing reads any more."""
    for df in written:
        _delete(df.sparkSession, df.written_at)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is already gone; nothing is left to clean with
        return


#: Most rows, and most bytes of files, of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def sized(df: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df (a materialized table), marked for broadcast if the size of its files and its counted rows allow."""
    in_files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if in_files <= most_bytes and df.count() <= most_rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- word and shingle hashes

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd base of the polynomial over a word's bytes; its powers and their inverses modulo 2**64.
_BASE = 0x5851F42D4C957F2D
#: Tables for bytes.translate: 1 for white space, else 0; and A-Z lower-cased.
_SPACE = bytes(int(b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _translated(data: np.ndarray, table: bytes) -> np.ndarray:
    """data byte by byte through table (indexing an array by bytes would widen each to eight)."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts, as 64-bit hashes: words[offsets[i]:offsets[i + 1]] are text i's."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, fold: bool):
        """data: all texts' bytes; starts: text i is data[starts[i]:starts[i + 1]]."""
        n = len(data)
        space = _translated(data, _SPACE).view(bool)
        begin = ~space
        begin[1:] &= space[:-1]
        cut = starts[1:-1]
        cut = cut[cut < n]
        begin[cut] = ~space[cut]  # a text's first byte begins a word even if the text before has no trailing space
        end = ~space
        end[:-1] &= space[1:]
        last = cut[cut > 0] - 1
        end[last] = ~space[last]
        self.begin = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.offsets = np.searchsorted(self.begin, starts)
        self.hashes = _word_hashes(_translated(data, _FOLD) if fold else data, self.begin, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


#: Bytes whose hashes are summed together; the tables of powers have as many entries.
_SPAN = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(_SPAN + 1, _BASE, np.uint64), np.full(_SPAN + 1, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each data[begin:end]: the scrambled sum of byte i times base**i, from running sums over spans of bytes."""
    out = np.zeros(len(begin), dtype=np.uint64)
    up, down = _powers()
    at = 0
    while at < len(begin):
        first = begin[at]
        to = int(np.searchsorted(end, first + _SPAN, side="right"))
        if to <= at:  # one word longer than a span
            total, scale = 0, 1
            for k in range(first, end[at], _SPAN):
                part = data[k : min(k + _SPAN, end[at])]
                total += int(((part + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64)) * scale
                scale = scale * int(up[_SPAN]) % 2**64
            out[at] = np.uint64(total % 2**64)
            at += 1
            continue
        sums = np.zeros(end[to - 1] - first + 1, np.uint64)
        part = data[first : end[to - 1]]
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        b, e = begin[at:to] - first, end[at:to] - first
        out[at:to] = (sums[e] - sums[b]) * down[b]
        at = to
    return mix(out)


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array (nulls: empty) and the offsets of its values."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    wide = col.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    off = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + 1 + wide.offset)[wide.offset :]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches, text_col: str, most_bytes: int = 2 << 20):
    """Cut Arrow batches into slices of at most most_bytes of text (one row at least)."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        size = np.cumsum(np.diff(arrow_bytes(t[text_col])[1]))
        at = 0
        while at < t.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
            yield t.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers are kept; what they don't need should not be


def whole_groups(batches, keys: list[str], most_rows: int):
    """Tables of whole groups from batches that are sorted by integer columns keys: each of about most_rows rows, or of one group
    that is larger. So a task holds that much of its partition, not all of it."""
    import pyarrow as pa

    held: list = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most_rows:
            continue
        t = pa.Table.from_batches(held)
        new = np.zeros(n - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            new |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new) + 1
        if len(cuts):
            yield t.slice(0, int(cuts[-1]))
            t = t.slice(int(cuts[-1]))
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * _MULT + words[j : j + n]
        h ^= h >> np.uint64(32)
    return mix(h)
