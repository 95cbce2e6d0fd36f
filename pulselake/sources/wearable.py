"""Spark data sources over folders of wearable batches: spark.read and spark.readStream .format("wearable_batches").

Options: path (a folder that driver and executors share, as a path or a URI that Arrow can open), kind (sleep, light, location),
glob (of file names, *.bin), bytes_per_task, and for streams horizon_seconds: a file that becomes visible later than so long after its
own time of change is not read.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from pulselake.sources.binary import FIELDS, OUTDOORS_LUX, RECORDS, records

BYTES_PER_TASK, HORIZON_SECONDS = 32 << 20, 3600


def _files(path: str, glob: str) -> list[tuple[str, int, int]]:
    """(path, time of change in ns, size) of the files below path whose names match, by time and path."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(((f.path, f.mtime_ns or 0, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob)), key=lambda f: (f[1], f[0]))


def _opened(path: str, root: str):
    from pyarrow import fs

    files = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    with files.open_input_file(path) as f:
        return f.read()


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Files in groups of about most bytes, one at least."""
    out, held, size = [], [], 0
    for path, _, n in files:
        if held and size + n > most:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, Files(tuple(held))] if held else out


class _Reading:
    def __init__(self, options: dict):
        self.root, self.kind = options["path"], options["kind"]
        if self.kind not in RECORDS:
            raise ValueError(f"kind must be one of {', '.join(RECORDS)}")
        self.glob = options.get("glob", "*.bin")
        self.most = int(options.get("bytes_per_task", BYTES_PER_TASK))
        self.horizon_ns = int(float(options.get("horizon_seconds", HORIZON_SECONDS)) * 1e9)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A batch of rows for each file; files that hold no batch of the kind give none."""
        for path in partition.paths:
            got = records(self.kind, _opened(path, self.root))
            if got is None or not len(got):
                continue
            cols = {"path": pa.array([path] * len(got), pa.string())}
            for c in RECORDS[self.kind].names:
                v = np.ascontiguousarray(got[c])
                cols[c] = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32())) if v.ndim > 1 else pa.array(v)
            if self.kind == "light":
                cols["is_outdoors"] = pa.array(np.asarray(got["lux"]) >= OUTDOORS_LUX)
            yield pa.RecordBatch.from_pydict(cols)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _dealt(_files(self.root, self.glob), self.most) or [Files(())]


class BatchStreamReader(_Reading, DataSourceStreamReader):
    """An offset is a time, before which every file has been read, and the files of that time or later that have been read: as
    many as appear within the horizon. So files of equal times, and files that become visible out of order within the horizon,
    are read once each, and a query that starts anew goes on where its checkpoint ends."""

    def initialOffset(self) -> dict:
        return {"floor": 0, "read": []}

    def latestOffset(self) -> dict:
        files = _files(self.root, self.glob)
        floor = max(0, files[-1][1] - self.horizon_ns) if files else 0
        return {"floor": floor, "read": [p for p, t, _ in files if t >= floor]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        seen, wanted = set(start["read"]), set(end["read"])
        due = [f for f in _files(self.root, self.glob) if f[0] not in seen and (f[0] in wanted or start["floor"] <= f[1] < end["floor"])]
        return _dealt(due, self.most)

    def commit(self, end: dict) -> None:
        """Files stay; what has been read is known from the offset."""


class WearableBatches(DataSource):
    """Rows of the batches of one kind: path, ts_ms and the kind's values; light has is_outdoors too."""

    @classmethod
    def name(cls) -> str:
        return "wearable_batches"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in FIELDS:
            raise ValueError(f"kind must be one of {', '.join(FIELDS)}")
        return f"path string, {FIELDS[kind]}" + (", is_outdoors boolean" if kind == "light" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return BatchStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WearableBatches)
