"""Triggers and cooldowns of keys that may hold much of all rows: a key's rows are cut into segments, and segments are joined by what
each makes of the state it is entered with.

Rows are dealt by ranges of key and order, so that the tasks are even whatever the keys. Only the first key of a task can have begun in
an earlier one. A first pass works out, for that key, how the state after the task's rows depends on the state before them; a step
over one row for each task strings these together; a second pass runs each task's rows from the state it is entered with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.operators.windows import _changes, _far, key_runs
from pulselake.sources.scratch import scratch


@dataclass
class Transition:
    """What some rows make of a state. From a state, the next row that passes is the first that is at least so far above it (or
    below it, if distances count), and the first row that far above is one that is above all before it. So it takes the rows that are
    records, their places, and the state that the rows after each end in."""

    least: float
    absolute: bool
    n: int = 0
    #: For records upwards and downwards: value, place, state at the end if this row passes.
    above: list[tuple] = field(default_factory=list)
    below: list[tuple] = field(default_factory=list)

    def add(self, values: np.ndarray) -> None:
        """Take in the rows that come after those so far."""
        if not len(values):
            return
        ends = _Ends(values, self.least, self.absolute)
        # What the rows so far ended in goes on through the new ones.
        after = Transition(self.least, self.absolute, 0, *([(values[i].item(), i, ends.of(i)) for i in _records(s * values)] if s > 0 or self.absolute else [] for s in (1, -1)))
        after.n = len(values)
        self.above = [(v, at, after.end(e)) for v, at, e in self.above]
        self.below = [(v, at, after.end(e)) for v, at, e in self.below]
        self.above += [(v, self.n + at, e) for v, at, e in after.above if not self.above or v > self.above[-1][0]]
        self.below += [(v, self.n + at, e) for v, at, e in after.below if not self.below or v < self.below[-1][0]]
        self.n += len(values)

    def end(self, state):
        """The state after the rows, entered with state (None: nothing has passed yet)."""
        if not self.n:
            return state
        if state is None:
            return self.above[0][2]  # the first row passes; it is a record
        found = [next(((at, e) for v, at, e in self.above if v - state >= self.least), None)]
        if self.absolute:
            found.append(next(((at, e) for v, at, e in self.below if state - v >= self.least), None))
        first = min((f for f in found if f is not None), default=None, key=lambda f: f[0])
        return state if first is None else first[1]


def _records(values: np.ndarray) -> list[int]:
    high = np.maximum.accumulate(values)
    return [0, *(np.flatnonzero(values[1:] > high[:-1]) + 1).tolist()]


class _Ends:
    """The last row that passes if a given row does; every row is gone through once, however many rows are asked for."""

    def __init__(self, values: np.ndarray, least: float, absolute: bool):
        self.values, self.least, self.absolute = values, least, absolute
        self.known: dict[int, object] = {}

    def of(self, row: int):
        chain = []
        while row not in self.known:
            chain.append(row)
            rest = self.values[row + 1 :]
            at = _next(rest, self.values[row].item(), self.least, self.absolute)
            if at is None:
                self.known[row] = self.values[row].item()
            else:
                row += 1 + at
        end = self.known[row]
        self.known.update(dict.fromkeys(chain, end))
        return end


def _next(values: np.ndarray, state, least: float, absolute: bool) -> int | None:
    i, span = 0, 16
    while i < len(values):
        off = values[i : i + span] - state
        found = (np.abs(off) if absolute else off) >= least
        if found.any():
            return i + int(found.argmax())
        i, span = i + span, span * 2
    return None


def _usable(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values that aren't null or NaN, and their places."""
    values = pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(pc.is_valid(a).to_numpy(zero_copy_only=False) & (values == values))
    return values[at], at


def _passing(df: DataFrame, by: list[str], order: list[str], value: str, least: float, absolute: bool, out: str) -> DataFrame:
    spark = df.sparkSession
    df = df.drop(out)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "segments")
    df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, "_part").sortWithinPartitions(*by, *order)

    key = T.StructType([df.schema[c] for c in by])
    whole = value, least, absolute

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, least, absolute = whole
        before, first, last, part, one, state = None, None, None, None, True, None
        entered = Transition(least, absolute)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["_part"][0].as_py() if part is None else part
            runs, last = key_runs(batch, by, before)
            first = [batch[c][:1] for c in by] if first is None else first
            for i, j, new in runs:
                if new and before is None and i == 0:
                    new = False  # the task's first key, of which nothing is known yet
                if new:
                    one, state = False, None
                values, _ = _usable(batch[value][i:j])
                if one:
                    entered.add(values)
                else:
                    _, state = _far(values, state, least, absolute)
            before = last
        if part is not None:
            ends = [pa.StructArray.from_arrays(k, fields=[pa.field(c, a.type) for c, a in zip(by, k, strict=True)]) for k in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *ends, pa.array([one]), pa.array([json.dumps([entered.n, entered.above, entered.below, state])])], names=["_part", "_first", "_last", "_one", "_how"])

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, least, absolute = whole
        before, state = None, None
        for batch in batches:
            parts, states = [], []
            for i in range(batch.num_rows):
                first, last = batch["_first"][i : i + 1], batch["_last"][i : i + 1]
                goes_on = before is not None and not _changes([pa.concat_arrays([b, f]) for b, f in zip(before.flatten(), first.flatten(), strict=True)])[0]
                count, above, below, own = json.loads(batch["_how"][i].as_py())
                held = state if goes_on else None
                parts.append(batch["_part"][i].as_py())
                states.append(json.dumps(held))
                state, before = (Transition(least, absolute, count, above, below).end(held) if batch["_one"][i].as_py() else own), last
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(states, pa.string())], names=["_part", "_state"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, least, absolute = whole
        before, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = before is None
            runs, before = key_runs(batch, by, before)
            got = np.zeros(batch.num_rows, bool)
            for i, j, new in runs:
                if fresh and i == 0:
                    state = json.loads(batch["_state"][0].as_py())
                elif new:
                    state = None
                values, at = _usable(batch[value][i:j])
                hits, state = _far(values, state, least, absolute)
                got[i + at[hits]] = True
            yield batch.drop_columns(["_part", "_state"]).append_column(out, pa.array(got))

    how = dealt(ranged.select("_part", *dict.fromkeys([*by, *order, value]))).mapInArrow(edges, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_first", key), T.StructField("_last", key), T.StructField("_one", T.BooleanType()), T.StructField("_how", T.StringType())]))
    # A row for each task of the first pass.
    states = how.repartition(1).sortWithinPartitions("_part").mapInArrow(strung, "_part int, _state string")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])
    return dealt(ranged.join(F.broadcast(states), "_part").select(*df.columns, "_part", "_state")).mapInArrow(replayed, schema)


def triggered(df: DataFrame, by: list[str], order: list[str], value: str, least: float, out: str = "hit") -> DataFrame:
    """What windows.triggered gives, with the rows of one key in as many tasks as they need. Columns named _part or _state aren't allowed.
    What is kept of a task's first key is a number for each of its values that is above, or below, all before it in the task."""
    return _passing(df, by, order, value, least, True, out)


def cooled_down(df: DataFrame, by: list[str], order: list[str], at: str, gap: int, out: str = "let_through") -> DataFrame:
    """What windows.cooled_down gives, likewise."""
    return _passing(df, by, order, at, gap, False, out)
