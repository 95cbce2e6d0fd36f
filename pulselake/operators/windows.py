"""Sequence operators over ordered groups: islands, normalisation, trends, stateful folds, anchored windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pulselake.functions.scalar import ratio


def _w(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """df with a number for each run of equal values."""
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(_w(by, order))) & (F.row_number().over(_w(by, order)) > 1), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn(out, F.sum("_new").over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def spans(df: DataFrame, by: list[str], start: str, value: str, tie: str, end: str | None = None) -> DataFrame:
    """Runs of one value as (by, value, start, end, n); a run ends where the next starts, the last at its own end."""
    runs = islands(df, by, [start, tie], value)
    last = F.max(end) if end else F.max(start)
    out = runs.groupBy(*by, "island").agg(F.first(value).alias(value), F.min(start).alias("span_start"), last.alias("_last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("span_end", F.coalesce(F.lead("span_start").over(_w(by, ["island"])), "_last")).drop("_last", "island")


def zscores(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Adds <col>_z: sample z-scores in each group; 0 where the deviation is 0 or undefined. One aggregation, which combines
    before its shuffle, joined back: a group of any size is never one task's."""
    g = df.groupBy(*by).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = _joined(df, g, by)
    return j.withColumns({f"{c}_z": ratio(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in cols}).drop(*[f"_{x}_{c}" for x in "ms" for c in cols])


def _joined(df: DataFrame, g: DataFrame, by: list[str]) -> DataFrame:
    """df with the figures of its group; null keys are a group too."""
    right = g.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in g.columns if c not in by])
    cond = None
    for c in by:
        same = df[c].eqNullSafe(right[f"_k_{c}"])
        cond = same if cond is None else cond & same
    return df.join(right, cond, "left").drop(*[f"_k_{c}" for c in by])


def robust_z(df: DataFrame, by: list[str], cols: list[str], iqr: tuple = ()) -> DataFrame:
    """Adds <col>_rz: distance from the median by 1.4826 times the median distance (1 where that is tiny); and for the
    columns in iqr <col>_iz: distance from the median by the interquartile range (1 where that is 0).

    Three scans: one aggregation gives medians and quartiles, a second the median distances and carries the first's
    figures along, and both are joined to the rows once.
    """
    every = list(dict.fromkeys([*cols, *iqr]))
    quartiles = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    med = df.groupBy(*by).agg(*[(F.percentile(c, quartiles) if c in iqr else F.array(F.lit(None).cast("double"), F.median(c))).alias(f"_q_{c}") for c in every])
    med = med.withColumns({f"_m_{c}": F.get(f"_q_{c}", F.lit(1)) for c in every} | {f"_s_{c}": F.get(f"_q_{c}", F.lit(2)) - F.get(f"_q_{c}", F.lit(0)) for c in iqr}).drop(*[f"_q_{c}" for c in every])
    carried = [*[f"_m_{c}" for c in every], *[f"_s_{c}" for c in iqr]]
    mad = _joined(df.select(*by, *every), med, by).groupBy(*by).agg(*[F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in cols], *[F.first(c).alias(c) for c in carried])
    out = _joined(df, mad, by)
    scale = lambda c: 1.4826 * F.when(F.col(f"_d_{c}") <= 1e-8, 1.0 / 1.4826).otherwise(F.col(f"_d_{c}"))
    new = {f"{c}_rz": (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in cols}
    new |= {f"{c}_iz": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in iqr}
    return out.withColumns(new).drop(*[f"_d_{c}" for c in cols], *carried)


def place_in_night(df: DataFrame, by: list[str], order: list[str], profile: str = "device") -> DataFrame:
    """Adds time_of_night from -1 to 1; a single row is 0 (device) or -1 (train)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.row_number().over(_w(by, order)) - 1
    return df.withColumn("time_of_night", F.when(n == 1, 0.0 if profile == "device" else -1.0).otherwise(-1.0 + 2.0 * F.try_divide(at, n - 1)))


def half_trend(df: DataFrame, by: list[str], order: list[str], value: str, margin: float, least: int, names: tuple[str, str, str]) -> DataFrame:
    """(by, n, first_avg, second_avg, trend): the second half's mean against the first's, oldest first."""
    up, down, flat = names
    w = df.withColumns({"_i": F.row_number().over(_w(by, order)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    g = w.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(first, F.col(value))).alias("first_avg"), F.avg(F.when(~first, F.col(value))).alias("second_avg"))
    d = F.col("second_avg") - F.col("first_avg")
    return g.withColumn("trend", F.when(F.col("n") < least, flat).when(d > margin, up).when(d < -margin, down).otherwise(flat))


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, rows: int, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(_w(by, order).rowsBetween(-(rows - 1), 0)))


def model_health(df: DataFrame, by: list[str], order: list[str], score: str, confidence: str, rows: int = 200, least: int = 20, unit: float = 1.0) -> DataFrame:
    """Adds samples, mean_confidence, low_rate, degenerate and drift over the last rows predictions. unit: what a confidence
    of 1 is in the column; whole hundredths add up without rounding."""
    w = _w(by, order).rowsBetween(-(rows - 1), 0)
    out = df.withColumns({"samples": F.count(F.lit(1)).over(w), "_c": F.avg(confidence).over(w), "_l": F.avg((F.col(confidence) < 0.5 * unit).cast("double")).over(w), "_v": F.var_pop(score).over(w)})
    ok = F.col("samples") >= least
    out = out.withColumns({"mean_confidence": F.when(ok, F.col("_c") / unit).otherwise(1.0), "low_rate": F.when(ok, F.col("_l")).otherwise(0.0), "degenerate": ok & (F.col("_v") < 1)})
    return out.withColumn("drift", F.col("degenerate") | (F.col("low_rate") > 0.5)).drop("_c", "_l", "_v")


def anchored_windows(df: DataFrame, by: list[str], at_ms: str, width_ms: int, step_ms: int) -> DataFrame:
    """Each row once for each sliding window that holds it; windows start at the group's first row, every step_ms, and
    only whole ones count. Adds win (number) and win_start."""
    first = df.groupBy(*by).agg(F.min(at_ms).alias("_t0"), F.max(at_ms).alias("_t1"))
    d = df.join(first, by).withColumn("_off", F.col(at_ms) - F.col("_t0"))
    low = F.greatest(F.lit(0), F.ceil((F.col("_off") - width_ms + 1) / step_ms).cast("long"))
    high = F.least(F.floor(F.col("_off") / step_ms), F.floor((F.col("_t1") - F.col("_t0") - width_ms) / step_ms)).cast("long")
    d = d.where(high >= low).withColumn("win", F.explode(F.sequence(low, high)))
    return d.withColumn("win_start", F.col("_t0") + F.col("win") * step_ms).drop("_t0", "_t1", "_off")


def majority(df: DataFrame, by: list[str], label: str, purity: float = 0.0) -> DataFrame:
    """(by, label, share): the commonest label of each group, the least of equals; groups below purity are left out."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    g = Window.partitionBy(*by)
    n = n.withColumn("share", F.col("_c") / F.sum("_c").over(g)).withColumn("_r", F.row_number().over(g.orderBy(F.desc("_c"), label)))
    return n.where((F.col("_r") == 1) & (F.col("share") >= purity)).drop("_c", "_r")


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has another key than the row before. Nulls are equal, as are NaNs; values are compared as they
    are, so that no key is rounded."""
    out = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        a, b = k[1:], k[:-1]
        if pa.types.is_nested(k.type):
            out |= np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
            continue
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(k.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def key_runs(batch: pa.RecordBatch, by: list[str], before: list[pa.Array] | None) -> tuple[list[tuple[int, int, bool]], list[pa.Array]]:
    """(begin, end, whether it is a new key) of each run of one key in batch, and the last row's key. before: the key of the row
    before the batch, if there is one."""
    n = batch.num_rows
    keys = [batch[c] for c in by]
    cut = np.flatnonzero(_changes(keys)) + 1
    starts, ends = [0, *cut.tolist()], [*cut.tolist(), n]
    goes_on = before is not None and not _changes([pa.concat_arrays([b, k[:1]]) for b, k in zip(before, keys, strict=True)])[0]
    return [(i, j, i > 0 or not goes_on) for i, j in zip(starts, ends, strict=True)], [k[n - 1 :] for k in keys]


def folded(df: DataFrame, by: list[str], order: list[str], cols: list[str], start: Callable[[], object], step: Callable, out: str, kind: T.DataType, gathered: bool = False) -> DataFrame:
    """df with a column out from a fold over the rows of each key in order. Partitions hold whole keys, sorted; rows are read batch
    by batch and only a state is carried on, so a key of any length needs the memory of a batch.

    start() gives a key's state; step(state, arrays) takes the Arrow arrays of cols for the next rows of a key and gives their
    values of out; it changes state in place. All other columns pass as they came. Null keys are one key, as are NaNs. A
    column of the name out is replaced. gathered: a window over the same keys has dealt out df already.
    """
    df = df.drop(out)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, before = key_runs(batch, by, before)
            arrays, values = [batch[c] for c in cols], []
            for i, j, new in runs:
                if new:
                    state = start()
                values.append(step(state, [a[i:j] for a in arrays]))
            yield batch.append_column(out, pa.array(np.concatenate(values)).cast(arrow))

    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    return (df if gathered else df.repartition(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def smoothed(df: DataFrame, by: list[str], order: list[str], cls: str, confidence: str, below: float = 0.6, out: str = "smoothed") -> DataFrame:
    """Adds out: classes with one-row islands of low confidence flipped to their neighbours' class, left to right; earlier flips
    count for later ones. A flip looks at the row before as it came out and at the row after as it came in, which a window
    function brings. Rows of null class or confidence stay as they are, and neighbours of null flip nothing."""
    w = Window.partitionBy(*by).orderBy(*order)
    kind = df.schema[cls].dataType
    # An island's class differs from the next row's; the fold only has to know whether the row before came out as the next came in.
    own = df.withColumns({"_next": F.lead(cls).over(w), "_weak": F.coalesce((F.col(confidence) < below) & (F.lead(cls).over(w) != F.col(cls)), F.lit(False))})

    def step(state: dict, arrays: list[pa.Array]) -> np.ndarray:
        classes, following, weak = arrays[0].to_pylist(), arrays[1].to_pylist(), arrays[2].to_pylist()
        last, flips = state.get("last"), []
        for c, n, island in zip(classes, following, weak, strict=True):
            flip = island and last is not None and last == n
            last = n if flip else c
            flips.append(flip)
        state["last"] = last
        return np.array(flips, bool)

    f = folded(own, by, order, [cls, "_next", "_weak"], dict, step, "_flip", T.BooleanType(), gathered=True)
    return f.withColumn(out, F.when(F.col("_flip"), F.col("_next")).otherwise(F.col(cls)).cast(kind)).drop("_next", "_weak", "_flip")


def _far(values: np.ndarray, last: float | None, least: float, absolute: bool) -> tuple[list[int], float | None]:
    """The rows at which values are at least so far from the last such row's, and the last one's value. NaNs never are."""
    hits, i, n = [], 0, len(values)
    while i < n:
        span = 16  # rows looked at together; wider the longer nothing is found
        while i < n:
            part = values[i : i + span]
            off = np.abs(part - last) if last is not None and absolute else part - last if last is not None else part
            found = off >= least if last is not None else part == part
            if found.any():
                i += int(found.argmax())
                break
            i, span = i + span, span * 2
        if i < n:
            hits.append(i)
            last = values[i].item()
            i += 1
    return hits, last


def _passing(df: DataFrame, by: list[str], order: list[str], value: str, least: float, absolute: bool, out: str) -> DataFrame:
    def step(state: dict, arrays: list[pa.Array]) -> np.ndarray:
        usable = pc.is_valid(arrays[0]).to_numpy(zero_copy_only=False)
        values = pc.fill_null(arrays[0], 0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(usable)
        hits, state["last"] = _far(values[at], state.get("last"), least, absolute)
        got = np.zeros(len(values), bool)
        got[at[hits]] = True
        return got

    return folded(df, by, order, [value], dict, step, out, T.BooleanType())


def triggered(df: DataFrame, by: list[str], order: list[str], value: str, least: float, out: str = "hit") -> DataFrame:
    """Adds out: whether a value is at least so far from the last one that triggered; the first triggers. Null and NaN values
    don't trigger and count for nothing."""
    return _passing(df, by, order, value, least, True, out)


def cooled_down(df: DataFrame, by: list[str], order: list[str], at: str, gap: int, out: str = "let_through") -> DataFrame:
    """Adds out: whether a row comes at least gap after the last one that was let through; the first is. Rows of null time aren't."""
    return _passing(df, by, order, at, gap, False, out)


def capped(df: DataFrame, by: list[str], order: list[str], rows: int) -> DataFrame:
    """The latest rows of each key, so many at most."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).drop("_r")


def trailing_days(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last days before as_of, the cutoff itself left out."""
    return df.where((F.col(ts) > as_of - F.make_interval(days=F.lit(days))) & (F.col(ts) <= as_of))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a maximum of structs instead of a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*").select(df.columns)
