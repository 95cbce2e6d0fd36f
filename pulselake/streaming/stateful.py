"""Structured Streaming operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulselake.sources import keyed


def tumbling(stream: DataFrame, by: list[str], ts: str, value: str, width: str = "30 seconds", late: str = "105 seconds") -> DataFrame:
    """Mean, deviation, extremes and count of each key's epochs. An epoch closes when the watermark passes its end; its
    state is dropped then, and later samples of it are late."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w"))
    out = w.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return out.select(*by, F.col("w.start").alias("epoch_start"), F.col("w.end").alias("epoch_end"), "mean", "std", "low", "high", "n")


def trailing(stream: DataFrame, by: list[str], ts: str, value: str, width: str = "5 minutes", step: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Hopping means over the last width, every step."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width, step).alias("w"))
    return w.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(*by, F.col("w.end").alias("at"), "mean", "n")


def sessions(stream: DataFrame, by: list[str], ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of records less than gap apart, with their ends and counts; emitted when they can't grow any more."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_a_day(stream: DataFrame, by: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first record that arrives of each key and UTC day."""
    return stream.withColumn("_day", F.date_trunc("day", ts)).withWatermark("_day", late).dropDuplicates([*by, "_day"]).drop("_day")


def heart_epochs(stream: DataFrame, by: list[str], ts: str, bpm: str, seconds: int = 30, reach: int = 120, late: str = "210 seconds") -> DataFrame:
    """Heart figures of each epoch over the samples within reach of its centre: every sample goes to the epochs it reaches.
    The watermark runs on the epochs' starts, of which the last lies reach - 15 s ahead of the sample, so an epoch closes
    when samples have come to 135 s after its start. Epochs without samples don't come out."""
    t = F.unix_micros(ts) / 1e6
    first, last = F.ceil((t - reach - seconds / 2) / seconds), F.floor((t + reach - seconds / 2) / seconds)
    inside = F.when((t - reach - seconds / 2) == first * seconds, first + 1).otherwise(first)  # samples end before centre + reach
    e = stream.withColumn("_e", F.explode(F.sequence(inside.cast("long"), last.cast("long")))).withColumn("epoch_start", F.timestamp_seconds(F.col("_e") * seconds))
    w = e.withWatermark("epoch_start", late).groupBy(*by, F.window("epoch_start", f"{seconds} seconds").alias("w"))
    out = w.agg(F.avg(bpm).alias("hr_mean"), F.stddev_pop(bpm).alias("hr_std"), F.min(bpm).alias("hr_min"), F.max(bpm).alias("hr_max"), F.count(bpm).alias("n"))
    return out.select(*by, F.col("w.start").alias("epoch_start"), "hr_mean", "hr_std", "hr_min", "hr_max", "n")


def magnitudes(stream: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds g, the size of an acceleration."""
    return stream.withColumn("g", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z)))


def _fold(stream: DataFrame, keys: list[str], ms: str, value: str, tie: str, step, state: str, more: str = "") -> DataFrame:
    """A fold over each key's records: step(last state or None, ms, value) gives (state, what to emit or None).

    State is a small record for each key and is kept: it grows with the keys, not with the stream. (A processing-time
    timeout would keep an availableNow query running for ever.) Records of a micro-batch are taken in order of time;
    across micro-batches in order of arrival. What is emitted is the record, with the columns in more. Records without a
    time or a value are left out; null keys are a key. Keys are numbers, strings, booleans or dates.
    """
    cols = [*keys, ms, value, tie]
    given = T.StructType([stream.schema[c] for c in dict.fromkeys(cols)])
    extra = T.StructType.fromDDL(more) if more else T.StructType([])
    names = extra.names
    fields = T.StructType([T.StructField("_row", T.StringType()), *extra.fields])

    def run(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(group.get) if group.exists else None
        rows = pd.concat(list(frames)).sort_values(["_ms", "_tie"], kind="stable")
        kept, extras = [], []
        for i, (t, v) in enumerate(zip(rows["_ms"], rows["_value"], strict=True)):
            last, out = step(last, int(t), float(v))
            if out is not None:
                kept.append(i)
                extras.append(out)
        if last is not None:
            group.update(last)
        got = rows.iloc[kept][["_row"]].reset_index(drop=True)
        for j, n in enumerate(names):
            got[n] = [x[j] for x in extras]
        yield got

    # Keys and records travel as JSON: as columns of pandas, long numbers would be rounded next to nulls.
    rows = stream.where(F.col(ms).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.to_json(F.struct(*keys)).alias("_key"), F.col(ms).cast("long").alias("_ms"), F.col(value).cast("double").alias("_value"), F.col(tie).alias("_tie"), F.to_json(F.struct(*given.names)).alias("_row"))
    out = rows.groupBy("_key").applyInPandasWithState(run, fields, state, "append", GroupStateTimeout.NoTimeout)
    return out.select(F.from_json("_row", given).alias("_r"), *names).select("_r.*", *names)


def _passing(passes):
    def step(last, t, v):
        return ((t, v), ()) if passes(last, t, v) else (last, None)

    return step


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def throttled(stream: DataFrame, key: str | list[str], ms: str, value: str, tie: str, gap_ms: int = 60_000) -> DataFrame:
    """Records at least gap_ms after the last one that was kept."""
    return _fold(stream, _keys(key), ms, value, tie, _passing(lambda last, t, v: last is None or t - last[0] >= gap_ms), "last_ms long, last_value double")


def cooled_down(stream: DataFrame, user: str, kind: str, ms: str, value: str, tie: str, gap_ms: int = 1_800_000) -> DataFrame:
    """Alerts at least gap_ms after the last one of the same user and kind that was let through."""
    return throttled(stream, [user, kind], ms, value, tie, gap_ms)


def triggered(stream: DataFrame, key: str | list[str], ms: str, value: str, tie: str, least: float = 7.0) -> DataFrame:
    """Records whose value is at least so far from the last that triggered."""
    return _fold(stream, _keys(key), ms, value, tie, _passing(lambda last, t, v: last is None or abs(v - last[1]) >= least), "last_ms long, last_value double")


def deltas(stream: DataFrame, key: str | list[str], ms: str, value: str, tie: str, width_ms: int = 30_000) -> DataFrame:
    """Adds delta: the change from the epoch just before; 0 for the first and after a gap (an epoch that didn't come)."""

    def step(last, t, v):
        return (t, v), ((v - last[1] if last is not None and t - last[0] == width_ms else 0.0),)

    return _fold(stream, _keys(key), ms, value, tie, step, "last_ms long, last_value double", "delta double")


def smoothed_scores(stream: DataFrame, key: str | list[str], ms: str, value: str, tie: str, rows: int = 24) -> DataFrame:
    """Adds smoothed: the mean of each key's last rows values, to a whole number. State is those values, so it is bounded."""

    def step(last, t, v):
        recent = [*(list(last[0]) if last is not None else []), v][-rows:]
        return (recent,), (float(int(sum(recent) / len(recent) + 0.5)),)

    return _fold(stream, _keys(key), ms, value, tie, step, "recent array<double>", "smoothed double")


def upsert_latest(stream: DataFrame, path: str, keys: list[str], order: str, part: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in Parquet partitions, on whatever partition its rows come (see keyed.merge). Every
    micro-batch rewrites the partitions that its keys are in; run again after a failure, it changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: keyed.merge(path, batch, keys, order, part)).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()
