"""Nights as a whole: personal sleep figures, heart figures of a night, recovery and consistency, epochs and staging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import half_up
from pulselake.operators.sleep import consistency, recovery
from pulselake.operators.windows import islands

# Classes of the staging model, epochs of one of its windows, seconds of an epoch.
STAGES = ("awake", "light", "deep", "rem")
SEQUENCE, EPOCH_SECONDS = 41, 30
HEART_WINDOW_MS = 120_000
STILL_G = 0.02
FOUR_TO_THREE = {0: 0, 1: 1, 2: 1, 3: 2}


def clock_hours(ms: Column) -> Column:
    """Hours since midnight (UTC) of a time in milliseconds, to the minute."""
    return F.floor(F.pmod(ms, F.lit(86_400_000)) / 60_000) / 60.0


def sleep_baseline(nights: DataFrame, user: list[str]) -> DataFrame:
    """Typical bedtime, wake hour and averages of each user's nights. Bedtimes before noon count as after midnight."""
    bed = clock_hours(F.col("session_start"))
    late = F.avg(F.when(bed < 12, bed + 24).otherwise(bed))
    mean = lambda c: F.avg(c)
    return nights.groupBy(*user).agg(
        F.count(F.lit(1)).alias("n_nights"), F.when(late >= 24, late - 24).otherwise(late).alias("typical_bed_hour"), F.avg(clock_hours(F.col("session_end"))).alias("typical_wake_hour"),
        mean("sleep_min").alias("usual_sleep_min"), mean("efficiency").alias("usual_efficiency"), mean("quality").alias("usual_quality"), mean("deep_pct").alias("usual_deep_pct"), mean("rem_pct").alias("usual_rem_pct"))


def night_heart(samples: DataFrame, by: list[str], bpm: str = "bpm", rmssd: str = "rmssd", order: list[str] | None = None) -> DataFrame:
    """(by, avg_hr, min_hr, avg_hrv, max_hrv) over positive values; 0 where there are none. Averages are whole numbers. Sums run in
    the order given, so that an average at a half doesn't depend on how rows were dealt; without one, in any order."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    sums = {"_bpm": F.sum(pos(bpm)), "_rmssd": F.sum(pos(rmssd))}
    if order:
        so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        samples = samples.withColumns({c: s.over(so_far) for c, s in sums.items()})
        sums = {c: F.max_by(c, F.struct(*order)) for c in sums}
    g = samples.groupBy(*by).agg(*[s.alias(c) for c, s in sums.items()], F.count(pos(bpm)).alias("_n_bpm"), F.count(pos(rmssd)).alias("_n_rmssd"),
                                 F.coalesce(F.min(pos(bpm)), F.lit(0.0)).alias("min_hr"), F.coalesce(F.max(pos(rmssd)), F.lit(0.0)).alias("max_hrv"))
    whole = lambda c: half_up(F.coalesce(F.try_divide(F.col(c), F.col(f"_n{c}")), F.lit(0.0))).cast("long")
    return g.select(*by, whole("_bpm").alias("avg_hr"), "min_hr", whole("_rmssd").alias("avg_hrv"), "max_hrv")


def analysed(nights: DataFrame, user: list[str], heart: DataFrame, night: list[str], usual: DataFrame) -> DataFrame:
    """nights with heart figures, recovery and consistency. usual: (user, typical_bed_hour, usual_sleep_min, nocturnal_rmssd_mean)."""
    j = nights.join(heart, [*user, *night], "left").na.fill(0, ["avg_hr", "min_hr", "avg_hrv", "max_hrv"])
    j = j.join(usual.select(*user, "typical_bed_hour", "usual_sleep_min", "nocturnal_rmssd_mean"), user, "left")
    length = (F.col("session_end") - F.col("session_start")) / 60000.0
    out = j.withColumns({
        "recovery": half_up(recovery(F.col("avg_hrv"), F.coalesce("nocturnal_rmssd_mean", F.lit(0.0)))).cast("long"),
        "consistency": half_up(F.round(consistency(clock_hours(F.col("session_start")), length, F.col("typical_bed_hour"), F.col("usual_sleep_min")), 9)).cast("long"),
    })
    return out.drop("typical_bed_hour", "usual_sleep_min", "nocturnal_rmssd_mean")


def previous_delta(epochs: DataFrame, by: list[str], number: str, mean: str, out: str = "hr_delta_prev") -> DataFrame:
    """Adds the change of mean from the epoch just before; 0 for the first one and after a gap. number counts epochs, so
    that an epoch without samples (which has no row, or a null mean) is a gap; null means are left out."""
    e = epochs.where(F.col(mean).isNotNull())
    w = Window.partitionBy(*by).orderBy(number)
    follows = F.lag(number).over(w) == F.col(number) - 1
    return e.withColumn(out, F.when(follows, F.col(mean) - F.lag(mean).over(w)).otherwise(0.0))


def epoch_motion(samples: DataFrame, by: list[str], epoch: str, at: str, g: str, profile: str = "device") -> DataFrame:
    """(by, epoch, act_count, act_max, act_std, and for train immobility): sums, maxima and stillness of successive
    differences of magnitude within each epoch, samples of one time by their value; zeros for a single sample."""
    d = F.abs(F.col(g) - F.lag(g).over(Window.partitionBy(*by, epoch).orderBy(at, g)))
    s = samples.withColumn("_d", d).groupBy(*by, epoch).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("act_count"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("act_max"), F.when(F.count(g) > 1, F.stddev_pop(g)).otherwise(0.0).alias("act_std"), F.coalesce(F.avg((F.col("_d") < STILL_G).cast("double")), F.lit(0.0)).alias("immobility"))
    return s if profile == "train" else s.drop("immobility")


def epoch_heart(samples: DataFrame, by: list[str], start_ms: Column, at: str, bpm: str) -> DataFrame:
    """(by, epoch, hr_mean, hr_std, hr_min, hr_max, hr_range, hr_sdsd): each sample counts in the epochs whose centre is
    within two minutes; start_ms is when epoch 0 begins. hr_sdsd is the deviation of successive differences."""
    step = EPOCH_SECONDS * 1000
    first = F.ceil((F.col(at) - start_ms - HEART_WINDOW_MS - step / 2 + 1) / step)
    last = F.floor((F.col(at) - start_ms + HEART_WINDOW_MS - step / 2) / step)
    s = samples.withColumn("epoch", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), F.greatest(F.lit(0), last).cast("long"))))
    s = s.withColumn("_d", F.col(bpm) - F.lag(bpm).over(Window.partitionBy(*by, "epoch").orderBy(at, bpm)))
    return s.groupBy(*by, "epoch").agg(
        F.avg(bpm).alias("hr_mean"), F.stddev_pop(bpm).alias("hr_std"), F.min(bpm).alias("hr_min"), F.max(bpm).alias("hr_max"), (F.max(bpm) - F.min(bpm)).alias("hr_range"),
        F.when(F.count(bpm) > 2, F.stddev_pop("_d")).otherwise(0.0).alias("hr_sdsd"))


def sequence_windows(epochs: DataFrame, night: list[str], number: str, features: str, length: int = SEQUENCE, stride: int | None = None) -> DataFrame:
    """(night, win, first, n, x): windows of length epochs, each an array of feature arrays. Without a stride, windows are
    disjoint and the last is filled up with its final epoch; with one, only whole windows count. number runs from 0."""
    if stride is None:
        dealt = epochs.withColumn("win", F.floor(F.col(number) / length).cast("long"))
        start = F.col("win") * length
    else:
        low = F.greatest(F.lit(0), F.ceil((F.col(number) - length + 1) / stride)).cast("long")
        dealt = epochs.withColumn("win", F.explode(F.sequence(low, F.floor(F.col(number) / stride).cast("long"))))
        start = F.col("win") * stride
    g = dealt.groupBy(*night, "win").agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), F.col(features).alias("x")))).alias("_s"), F.count(F.lit(1)).cast("int").alias("n"))
    x = F.transform("_s", lambda e: e["x"])
    if stride is None:
        x = F.concat(x, F.array_repeat(F.element_at(x, -1), F.greatest(F.lit(0), F.lit(length) - F.col("n"))))
    else:
        g = g.where(F.col("n") == length)
    return g.select(*night, "win", start.cast("long").alias("first"), "n", x.alias("x"))


def stage_night(windows: DataFrame, night: list[str], logits: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(night, epoch, class, stage, confidence, probs) of sequence windows, by a model that maps an array (windows,
    length, features) to (windows, length, classes). Windows go to it in Arrow batches; padding gives no rows."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields if f.name in night)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack([np.stack([np.asarray(e, float) for e in w]) for w in pdf["x"]])
            z = logits(x)
            e = np.exp(z - z.max(axis=2, keepdims=True))
            p = e / e.sum(axis=2, keepdims=True)
            n = pdf["n"].to_numpy()
            at = np.repeat(np.arange(len(pdf)), n)
            i = np.concatenate([np.arange(k) for k in n])
            cls = p[at, i].argmax(axis=1)
            out = pdf[night].iloc[at].reset_index(drop=True)
            out["epoch"], out["class"], out["stage"] = pdf["first"].to_numpy()[at] + i, cls.astype(np.int32), [STAGES[c] for c in cls]
            out["confidence"], out["probs"] = p[at, i, cls], list(p[at, i])
            yield out

    return windows.select(*night, "first", "n", "x").mapInPandas(run, f"{fields}, epoch long, class int, stage string, confidence double, probs array<double>")


def night_confidence(staged: DataFrame, night: list[str]) -> DataFrame:
    return staged.groupBy(*night).agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_epochs"))


def recording_summary(staged: DataFrame, by: list[str], night: str, cls: str) -> DataFrame:
    """(by, nights, least, median and most epochs a night, share of each class)."""
    n = staged.groupBy(*by, night).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(cls) == i).alias(f"c{i}") for i in range(len(STAGES))])
    total = F.sum("n")
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("nights"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), *[(F.sum(f"c{i}") / total).alias(f"share_{s}") for i, s in enumerate(STAGES)])


def merged_classes(cls: Column, to: dict[int, int] = FOUR_TO_THREE) -> Column:
    """Four classes as three: light and deep become one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), cls)


def flat_epochs(samples: DataFrame, by: list[str], order: str, value: str, least_std: float = 0.01, most_flat: float = 0.3) -> DataFrame:
    """(by, std, flat_share, valid): epochs whose signal hardly varies, or stands still too often, aren't valid."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))
    g = samples.withColumn("_f", (d < 1e-6).cast("int")).groupBy(*by).agg(F.stddev_pop(value).alias("std"), (F.coalesce(F.sum("_f"), F.lit(0)) / F.count(F.lit(1))).alias("flat_share"))
    return g.withColumn("valid", (F.col("std") >= least_std) & (F.col("flat_share") < most_flat))


def auxiliary(samples: DataFrame, by: list[str], order: str, hr: str, g: str, temp: str) -> DataFrame:
    """(by, hr_mean, hr_std, acc_mean, acc_std, temp_mean, temp_slope): the six side features of an epoch; the slope is per sample."""
    i = (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return samples.withColumn("_i", i).groupBy(*by).agg(
        zero(F.avg(hr)).alias("hr_mean"), zero(F.stddev_pop(hr)).alias("hr_std"), zero(F.avg(g)).alias("acc_mean"), zero(F.stddev_pop(g)).alias("acc_std"), zero(F.avg(temp)).alias("temp_mean"),
        zero(F.try_divide(F.covar_pop(temp, "_i"), F.var_pop("_i"))).alias("temp_slope"))


def intraday(rows: DataFrame, ts: str, day: Column, value: str) -> DataFrame:
    """(at, value) of one day in order of time, at as HH:mm."""
    return rows.where(F.to_date(ts) == day).select(F.date_format(ts, "HH:mm").alias("at"), value, ts).orderBy(ts).drop(ts)


def sleep_grid(nights: DataFrame, user: list[str], day: str, value: str, as_of: Column, weeks: int = 4) -> DataFrame:
    """(user, week, d0..d6): the last weeks as a grid, week 0 the latest."""
    back = F.datediff(as_of, F.to_date(day))
    g = nights.withColumns({"_b": back}).where((F.col("_b") >= 0) & (F.col("_b") < 7 * weeks)).withColumns({"week": F.floor(F.col("_b") / 7).cast("int"), "_d": F.pmod("_b", F.lit(7))})
    return g.groupBy(*user, "week").agg(*[F.max(F.when(F.col("_d") == i, F.col(value))).alias(f"d{i}") for i in range(7)])


def spans_of_stages(staged: DataFrame, night: list[str], start_ms: str, seconds: int = EPOCH_SECONDS) -> DataFrame:
    """(night, stage, span_start, span_end): runs of one stage; a run ends where the next begins, the last after its epoch."""
    runs = islands(staged, night, ["epoch"], "stage")
    g = runs.groupBy(*night, "island").agg(F.first("stage").alias("stage"), F.min(start_ms).alias("span_start"), (F.max(start_ms) + seconds * 1000).alias("_end"))
    w = Window.partitionBy(*night).orderBy("island")
    return g.withColumn("span_end", F.coalesce(F.lead("span_start").over(w), F.col("_end"))).drop("_end", "island")
