"""The feature window: temperature, activity and the master row that joins them with heart-rate variability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import magnitude

# Activity classes by steps a minute (device) or mean magnitude in g (train), with the movement each stands for.
ACTIVITY_CODE = {"sedentary": 0, "walking": 1, "active": 2, "sleeping": 3}
WALKING_STEPS, SLEEPING_HR = 40, 55
WALKING_G, ACTIVE_G = 1.02, 1.1
MOVEMENT = {"sedentary": (1.0, 0.02), "walking": (1.05, 0.15), "active": (1.15, 0.30), "sleeping": (0.98, 0.01)}
#: A measured RMSSD replaces the computed one if they are farther apart than this.
RMSSD_APART = 20.0


def temperature(samples: DataFrame, by: list[str], ts_ms: str = "ts_ms", value: str = "temperature_c", profile: str = "device") -> DataFrame:
    """(by, temp_mean, temp_slope a minute, temp_std, temp_range); under two samples: 33.5 (device) or 0 (train), and zeros."""
    minute = F.col(ts_ms) / 60000.0
    few = F.count(value) < 2
    zero = lambda c: F.when(few, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    # The slope of the least squares line doesn't depend on where time starts, but its rounding does: count from the mean.
    slope = F.try_divide(F.covar_pop(value, minute), F.var_pop(minute))
    return samples.groupBy(*by).agg(
        F.when(few, 33.5 if profile == "device" else 0.0).otherwise(F.avg(value)).alias("temp_mean"), zero(slope).alias("temp_slope"),
        zero(F.stddev_samp(value)).alias("temp_std"), zero(F.max(value) - F.min(value)).alias("temp_range"))


def activity_from_steps(steps: Column, window_seconds: Column, hr_mean: Column) -> Column:
    """Activity class from steps a minute; hardly any steps and a low heart rate count as sleep."""
    rate = steps / (window_seconds / 60.0)
    still = rate < 1
    return F.when(still & (hr_mean > 0) & (hr_mean < SLEEPING_HR), "sleeping").when(still, "sedentary").when(rate < WALKING_STEPS, "walking").otherwise("active")


def activity_from_magnitude(mean_g: Column) -> Column:
    """Activity class from the mean magnitude of acceleration."""
    return F.when(mean_g < WALKING_G, "sedentary").when(mean_g < ACTIVE_G, "walking").otherwise("active")


def activity_code(activity: Column) -> Column:
    """The number of an activity class; 0 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIVITY_CODE.items() for x in kv]), activity), F.lit(0))


def with_movement(df: DataFrame, activity: str = "activity_type") -> DataFrame:
    """Adds accel_mean and accel_std, the movement that the class stands for."""
    of = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in MOVEMENT.items() for x in (k, v[i])]), F.col(activity))
    return df.withColumns({"accel_mean": of(0), "accel_std": of(1)})


def accelerometer(samples: DataFrame, by: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(by, accel_mean, accel_std, activity_type) from raw samples in g; zeros for under two."""
    m = magnitude(F.col(x), F.col(y), F.col(z))
    g = samples.groupBy(*by).agg(F.count(m).alias("_n"), F.avg(m).alias("accel_mean"), F.stddev_samp(m).alias("accel_std"))
    few = F.col("_n") < 2
    g = g.withColumns({"activity_type": F.when(few, "sedentary").otherwise(activity_from_magnitude(F.col("accel_mean")))})
    return g.withColumns({c: F.when(few, 0.0).otherwise(F.col(c)) for c in ("accel_mean", "accel_std")}).drop("_n")


def master(hrv: DataFrame, by: list[str], temp: DataFrame, steps: DataFrame, measured: DataFrame, window_seconds: int) -> DataFrame:
    """One row for each window (by): variability figures, with temperature (temp_*), steps (step_count), a directly measured
    rmssd (direct_rmssd) where there is one, the activity class and its movement. All sides share the key, so their
    shuffles are the same."""
    j = hrv.join(temp, by, "left").join(steps.select(*by, "step_count"), by, "left").join(measured.select(*by, "direct_rmssd"), by, "left")
    j = j.withColumns({"temp_mean": F.coalesce("temp_mean", F.lit(33.5)), **{c: F.coalesce(c, F.lit(0.0)) for c in ("temp_slope", "temp_std", "temp_range")}, "step_count": F.coalesce("step_count", F.lit(0.0))})
    apart = F.abs(F.col("rmssd") - F.col("direct_rmssd")) > RMSSD_APART
    j = j.withColumns({"rmssd": F.when(apart, F.col("direct_rmssd")).otherwise(F.col("rmssd")), "window_seconds": F.lit(window_seconds)})
    j = j.withColumn("activity_type", activity_from_steps(F.col("step_count"), F.col("window_seconds"), F.col("hr_mean")))
    return with_movement(j.drop("direct_rmssd"))


def complete(windows: DataFrame, series: DataFrame, by: list[str]) -> DataFrame:
    """master's windows with the spectral and non-linear figures of the same windows (hrv.series_features); where a window has too few
    beats for those, the figures of an empty series."""
    empty = {"vlf": 0.0, "lf": 0.0, "hf": 0.0, "lf_hf": 0.0, "total_power": 0.0, "lf_norm": 50.0, "hf_norm": 50.0, "sampen": 0.0, "dfa_alpha1": 0.0}
    return windows.join(series, by, "left").na.fill(empty)


def usable_signal() -> Column:
    """Whether a window carries a usable heart signal."""
    return (F.col("rmssd") > 0) & (F.col("mean_rr") > 0) & F.col("hr_mean").between(30, 220)


def covered(df: DataFrame, by: list[str], expected: int, share: float = 0.6, least: int = 0) -> DataFrame:
    """Rows of the groups that hold at least share of the expected samples, and least in any case."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(least, share * expected))
    return df.join(n.select(*by), by, "left_semi")


def sampling_rate(df: DataFrame, by: list[str], t_seconds: str) -> DataFrame:
    """(by, n, rate): samples over the time they span; null where they span none."""
    t = F.col(t_seconds)
    return df.groupBy(*by).agg(F.count(t).alias("n"), F.try_divide(F.count(t).cast("double"), (F.max(t) - F.min(t)).cast("double")).alias("rate"))


def repaired(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and infinities become 0; n_repaired says how many of the row's values did."""
    bad = {c: F.isnan(c) | (F.abs(c) == float("inf")) for c in cols}
    n = sum((F.coalesce(b, F.lit(False)).cast("int") for b in bad.values()), F.lit(0))
    return df.withColumns({"n_repaired": n, **{c: F.when(b, 0.0).otherwise(F.col(c)) for c, b in bad.items()}})


def valid_rows(df: DataFrame, label: str, labels: list, cols: list[str]) -> DataFrame:
    """Rows with a label of labels and finite values in cols."""
    ok = F.col(label).isin(labels)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Feature sets with different columns, one below the other; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
