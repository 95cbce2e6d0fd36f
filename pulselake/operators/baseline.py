"""Personal baselines, per-user normalisers and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import is_night

MIN_WINDOWS = 50


def _std(c):
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def baseline(windows: DataFrame, user: str = "user_id", ts: str = "ts", hr: str = "hr_mean", rmssd: str = "rmssd", sdnn: str = "sdnn", least: int = MIN_WINDOWS) -> DataFrame:
    """One row for each user with at least least windows. Resting figures come from the lowest tenth of positive heart
    rates (one at least); values of 0 and below are no measurements."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    rank = Window.partitionBy(user).orderBy(pos(hr).asc_nulls_last())
    n = F.count(pos(hr)).over(Window.partitionBy(user))
    w = windows.withColumn("_low", (F.row_number().over(rank) <= F.greatest(F.lit(1), F.ceil(n * 0.1))) & (F.col(hr) > 0)).withColumn("_night", is_night(F.col(ts)))
    rest, night = F.when(F.col("_low"), F.col(hr)), lambda c: F.when(F.col("_night"), pos(c))
    out = w.groupBy(user).agg(
        F.count(F.lit(1)).alias("sample_count"), F.coalesce(F.avg(rest), F.lit(0.0)).alias("resting_hr_mean"), _std(rest).alias("resting_hr_std"),
        F.coalesce(F.avg(night(hr)), F.avg(rest), F.lit(0.0)).alias("sleeping_hr_mean"), F.coalesce(F.avg(pos(rmssd)), F.lit(0.0)).alias("rmssd_mean"), _std(pos(rmssd)).alias("rmssd_std"),
        F.coalesce(F.avg(pos(sdnn)), F.lit(0.0)).alias("sdnn_mean"), _std(pos(sdnn)).alias("sdnn_std"), F.coalesce(F.avg(night(rmssd)), F.avg(pos(rmssd)), F.lit(0.0)).alias("nocturnal_rmssd_mean"),
    )
    return out.where(F.col("sample_count") >= least)


def anomalies(windows: DataFrame, base: DataFrame, user: str = "user_id", rmssd: str = "rmssd", hr: str = "hr_mean") -> DataFrame:
    """A row for each flag: (all of windows' columns, type, severity, z)."""
    j = windows.join(base.select(user, "rmssd_mean", "rmssd_std", "resting_hr_mean", "resting_hr_std"), user)
    low, high = F.try_divide(F.col(rmssd) - F.col("rmssd_mean"), "rmssd_std"), F.try_divide(F.col(hr) - F.col("resting_hr_mean"), "resting_hr_std")
    flag = lambda kind, z, bad, worst: F.when(bad, F.struct(F.lit(kind).alias("type"), F.when(worst, "high").otherwise("moderate").alias("severity"), z.alias("z")))
    flags = F.array_compact(F.array(flag("hrv_low", low, (F.col("rmssd_std") > 0) & (low < -2), low < -3), flag("hr_elevated", high, (F.col("resting_hr_std") > 0) & (high > 2), high > 3)))
    return j.select(*windows.columns, F.explode(flags).alias("_f")).select(*windows.columns, "_f.type", "_f.severity", "_f.z")


def normaliser(df: DataFrame, by: list[str], cols: list[str], least: int = 30) -> DataFrame:
    """(by, feature, mean, std): population figures of each feature's finite values; features with fewer than least
    values are left out."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_e")).select(*by, "_e.feature", "_e.x")
    ok = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    return ok.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).where(F.col("n") >= least)


def due(windows: DataFrame, baselines: DataFrame, as_of_ms: int, user: str = "user_id", hours: int = 24, least: int = MIN_WINDOWS) -> DataFrame:
    """(user, n): users whose newest baseline is older than so many hours, or who have none, and who have the windows for a new one."""
    n = windows.groupBy(user).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    newest = baselines.groupBy(user).agg(F.max("computed_at").alias("_at")).where(F.col("_at") >= as_of_ms - hours * 3_600_000)
    return n.join(newest.select(user), user, "left_anti")
