"""Night analysis from stage intervals: durations, latency, wake after onset, awakenings, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import clamp, half_up, ratio

# Fixed values of the quality score: ideals and weights.
IDEAL_SLEEP_MIN, MAX_IDEAL_SLEEP_MIN = 420, 540
IDEAL_DEEP, IDEAL_REM, IDEAL_EFFICIENCY = 0.20, 0.25, 0.85
IDEAL_LATENCY_MIN, MAX_LATENCY_MIN = 15, 30
WEIGHTS = {"efficiency": 0.25, "deep": 0.20, "rem": 0.15, "duration": 0.20, "fragmentation": 0.10, "latency": 0.10}


def is_sleep(stage: Column) -> Column:
    return ~stage.isin("awake", "out_of_bed", "unknown")


def nights(stages: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms", stage: str = "stage", tie: str = "start_ms") -> DataFrame:
    """One row for each night (by): raw minutes, counts, efficiency and fragmentation. One shuffle on the night's key
    serves the window and the aggregation."""
    order = Window.partitionBy(*by).orderBy(start, tie)
    s = stages.withColumns({"_min": (F.col(end) - F.col(start)) / 60000.0, "_sleep": is_sleep(F.col(stage))})
    s = s.withColumns({
        "_woke": F.lag("_sleep", 1, False).over(order) & ~F.col("_sleep"),
        "_after": F.coalesce(F.max(F.col("_sleep").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1,
    })
    of = lambda *names: F.coalesce(F.sum(F.when(F.col(stage).isin(*names), F.col("_min"))), F.lit(0.0))
    n = s.groupBy(*by).agg(
        F.min(start).alias("session_start"), F.max(end).alias("session_end"), of("awake", "out_of_bed").alias("awake_min"), of("light", "sleeping").alias("light_min"),
        of("deep").alias("deep_min"), of("rem").alias("rem_min"), F.coalesce(F.sum(F.when(F.col("_after") & (F.col(stage) == "awake"), F.col("_min"))), F.lit(0.0)).alias("waso_min"),
        F.count_if("_woke").alias("awakenings"), F.min(F.when(F.col("_sleep"), F.col(start))).alias("_onset"),
    )
    n = n.withColumns({
        "in_bed_min": (F.col("session_end") - F.col("session_start")) / 60000.0, "sleep_min": F.col("light_min") + F.col("deep_min") + F.col("rem_min"),
        "onset_min": F.coalesce(F.greatest(F.lit(0.0), (F.col("_onset") - F.col("session_start")) / 60000.0), F.lit(0.0)),
    }).drop("_onset")
    return n.withColumns({
        "efficiency": ratio(F.col("sleep_min"), F.col("in_bed_min")), "fragmentation": ratio(F.col("awakenings"), F.col("sleep_min") / 60),
        "deep_pct": ratio(F.col("deep_min"), F.col("sleep_min")), "rem_pct": ratio(F.col("rem_min"), F.col("sleep_min")), "light_pct": ratio(F.col("light_min"), F.col("sleep_min")),
    })


def quality(n: DataFrame) -> DataFrame:
    """Adds quality, six clamped parts by weight."""
    c = F.col
    length = F.when(c("sleep_min").between(IDEAL_SLEEP_MIN, MAX_IDEAL_SLEEP_MIN), 100.0).when(c("sleep_min") < IDEAL_SLEEP_MIN, clamp(c("sleep_min") / IDEAL_SLEEP_MIN * 100, 0, 100)).otherwise(clamp(100 - (c("sleep_min") - MAX_IDEAL_SLEEP_MIN) * 0.5, 50, 100))
    late = F.when(c("onset_min") <= IDEAL_LATENCY_MIN, 100.0).otherwise(clamp(100 - (c("onset_min") - IDEAL_LATENCY_MIN) / (MAX_LATENCY_MIN - IDEAL_LATENCY_MIN) * 100, 0, 100))
    parts = {
        "efficiency": clamp((c("efficiency") - 0.6) / (IDEAL_EFFICIENCY - 0.6) * 100, 0, 100), "deep": clamp(c("deep_pct") / IDEAL_DEEP * 100, 0, 100),
        "rem": clamp(c("rem_pct") / IDEAL_REM * 100, 0, 100), "duration": length, "latency": late, "fragmentation": clamp(100 - c("fragmentation") * 25, 0, 100),
    }
    return n.withColumn("quality", sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)))


def recovery(avg_hrv: Column, usual_hrv: Column) -> Column:
    """Score of a night's variability against the personal nightly mean, or population bands without one."""
    bands = F.when(avg_hrv >= 60, 85.0).when(avg_hrv >= 40, 70.0).when(avg_hrv >= 25, 50.0).otherwise(30.0)
    return F.when(F.coalesce(avg_hrv, F.lit(0.0)) == 0, 50.0).when(usual_hrv > 0, clamp(ratio(avg_hrv, usual_hrv) * 70, 0, 100)).otherwise(bands)


def consistency(bed_hour: Column, minutes: Column, usual_bed: Column, usual_minutes: Column) -> Column:
    """How near bedtime and duration are to the usual ones; hours before noon count as the next day's."""
    late = lambda h: F.when(h < 12, h + 24).otherwise(h)
    bed = clamp(100 - F.abs(late(bed_hour) - late(usual_bed)) * 20, 0, 100)
    length = clamp(100 - F.abs(minutes - usual_minutes) / 60 * 25, 0, 100)
    return F.when(F.coalesce(usual_minutes, F.lit(0.0)) == 0, 50.0).otherwise((bed + length) / 2)


def rounded(n: DataFrame) -> DataFrame:
    whole = ("in_bed_min", "sleep_min", "onset_min", "waso_min", "light_min", "deep_min", "rem_min", "awake_min", "quality")
    two = ("efficiency", "fragmentation", "deep_pct", "rem_pct", "light_pct")
    return n.withColumns({c: half_up(F.col(c)).cast("long") for c in whole if c in n.columns} | {c: half_up(F.col(c) * 100) / 100 for c in two if c in n.columns})
