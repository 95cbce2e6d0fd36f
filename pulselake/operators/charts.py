"""Figures as they are drawn: points of a line, rows of a hypnogram, days of a week, and days in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import half_up

# Rows of a hypnogram from above, and the row of each stage that isn't its own.
HYPNOGRAM_ROWS = ("awake", "rem", "light", "deep")
ROW_OF = {"awake": "awake", "out_of_bed": "awake", "rem": "rem", "deep": "deep"}


def line_points(df: DataFrame, by: list[str], order: list[str], value: str, width: float, height: float, top: float = 100.0) -> DataFrame:
    """Adds x and y of each value in its series: evenly from 0 to width, and down from height by the share of top. A single point is
    at 0; a null value has no y."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumns({"x": F.coalesce(F.try_divide(i.cast("double"), (n - 1).cast("double")), F.lit(0.0)) * width, "y": height - F.col(value) / top * height})


def hypnogram_row(stage: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in ROW_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(named, stage), F.lit("light"))


def hypnogram(spans: DataFrame, night: list[str], start: str = "start_ms", end: str = "end_ms", stage: str = "stage", width: float = 300.0, height: float = 120.0, left: float = 0.0, pad: float = 6.0) -> DataFrame:
    """Adds row, x0, x1 and y of each stage: the night's span over the width, the middle of the stage's row over the height."""
    g = spans.groupBy(*night).agg(F.min(start).alias("_t0"), F.max(end).alias("_t1"))
    d = spans.join(g, night)
    at = lambda t: F.lit(left) + (F.col(t) - F.col("_t0")) / F.greatest(F.lit(1), F.col("_t1") - F.col("_t0")) * width
    row = hypnogram_row(F.col(stage))
    high = (height - 2 * pad) / len(HYPNOGRAM_ROWS)
    number = F.array_position(F.array(*map(F.lit, HYPNOGRAM_ROWS)), row) - 1
    return d.withColumns({"row": row, "x0": at(start), "x1": at(end), "y": pad + number * high + high / 2}).drop("_t0", "_t1")


def day_in_words(stress: Column) -> Column:
    """struct<mood, anxiety, heart_rate>: what a day's stress stands for."""
    mood = F.when(stress > 60, "Stressed").when(stress > 40, "Okay").otherwise("Good")
    return F.struct(mood.alias("mood"), half_up(F.round(stress * 0.8, 9)).cast("long").alias("anxiety"), (60 + half_up(F.round(stress * 0.2, 9))).cast("long").alias("heart_rate"))


def weekday_means(df: DataFrame, by: list[str], ts: str, value: str, as_of: Column, days: int = 7) -> DataFrame:
    """(by, weekday, value, n): the mean of each weekday (Monday: 0) over the last days before as_of, to a whole number; weekdays
    without values are 0, for every key that has any row."""
    back = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000)
    inside = (back >= 0) & (back < days) & F.col(value).isNotNull()
    g = df.groupBy(*by, F.weekday(ts).alias("weekday")).agg(F.avg(F.when(inside, F.col(value))).alias("_m"), F.count(F.when(inside, F.lit(1))).alias("_n"))
    slots = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    keys = [*by, "weekday"]
    right = g.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = slots[k].eqNullSafe(right[f"_r_{k}"])
        on = same if on is None else on & same
    j = slots.join(right, on, "left")
    return j.select(*keys, F.coalesce(half_up(F.round("_m", 9)), F.lit(0)).cast("long").alias("value"), F.coalesce("_n", F.lit(0)).alias("n"))


def without_subjects(df: DataFrame, subject: str, excluded: tuple[str, ...]) -> DataFrame:
    """Rows of all subjects but those excluded; rows of no subject stay."""
    return df.where(~F.coalesce(F.col(subject).isin(*excluded), F.lit(False))) if excluded else df
