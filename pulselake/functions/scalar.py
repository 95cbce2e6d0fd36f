"""Column expressions for scores, bands and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or default where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def argmax(values: Column) -> Column:
    """Place (from 0) of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def banded(x: Column, cuts: list[tuple[float, str]], top: str) -> Column:
    """The name of the first cut above x; top where there is none."""
    c = F.when(x < cuts[0][0], cuts[0][1])
    for bound, name in cuts[1:]:
        c = c.when(x < bound, name)
    return c.otherwise(top)


def stress_level(score: Column, threshold: float = 0.5) -> Column:
    t = threshold * 100
    return banded(score, [(t * 0.5, "low"), (t, "moderate"), (t + (100 - t) / 2, "elevated")], "high")


def anxiety_level(index: Column) -> Column:
    return F.when(index <= 20, "minimal").when(index <= 45, "mild").when(index <= 70, "moderate").otherwise("severe")


def focus_level(score: Column) -> Column:
    return banded(score, [(25, "scattered"), (50, "drifting"), (75, "steady")], "sharp")


def depression_level(score: Column) -> Column:
    return banded(score, [(30, "minimal"), (50, "mild"), (70, "moderate")], "high")


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.3, "positive").when(score >= -0.1, "neutral").when(score >= -0.5, "concerned").otherwise("distressed")


def questionnaire(answers: Column, cuts: list[tuple[int, str]], top: str) -> tuple[Column, Column]:
    """Sum of an array of answers and its severity (cuts are inclusive upper bounds)."""
    total = F.aggregate(answers, F.lit(0), lambda acc, v: acc + v)
    c = F.when(total <= cuts[0][0], cuts[0][1])
    for bound, name in cuts[1:]:
        c = c.when(total <= bound, name)
    return total, c.otherwise(top)


# Cuts of the questionnaires and ranges of the anxiety scales.
PHQ9 = ([(4, "minimal"), (9, "mild"), (14, "moderate"), (19, "moderately_severe")], "severe")
GAD7 = ([(4, "minimal"), (9, "mild"), (14, "moderate")], "severe")


def stai_index(stai: Column) -> Column:
    """A state-anxiety score (20 to 80) on a scale from 0 to 100."""
    return F.round((stai - 20) / 60.0 * 100, 2)


def bai_index(bai: Column) -> Column:
    """An anxiety inventory score (0 to 63) on a scale from 0 to 100."""
    return F.round(bai / 63.0 * 100, 2)


def age_midpoint(group: Column) -> Column:
    """The middle of an age group like '35-39'; null for other texts."""
    low, high = (F.regexp_extract(group, r"^\s*(\d+)\s*-\s*(\d+)\s*$", i) for i in (1, 2))
    return F.when(low != "", (low.try_cast("double") + high.try_cast("double")) / 2)


def is_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def watch_stress(hr: Column, resting: Column) -> Column:
    """Stress from the heart rate alone: 30 bpm above rest give 50."""
    return clamp((hr - resting) / 60.0 * 100, 0, 100)


def effectiveness(stress_before: Column, stress_after: Column, hrv_before: Column, hrv_after: Column) -> Column:
    """0.5, plus up to 0.25 for a fall of stress and up to 0.25 for a rise of variability, relative to before."""
    fall = ratio(stress_before - stress_after, stress_before) * 0.5
    rise = ratio(hrv_after - hrv_before, hrv_before) * 0.3
    return clamp(0.5 + clamp(fall, -0.25, 0.25) + clamp(rise, -0.25, 0.25), 0, 1)
