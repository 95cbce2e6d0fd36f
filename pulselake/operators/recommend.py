"""Rule-driven recommendations: guarded candidates, recent ones left out, the best three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def rules() -> list[tuple[Column, str, str, float]]:
    """(condition, intervention, trigger, priority), in the order in which they are tried. Null inputs never fire.

    Fixed values: thresholds and priorities as the rules define them.
    """
    c, h = F.col, F.col("hour")
    stress, anxiety, progress = c("stress"), c("anxiety"), c("sun_progress")
    return [
        (stress >= 70, "breathing_box", "biometric", 0.95),
        (stress >= 70, "meditation_grounding", "biometric", 0.85),
        ((stress >= 50) & (stress < 70), "breathing_coherent", "biometric", 0.7),
        ((stress >= 50) & (stress < 70), "physical_walk", "biometric", 0.6),
        (anxiety >= 70, "meditation_grounding", "biometric", 0.9),
        (anxiety >= 70, "breathing_478", "biometric", 0.85),
        ((anxiety >= 70) & _on("anxiety_sustained"), "social_reach_out", "pattern", 0.8),
        ((anxiety >= 50) & (anxiety < 70), "journaling_expressive", "biometric", 0.6),
        (c("sleep_quality") < 50, "sleep_wind_down", "pattern", 0.7),
        (c("sleep_efficiency") < 0.75, "sleep_consistent", "pattern", 0.65),
        ((c("sleep_consistency") < 50) & _on("has_baseline"), "sleep_consistent", "pattern", 0.6),
        (c("sentiment") < -0.5, "journaling_expressive", "checkin", 0.75),
        (c("fatigue") > 0.5, "physical_stretch", "checkin", 0.5),
        (c("sadness") > 0.5, "social_reach_out", "checkin", 0.7),
        (h.between(20, 23) & (stress > 40), "sleep_wind_down", "schedule", 0.55),
        (h.between(6, 9), "journaling_gratitude", "schedule", 0.3),
        (_on("monotonous"), "explore_new_place", "pattern", 0.7),
        (c("diversity") < 20, "explore_nature", "pattern", 0.6),
        (_on("monotonous") & (stress >= 50), "explore_nature", "pattern", 0.8),
        ((progress < 0.5) & h.between(10, 14), "outdoor_sunlight", "pattern", 0.8),
        ((progress < 0.5) & ~h.between(10, 14) & (h < 15), "outdoor_walk_sunshine", "schedule", 0.6),
        ((c("sun_minutes") < 10) & (h >= 14), "outdoor_sunlight", "pattern", 0.75),
    ]


INPUTS = {"stress": "double", "anxiety": "double", "anxiety_sustained": "boolean", "sleep_quality": "double", "sleep_efficiency": "double", "sleep_consistency": "double", "has_baseline": "boolean", "sentiment": "double", "fatigue": "double", "sadness": "double", "hour": "int", "monotonous": "boolean", "diversity": "double", "sun_progress": "double", "sun_minutes": "double"}


def recommend(state: DataFrame, key: list[str], recent: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(key, rank, intervention, trigger, priority): each intervention once at its highest priority, without those in
    recent (key, intervention); earlier rules first among equals."""
    state = state.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in state.columns})
    made = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("intervention"), F.lit(t).alias("trigger"), F.lit(p).alias("priority"), F.lit(n).alias("_n"))) for n, (cond, i, t, p) in enumerate(rules())]))
    c = state.select(*key, F.explode(made).alias("_c")).select(*key, "_c.*")
    if recent is not None:
        c = c.join(recent, [*key, "intervention"], "left_anti")
    best = Window.partitionBy(*key, "intervention").orderBy(F.desc("priority"), "_n")
    c = c.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    first = c.withColumn("_first", F.col("_n"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("priority"), "_first")))
    return ranked.where(F.col("rank") <= k).select(*key, "rank", "intervention", "trigger", "priority")
