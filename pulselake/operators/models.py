"""Model entry points: gates, personal normalisation, tree scores, fallbacks, confidence, bands and what drove a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import anxiety_level, clamp, depression_level, focus_level, half_up, stress_level
from pulselake.operators.features import usable_signal
from pulselake.operators.hrv import rule_anxiety, rule_focus, rule_stress
from pulselake.operators.scoring import by_deviation, normalise, raw_value, score_trees, tree_sum

# Usual ranges of six signals, the side that is bad, and their names.
NORMAL_RANGES = {
    "hr_mean": (60, 85, "high", "Heart Rate"), "hr_std": (2, 12, "high", "Heart Rate Variability"), "rmssd": (30, 200, "low", "HRV (RMSSD)"),
    "sdnn": (40, 200, "low", "HRV (SDNN)"), "sampen": (1.2, 3.0, "low", "Mental Complexity"), "pnn50": (10, 100, "low", "Parasympathetic Tone"),
}
MIN_AGE_WINDOWS, FULL_AGE_WINDOWS = 10, 60


def confidence() -> Column:
    """0.9, less for an odd heart rate, for no variability and for no temperature; from 0.1 to 1."""
    c = F.lit(0.9) - F.when((F.col("hr_mean") < 40) | (F.col("hr_mean") > 150), 0.3).otherwise(0.0)
    c = c - F.when(F.col("rmssd") == 0, 0.4).otherwise(0.0) - F.when(F.col("temp_mean") == 0, 0.1).otherwise(0.0)
    return clamp(c, 0.1, 1)


#: Which column of a user's baseline is the reference point of which feature.
PERSONAL = {"rmssd": "rmssd_mean", "sdnn": "sdnn_mean", "hr_mean": "resting_hr_mean"}


def contributors(model: dict, k: int = 3, personal: tuple[str, ...] = ()) -> Column:
    """array<struct<feature, impact, direction>>: the k most important features that have a value (equal importances in the
    model's order); impact is the share of all importances; direction says on which side of the reference point: the user's own
    baseline where its column is among personal and not null, else the training mean, else the value itself."""
    imp, mean = model.get("importances", {}), model["normalization"]["mean"]
    total = sum(imp.get(f, 0.0) for f in model["features"]) or 1.0
    ranked = sorted((f for f in model["features"] if imp.get(f, 0.0) > 0), key=lambda f: -imp[f])

    def reference(f: str) -> Column:
        own = [F.col(PERSONAL[f])] if PERSONAL.get(f) in personal else []
        return F.coalesce(*own, F.lit(float(mean[f])) if f in mean else F.col(f))

    rows = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("feature"), F.lit(imp[f] / total).alias("impact"), F.when(F.col(f) >= reference(f), "high").otherwise("low").alias("direction"))) for f in ranked]
    return F.slice(F.array_compact(F.array(*rows)), 1, k)


def elevated(k: int = 4) -> Column:
    """array<struct<severity, feature, label, value, direction>>: signals outside their usual range, the worst first."""
    found = []
    for f, (low, high, bad, label) in NORMAL_RANGES.items():
        over = (F.col(f) - high if bad == "high" else low - F.col(f)) / float(high - low)
        found.append(F.when(over > 0, F.struct((-over).alias("_s"), F.lit(f).alias("feature"), F.lit(label).alias("label"), F.col(f).cast("double").alias("value"), F.lit(bad).alias("direction"))))
    worst = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, k)
    return F.transform(worst, lambda x: F.struct((-x["_s"]).alias("severity"), x["feature"], x["label"], x["value"], x["direction"]))


def predict_stress(windows: DataFrame, key: list[str], model: dict | None, stats: DataFrame | None = None, user: list[str] | None = None) -> DataFrame:
    """(key, stress_score, stress_level, is_stressed, confidence, contributors). Without a model (confidence 0.6), or
    for windows without a usable signal (0.3), fixed rules score; else the trees, on z-scores of the user's own figures (stats:
    user, feature, mean, std) or the model's. Contributors are above or below the user's baseline where windows carry its
    columns (PERSONAL)."""
    rules = rule_stress(windows).withColumnRenamed("stress_score", "_rule")
    none = F.array().cast("array<struct<feature:string,impact:double,direction:string>>")
    if model is None:
        return rules.select(*key, F.col("_rule").alias("stress_score"), "stress_level", (F.col("_rule") >= 50).alias("is_stressed"), F.lit(0.6).alias("confidence"), none.alias("contributors"))
    raw = rules.withColumns({"_ok": F.coalesce(usable_signal(), F.lit(False)), "_conf": confidence(), "_why": contributors(model, personal=tuple(windows.columns))})
    z = _z(raw, model, stats, user)
    z = score_trees(z, model, "_p", "yes")
    threshold = float(model.get("decisionThreshold", 0.5))
    s = F.when(F.col("_ok"), half_up(F.round(F.col("_p") * 100, 9)).cast("double")).otherwise(F.col("_rule"))
    return z.select(
        *key, s.alias("stress_score"), F.when(F.col("_ok"), stress_level(s, threshold)).otherwise(stress_level(s)).alias("stress_level"),
        F.when(F.col("_ok"), F.col("_p") >= threshold).otherwise(s >= 50).alias("is_stressed"),
        F.when(F.col("_ok"), F.col("_conf")).otherwise(0.3).alias("confidence"), F.when(F.col("_ok"), F.col("_why")).otherwise(none).alias("contributors"))


def _z(df: DataFrame, model: dict, stats: DataFrame | None, user: list[str] | None) -> DataFrame:
    if stats is not None:
        return normalise(df, stats, user, model)
    mean, std = model["normalization"]["mean"], model["normalization"]["std"]
    return df.withColumns({f: by_deviation(raw_value(f), F.lit(float(mean.get(f, 0))), F.lit(float(std.get(f, 1)))) for f in model["features"]})


def predict_anxiety(windows: DataFrame, key: list[str], model: dict | None) -> DataFrame:
    """(key, anxiety_index, level, baseline_deviation). The trees give the index itself and take raw values, missing ones
    as 0; the deviation is that of rmssd from the personal mean (rmssd_mean, rmssd_std, if there), in thirds, from -1 to 1."""
    if model is None:
        w = rule_anxiety(windows).withColumn("_i", F.col("anxiety_index"))
    else:
        raw = {f: raw_value(f) for f in model["features"]}
        keep = windows.withColumn("_rmssd", F.col("rmssd"))
        w = keep.withColumns(raw).withColumn("_i", clamp(tree_sum(model, "yes"), 0, 100)).withColumn("rmssd", F.col("_rmssd")).drop("_rmssd")
    has = {"rmssd_mean", "rmssd_std"} <= set(windows.columns)
    spread = F.when(F.col("rmssd_std") > 0, F.col("rmssd_std")).otherwise(1.0) if has else None
    off = F.coalesce((F.col("rmssd") - F.col("rmssd_mean")) / spread, F.lit(0.0)) if has else F.lit(0.0)
    return w.select(*key, F.col("_i").alias("anxiety_index"), anxiety_level(F.col("_i")).alias("level"), clamp(off / 3, -1, 1).alias("baseline_deviation"))


def predict_focus(windows: DataFrame, key: list[str], model: dict | None, stats: DataFrame | None = None, user: list[str] | None = None) -> DataFrame:
    """(key, focus_score, focus_level, elevated). stats as for stress, but with 20 windows as the least."""
    w = rule_focus(windows).withColumns({"_rule": F.col("focus_score"), "elevated": elevated()})
    if model is None:
        s = F.col("_rule")
    else:
        w = score_trees(_z(w, model, stats, user), model, "_p", "yes")
        s = clamp(half_up(F.round(F.col("_p") * 100, 9)).cast("double"), 0, 100)
    return w.select(*key, s.alias("focus_score"), focus_level(s).alias("focus_level"), "elevated")


def predict_bio_age(windows: DataFrame, user: list[str], model: dict, ages: DataFrame | None = None) -> DataFrame:
    """(user, predicted_age, age_gap, confidence, ready): the trees on each user's medians over usable windows, 10 at least;
    ages: (user, age), if known."""
    usable = (F.col("rmssd") > 0) & (F.col("mean_rr") > 0)
    finite = lambda f: F.when(usable & ~F.isnan(f) & (F.abs(f) != float("inf")), F.col(f))
    g = windows.groupBy(*user).agg(F.count_if(usable).alias("_n"), *[F.coalesce(F.median(finite(f)), F.lit(0.0)).alias(f) for f in model["features"]])
    g = _z(g, model, None, None)
    g = g.withColumns({"ready": F.col("_n") >= MIN_AGE_WINDOWS, "_age": half_up(clamp(tree_sum(model, "no"), 15, 95)).cast("int")})
    g = g.join(ages, user, "left") if ages is not None else g.withColumn("age", F.lit(None).cast("int"))
    ready = lambda c, other: F.when(F.col("ready"), c).otherwise(other)
    return g.select(*user, ready(F.col("_age"), F.coalesce(F.col("age").cast("int"), F.lit(0))).alias("predicted_age"), ready(F.col("_age") - F.col("age").cast("int"), F.lit(None)).alias("age_gap"), ready(F.least(F.lit(1.0), F.col("_n") / float(FULL_AGE_WINDOWS)), F.lit(0.0)).alias("confidence"), "ready")


def age_gap_text(ready: Column, age: Column, gap: Column) -> Column:
    """A sentence on the gap between the estimated and the real age."""
    return (F.when(~ready, "Not enough signal yet").when(gap.isNull(), F.format_string("Estimated age %d", age))
            .when(gap <= -3, F.format_string("Looks %d years younger", F.abs(gap))).when(gap >= 3, F.format_string("Looks %d years older", gap)).otherwise("About the actual age"))


def predict_depression(days: DataFrame, key: list[str], model: dict) -> DataFrame:
    """(key, probability, risk_score, risk_level, contributors, data_quality) of daily movement; a missing value takes a
    tree's no branch. Quality goes by the number of days on record (days)."""
    why = days.withColumn("_why", contributors(model))
    z = score_trees(_z(why, model, None, None), model, "_p", "no")
    score = half_up(F.round(clamp(F.col("_p") * 100, 0, 100), 9)).cast("long")
    quality = F.when(F.col("days") >= 7, "good").when(F.col("days") >= 3, "partial").otherwise("mock")
    return z.select(*key, F.col("_p").alias("probability"), score.alias("risk_score"), depression_level(score).alias("risk_level"), F.col("_why").alias("contributors"), quality.alias("data_quality"))


def sustained(predictions: DataFrame, user: list[str], ts_ms: str = "ts_ms", index: str = "anxiety_index", above: float = 70.0, minutes: int = 10) -> DataFrame:
    """Adds sustained: whether the index has been above the bound at each reading of the last minutes, and the readings
    reach back that far."""
    w = Window.partitionBy(*user).orderBy(ts_ms).rangeBetween(-minutes * 60_000, 0)
    before = Window.partitionBy(*user).orderBy(ts_ms).rangeBetween(Window.unboundedPreceding, -minutes * 60_000)
    return predictions.withColumn("sustained", F.coalesce((F.min(index).over(w) > above) & (F.count(index).over(before) > 0), F.lit(False)))


def best_examples(pred: DataFrame, by: list[str], y: str, z: str, conf: str, cols: list[str], tie: str) -> DataFrame:
    """For each group (by), the most confident right and the most confident wrong prediction: (by, right, *cols, conf)."""
    s = F.struct(F.col(conf).alias("_c"), (-F.col(tie)).alias("_t"), *cols)
    g = pred.groupBy(*by, (F.col(y) == F.col(z)).alias("right")).agg(F.max(s).alias("_m"))
    return g.select(*by, "right", *[F.col(f"_m.{c}").alias(c) for c in cols], F.col("_m._c").alias(conf))
