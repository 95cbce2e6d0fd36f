"""Daily movement features from step intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import ratio

BINS = 20
MINUTE = 60_000
#: Hours of the day at which day and night change.
DAY_HOURS = (7, 22)


def stretches(steps: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms", count: str = "count") -> DataFrame:
    """(by, t0, s): of each group (a user's day), stretches of minutes in which nothing changes, in order.

    Intervals are spread evenly over their minutes, which count from the group's first start to its last end. A stretch is a
    struct of its first minute a, its length n, the rate v and whether it is day. Minutes of one rate stay together, so a
    day takes a few stretches, not 1,440 rows. Equal spans of minutes are summed before they meet, so a group holds as
    many as its minutes allow.
    """
    lo, hi = F.floor((F.col(start) - F.col("t0")) / MINUTE), F.ceil((F.col(end) - F.col("t0")) / MINUTE)
    s = steps.groupBy(*by).agg(F.min(start).alias("t0"), F.max(end).alias("_t1"))
    total = F.greatest(F.lit(1), F.ceil((F.col("_t1") - F.col("t0")) / MINUTE)).cast("int")
    i = steps.join(s, by).select(*by, "t0", total.alias("n"), lo.cast("int").alias("a"), F.least(hi.cast("int"), total).alias("b"), (F.col(count) / F.greatest(F.lit(1), hi - lo)).alias("v"))
    i = i.groupBy(*by, "t0", "n", "a", "b").agg(F.sum("v").alias("v"))
    g = i.groupBy(*by, "t0", "n").agg(F.collect_list(F.struct("a", "b", "v")).alias("i"))
    # Whole hours begin at minutes that needn't be whole from t0: the first minute that starts in the hour or after it.
    starts = F.array(*[(F.floor(F.col("t0") / 86_400_000) + d) * 86_400_000 + h * 3_600_000 for d in range(3) for h in DAY_HOURS])
    hours = F.transform(starts, lambda x: F.ceil((x - F.col("t0")) / MINUTE).cast("int"))
    cuts = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(F.array(F.lit(0), F.col("n")), F.transform("i", lambda x: x["a"]), F.transform("i", lambda x: x["b"]), hours)), lambda c: (c >= 0) & (c <= F.col("n")))))
    g = g.withColumn("c", cuts)

    def one(a: Column, k: Column) -> Column:
        rate = F.aggregate(F.filter("i", lambda x: (x["a"] <= a) & (a < x["b"])), F.lit(0.0), lambda acc, x: acc + x["v"])
        hour = F.pmod(F.floor((F.col("t0") + a.cast("long") * MINUTE) / 3_600_000), F.lit(24))
        return F.struct(a.alias("a"), (F.get("c", k + 1) - a).alias("n"), rate.alias("v"), hour.between(DAY_HOURS[0], DAY_HOURS[1] - 1).alias("day"))

    return g.select(*by, "t0", F.transform(F.slice("c", 1, F.size("c") - 1), one).alias("s"))


def daily_features(s: DataFrame, by: list[str]) -> DataFrame:
    """The movement figures of each group of stretches (a user's day). Everything is worked out from one row's stretches."""
    c = F.col

    def total(of, where=None) -> Column:
        items = c("s") if where is None else F.filter("s", where)
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x))

    minutes = lambda x: x["n"].cast("double")
    weighted = lambda x: x["v"] * x["n"]
    day = lambda x: x["day"]
    out = s.withColumns({"_n": total(minutes), "_sum": total(weighted), "max_activity": F.array_max(F.transform("s", lambda x: x["v"])), "min_activity": F.array_min(F.transform("s", lambda x: x["v"]))})
    out = out.withColumn("mean_activity", c("_sum") / c("_n"))
    out = out.withColumn("std_activity", F.sqrt(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["n"] * F.pow(x["v"] - c("mean_activity"), 2)) / c("_n")))
    # Percentiles: stretches by rate, each with the minutes up to its end.
    ranked = F.array_sort(F.transform("s", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"))))
    start = F.struct(F.lit(0.0).alias("n"), F.array().cast("array<struct<v:double,upto:double>>").alias("r"))
    upto = F.aggregate(ranked, start, lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.concat(acc["r"], F.array(F.struct(x["v"].alias("v"), (acc["n"] + x["n"]).alias("upto")))).alias("r")), lambda acc: acc["r"])
    out = out.withColumn("_r", upto)
    at = lambda i: F.get(F.filter("_r", lambda x: x["upto"] > i), F.lit(0))["v"]
    percentiles = {}
    for q in (10, 25, 50, 75, 90):
        where = (c("_n") - 1) * (q / 100.0)
        percentiles[f"p{q}"] = at(F.floor(where)) + (at(F.ceil(where)) - at(F.floor(where))) * (where - F.floor(where))
    out = out.withColumns(percentiles)
    below = lambda bound: (lambda x: x["v"] < bound)
    above = lambda bound: (lambda x: x["v"] > bound)
    # Rest: stretches below 20 that touch are one run.
    run0 = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("most"), F.lit(0).alias("runs"))
    runs = F.aggregate("s", run0, lambda acc, x: F.when(x["v"] < 20, F.struct((acc["now"] + x["n"]).alias("now"), F.greatest(acc["most"], acc["now"] + x["n"]).alias("most"), (acc["runs"] + F.when(acc["now"] == 0, 1).otherwise(0)).alias("runs"))).otherwise(F.struct(F.lit(0.0).alias("now"), acc["most"].alias("most"), acc["runs"].alias("runs"))))
    width = (c("max_activity") - c("min_activity") + 1e-9) / BINS
    in_bin = F.transform("s", lambda x: F.struct(F.least(F.lit(BINS - 1), F.floor((x["v"] - c("min_activity")) / width)).cast("int").alias("b"), x["n"].alias("n")))
    out = out.withColumns({"_runs": runs, "_b": in_bin})
    share = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.aggregate(F.filter("_b", lambda x: x["b"] == b), F.lit(0.0), lambda acc, x: acc + x["n"]) / c("_n"))
    out = out.withColumns({
        "inactive_minutes": total(minutes, below(20)).cast("long"), "active_minutes": total(minutes, above(200)).cast("long"), "very_active_minutes": total(minutes, above(500)).cast("long"),
        "day_mean": ratio(total(weighted, day), total(minutes, day)), "night_mean": ratio(total(weighted, lambda x: ~x["day"]), total(minutes, lambda x: ~x["day"])),
        "longest_rest_period": c("_runs.most").cast("long"), "rest_period_count": c("_runs.runs").cast("long"), "activity_range": c("max_activity") - c("min_activity"),
        "activity_cv": c("std_activity") / (c("mean_activity") + 1e-6), "_share": share,
    })
    out = out.withColumns({"day_night_ratio": c("day_mean") / (c("night_mean") + 1), "activity_entropy": F.aggregate(F.filter("_share", lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))})
    return out.drop("s", "t0", "_n", "_sum", "_r", "_runs", "_b", "_share")
