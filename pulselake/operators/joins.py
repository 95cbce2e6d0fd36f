"""Joins by time and place, with equality keys that keep them off nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.scalar import haversine


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points with the half-open ranges [low, high) of the same key that hold them. Ranges are dealt to time buckets; a
    bucket about as wide as a range keeps both the copies and the misses few."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor((F.greatest(F.col(high) - 1, F.col(low))) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    return p.join(r, [*by, "_b"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """Sum of the overlap of each of a's intervals (a_start, a_end) with b's (b_start, b_end), as overlap; 0 without."""
    spread = lambda d, s, e: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    j = spread(a, "a_start", "a_end").join(spread(b, "b_start", "b_end"), [*by, "_b"])
    common = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    # A pair meets in every bucket it shares; the one that holds the later start counts.
    j = j.where((common > 0) & (F.col("_b") == F.floor(F.greatest("a_start", "b_start") / bucket)))
    total = j.groupBy(*by, "a_start", "a_end").agg(F.sum(common).alias("overlap"))
    return a.join(total, [*by, "a_start", "a_end"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tie: str, out: str) -> DataFrame:
    """left with right's latest value at or before each time: one union, one window, no join."""
    keep = left.columns
    l = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1), "_tie": F.lit(0).cast("long")})  # noqa: E741
    r = right.select(*by, F.col(at), F.col(value).alias("_v"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"))
    w = Window.partitionBy(*by).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    u = l.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return u.where("_side = 1").select(*keep, out)


def around(epochs: DataFrame, samples: DataFrame, by: list[str], centre: str, at: str, value: str, before: int, after: int) -> DataFrame:
    """Mean, deviation, extremes and count of the samples in [centre - before, centre + after) of each epoch, by a range frame."""
    e = epochs.withColumns({"_t": F.col(centre), "_v": F.lit(None).cast("double"), "_e": F.lit(1)})
    s = samples.select(*by, F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_e"))
    w = Window.partitionBy(*by).orderBy("_t").rangeBetween(-before, after - 1)
    u = e.unionByName(s, allowMissingColumns=True)
    u = u.withColumns({"s_mean": F.avg("_v").over(w), "s_std": F.stddev_pop("_v").over(w), "s_min": F.min("_v").over(w), "s_max": F.max("_v").over(w), "s_n": F.count("_v").over(w)})
    return u.where("_e = 1").drop("_t", "_v", "_e")


def unknown_places(places: DataFrame, known: DataFrame, by: list[str], radius_m: float = 100.0) -> DataFrame:
    """Places (lat, lon) farther than radius_m from all known ones of the key: an anti join over neighbouring grid cells.

    Rows of cells are bands of latitude. Each band is cut into a whole number of cells around the earth, none narrower
    than the radius, by the band's own width; a known place is entered in its band and both neighbours under their
    cuts, so a place meets all known ones near it, across bands and across 180 degrees too.
    """
    cell = radius_m / 111_000.0 * 1.05
    band = lambda lat: F.floor((lat + 90.0) / cell)
    # The edge nearer to a pole is the shorter circle, so cells are wide enough everywhere in the band.
    edge = lambda y: F.greatest(F.abs(y * cell - 90.0), F.abs((y + 1) * cell - 90.0))
    around_ = lambda y: F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge(y), F.lit(90.0)))) / cell))
    column = lambda lon, n: F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * n), n - 1)
    p = places.withColumn("_y", band(F.col("lat"))).withColumn("_x", column(F.col("lon"), around_(F.col("_y"))))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    k = known.select(*by, F.col("lat").alias("_klat"), F.col("lon").alias("_klon"), F.explode(F.transform(near, lambda d: band(F.col("lat")) + d)).alias("_y"))
    k = k.withColumn("_n", around_(F.col("_y")))
    k = k.withColumn("_x", F.explode(F.array_distinct(F.transform(near, lambda d: F.pmod(column(F.col("_klon"), F.col("_n")) + d, F.col("_n")))))).drop("_n")
    cond = [p[c] == k[c] for c in [*by, "_y", "_x"]] + [haversine(p["lat"], p["lon"], k["_klat"], k["_klon"]) < radius_m]
    return p.join(k, cond, "left_anti").drop("_y", "_x")


def looked_up(df: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """df with its template's columns; a key that no template has is an error when the row is read."""
    t = templates.withColumn("_there", F.lit(True))
    j = df.join(t, key, "left")
    ok = F.coalesce("_there", F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return j.where(ok).drop("_there")


def pure_label(windows: DataFrame, seconds: DataFrame, by: list[str], start: str, length: int, t: str, label: str, purity: float = 0.8) -> DataFrame:
    """windows with the label that at least purity of their seconds carry (the least of equals); others are left out.
    start: the window's first second, a multiple of length."""
    s = seconds.withColumn("_s", F.floor(F.col(t) / length).cast("long") * length).groupBy(*by, "_s", label).agg(F.count_distinct(F.floor(t)).alias("_n"))
    best = s.groupBy(*by, "_s").agg(F.min_by(F.struct(label, "_n"), F.struct(-F.col("_n"), label)).alias("_b")).where(F.col("_b._n") >= purity * length)
    return windows.join(best.select(*by, F.col("_s").alias(start), F.col(f"_b.{label}").alias(label)), [*by, start])


def at_index(epochs: DataFrame, series: DataFrame, by: list[str], centre: str, origin: str, step: float, index: str, value: str) -> DataFrame:
    """epochs with the series' value at floor((centre - origin) / step); null outside it. An equality join on the index."""
    i = F.floor((F.col(centre) - F.col(origin)) / step).cast("long")
    s = series.select(*by, F.col(index).cast("long").alias("_i"), value)
    return epochs.withColumn("_i", i).join(s, [*by, "_i"], "left").drop("_i")


def nearest_day(days: DataFrame, sessions: DataFrame, by: list[str], at: str, start: str, tie: str, cols: list[str], within: int = 86_400_000) -> DataFrame:
    """days with the first session (by start) that begins less than within from each day's time; null without one."""
    d = days.withColumn("_b", F.floor(F.col(at) / within))
    s = sessions.select(*by, F.col(start).alias("_start"), F.col(tie).alias("_tie"), *cols, F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: F.floor(F.col(start) / within) + x)).alias("_b"))
    hit = d.select(*by, at, "_b").distinct().join(s, [*by, "_b"]).where(F.abs(F.col(at) - F.col("_start")) < within)
    first = hit.groupBy(*by, at).agg(F.min_by(F.struct(*cols), F.struct("_start", "_tie")).alias("_r")).select(*by, at, "_r.*")
    return days.join(first, [*by, at], "left")


def zipped(df: DataFrame, series: dict[str, str], position: str = "i") -> DataFrame:
    """Rows of arrays side by side: position from 0, and each array's element there; shorter ones are null at the end."""
    z = F.arrays_zip(*[F.col(c).alias(n) for n, c in series.items()])
    rest = [c for c in df.columns if c not in series.values()]
    return df.select(*rest, F.posexplode(z).alias(position, "_z")).select(*rest, position, *[F.col("_z").getField(str(n)).alias(n) for n in series])
