"""Stays, places and their diversity from location points; sunlight from light samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pulselake.functions.scalar import EARTH_M
from pulselake.operators.joins import unknown_places
from pulselake.operators.windows import key_runs

RADIUS_M = 100.0


def _metres(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def stays(points: DataFrame, user: str = "user_id", ts: str = "ts_ms", tie: str = "event_id", radius: float = RADIUS_M) -> DataFrame:
    """(user, arrival, departure, lat, lon, place): runs of points near a running centroid. A run belongs to the first of
    the user's places, in order of arrival, whose own running centroid (the mean of its runs so far) is near; else it is a
    new place. Order-dependent, so a fold over each user's points in time order; it carries the run and the places. Points
    without a time or a coordinate are left out; the null user is a user."""

    rows = points.select(user, ts, tie, "lat", "lon")
    names = [user, "arrival", "departure", "lat", "lon", "place"]
    kinds = [rows.schema[user].dataType, LongType(), LongType(), DoubleType(), DoubleType(), IntegerType()]
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, who, run_, known = None, None, None, []
        out: dict[str, list] = {n: [] for n in names}

        def leave() -> None:
            """The run is over: it belongs to the first place near it, or to a new one."""
            lat, lon, _, arrived, left = run_
            near = next((i for i, (a, b, _) in enumerate(known) if _metres(lat, lon, a, b) < radius), len(known))
            a, b, n = known[near] if near < len(known) else (0.0, 0.0, 0)
            known[near : near + 1] = [((a * n + lat) / (n + 1), (b * n + lon) / (n + 1), n + 1)]
            for c, v in zip(names[1:], (arrived, left, lat, lon, near), strict=True):
                out[c].append(v)
            whose.append(who)

        for batch in batches:
            whose: list[pa.Array] = []
            if not batch.num_rows:
                continue
            key = batch[user]
            runs, before = key_runs(batch, [user], before)
            at, lats, lons = batch[ts].to_pylist(), batch["lat"].to_pylist(), batch["lon"].to_pylist()
            for i, j, new in runs:
                if new:
                    if run_:
                        leave()
                    run_, known, who = None, [], key[i : i + 1]
                for t, lat, lon in zip(at[i:j], lats[i:j], lons[i:j], strict=True):
                    if lat is None or lon is None or t is None:
                        continue
                    if run_ and _metres(lat, lon, run_[0], run_[1]) < radius:
                        n = run_[2]
                        run_ = ((run_[0] * n + lat) / (n + 1), (run_[1] * n + lon) / (n + 1), n + 1, run_[3], t)
                    else:
                        if run_:
                            leave()
                        run_ = (lat, lon, 1, t, t)
            if whose:
                yield _stays_batch(whose, out, names, schema)
                out = {n: [] for n in names}
        if run_:
            whose = []
            leave()
            yield _stays_batch(whose, out, names, schema)

    return rows.repartition(user).sortWithinPartitions(user, ts, tie).mapInArrow(run, schema)


def _stays_batch(whose: list[pa.Array], out: dict[str, list], names: list[str], schema: StructType) -> pa.RecordBatch:
    types = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(whose).cast(types.field(0).type), *[pa.array(out[n], types.field(n).type) for n in names[1:]]], schema=types)


def place_summary(visits: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, label, lat, lon, visits, total, night, day): a place lies at the mean of its visits; home is where most night time is spent, the last of equals; work
    where most weekday daytime is, elsewhere and more than none."""
    hour = F.pmod(F.floor(F.col("arrival") / 3_600_000), F.lit(24))
    weekday = F.pmod(F.floor(F.col("arrival") / 86_400_000) + 3, F.lit(7))  # Monday: 0
    length = F.col("departure") - F.col("arrival")
    c = visits.groupBy(*by, "place").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("visits"), F.sum(length).alias("total_ms"), F.sum(F.when((hour >= 22) | (hour < 6), length).otherwise(0)).alias("night_ms"),
        F.sum(F.when((weekday < 5) & hour.between(8, 17), length).otherwise(0)).alias("day_ms"),
    )
    g = Window.partitionBy(*by)
    c = c.withColumn("_home", F.row_number().over(g.orderBy(F.desc("night_ms"), F.desc("place"))) == 1)
    c = c.withColumn("_work", (F.row_number().over(g.orderBy("_home", F.desc("day_ms"), F.desc("place"))) == 1) & ~F.col("_home") & (F.col("day_ms") > 0))
    return c.withColumn("label", F.when(F.col("_home"), "home").when(F.col("_work"), "work").otherwise(F.concat(F.lit("place_"), F.col("place")))).drop("_home", "_work")


def diversity(visits: DataFrame, places: DataFrame, by: list[str], known: DataFrame | None = None) -> DataFrame:
    """(by, places, transitions, home_share, work_share, novel, score, monotonous). novel: places near none of known (by,
    lat, lon), the places of the days before; all are, if there are none."""
    order = Window.partitionBy(*by).orderBy("arrival", "departure")
    moves = visits.withColumn("_m", (F.lag("place").over(order) != F.col("place")).cast("int")).groupBy(*by).agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("transitions"))
    share = lambda name: F.coalesce(F.try_divide(F.sum(F.when(F.col("label") == name, F.col("total_ms"))), F.sum("total_ms")), F.lit(0.0))
    p = places.groupBy(*by).agg(F.count(F.lit(1)).alias("places"), share("home").alias("home_share"), share("work").alias("work_share"), F.min(F.col("label").isin("home", "work")).alias("_known"))
    new = places if known is None else unknown_places(places, known, by)
    out = p.join(moves, by).join(new.groupBy(*by).agg(F.count(F.lit(1)).alias("novel")), by, "left").na.fill(0, ["novel"])
    out = out.withColumn("score", F.least(F.lit(100), (F.col("places") - 1) * 25 + F.col("novel") * 15 + F.when(F.col("transitions") > 2, 10).otherwise(0)))
    return out.withColumn("monotonous", (F.col("places") <= 2) & F.col("_known")).drop("_known")


def sunlight(samples: DataFrame, by: list[str], goal: int = 30, lux: str = "lux", ts: str = "ts", outdoors: float = 1000.0) -> DataFrame:
    """Daily light: each sample counts as a minute; outdoors from 1000 lux; the best window is 10 to 15 o'clock."""
    out = F.col(lux) >= outdoors
    best = out & F.hour(ts).between(10, 14)
    g = samples.groupBy(*by).agg(F.count_if(out).alias("outdoor_minutes"), F.count_if(best).alias("optimal_minutes"), F.greatest(F.max(lux), F.lit(0.0)).alias("peak_lux"), F.coalesce(F.avg(F.when(out, F.col(lux))), F.lit(0.0)).alias("avg_outdoor_lux"))
    return g.withColumn("goal_progress", F.least(F.lit(1.0), F.col("outdoor_minutes") / F.lit(float(goal))))
