"""Domain views over the driver tables, in Spark and as SQL: the tables hold no biosignals, so columns stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with ms (milliseconds) and k (the number in props)."""
    e = table(spark, d, "events")
    return e.withColumns({"ms": F.unix_millis(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("double")})


EVENTS = "ev AS (SELECT event_id, user_id, ts, event_type, value, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def windows(spark: SparkSession, d: str) -> DataFrame:
    """One feature window for each event."""
    return events(spark, d).select("event_id", "user_id", "ts", (40 + F.col("value")).alias("hr_mean"), (15 + F.col("k")).alias("rmssd"), (30 + F.col("value") / 2).alias("sdnn"))


WINDOWS = EVENTS + ", fw AS (SELECT event_id, user_id, ts, 40 + value AS hr_mean, 15 + k AS rmssd, 30 + value / 2 AS sdnn FROM ev)"


def stages(spark: SparkSession, d: str) -> DataFrame:
    """Sleep stages: a user's events of a day in turn, each until the next."""
    from pyspark.sql import Window

    e = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("user_id", "day").orderBy("ms", "event_id")
    names = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    e = e.withColumn("end_ms", F.coalesce(F.lead("ms").over(w), F.col("ms") + 600000))
    return e.select("event_id", "user_id", "day", F.col("ms").alias("start_ms"), "end_ms", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("unknown")).alias("stage"))


STAGE_OF = {"view": "light", "click": "deep", "purchase": "rem", "signup": "awake", "login": "awake"}
STAGES = EVENTS + ", st AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, ms AS start_ms, coalesce(lead(ms) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ms, event_id), ms + 600000) AS end_ms, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " ELSE 'unknown' END AS stage FROM ev)"
