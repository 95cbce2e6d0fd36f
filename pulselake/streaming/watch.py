"""Flows from and to a watch: samples as streams, batches by time, and risks that are sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulselake.sources.binary import encode
from pulselake.streaming.intake import _landed

STANDARD_GRAVITY = 9.80665
# Fields of each flow, how many minutes a batch of it covers, and how precise a fix is that doesn't say.
FLOWS = {"heart": "user_id long, ts_ms long, bpm double", "motion": "user_id long, ts_ms long, x double, y double, z double", "light": "user_id long, ts_ms long, lux double", "location": "user_id long, ts_ms long, latitude double, longitude double, accuracy double"}
BATCH_MINUTES = {"light": 5, "location": 5}
NO_ACCURACY = -1.0


def read_flow(spark: SparkSession, folder: str, kind: str, most_files: int = 1000) -> DataFrame:
    """A stream of the samples that a watch's service puts into folder as lines of JSON: heart (bpm, whole), motion (g: metres a second
    squared become a magnitude in g), light and location (a fix that doesn't tell its accuracy has -1). Adds ts. Lines without a
    time or a value are passed over."""
    if kind not in FLOWS:
        raise ValueError(f"kind must be one of {', '.join(FLOWS)}")
    lines = spark.readStream.schema(FLOWS[kind]).option("maxFilesPerTrigger", most_files).json(folder)
    if kind == "motion":
        size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / STANDARD_GRAVITY
        rows = lines.select("user_id", "ts_ms", size.alias("g"))
    elif kind == "location":
        rows = lines.withColumn("accuracy", F.coalesce("accuracy", F.lit(NO_ACCURACY)))
    elif kind == "heart":
        rows = lines.withColumn("bpm", F.floor("bpm").cast("long"))
    else:
        rows = lines
    whole = F.lit(True)
    for c in rows.columns[1:]:
        whole &= F.col(c).isNotNull()
    return rows.where(whole).withColumn("ts", F.timestamp_millis("ts_ms"))


def batched(stream: DataFrame, kind: str, late: str = "1 minute", minutes: int | None = None) -> DataFrame:
    """(user_id, start, n, content): the samples of each user and stretch of minutes as one binary batch of kind (light or location), in
    order of time; it comes out when the watermark passes the stretch's end. State holds the open stretches' samples."""
    fields = {"light": ["lux"], "location": ["latitude", "longitude", "accuracy"]}[kind]
    width = minutes or BATCH_MINUTES[kind]

    @F.arrow_udf("binary")
    def content(rows: pa.Array) -> pa.Array:
        return pa.array([encode(kind, [tuple(r.values()) for r in x]) for x in rows.to_pylist()], pa.binary())

    w = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{width} minutes").alias("w"))
    g = w.agg(F.array_sort(F.collect_list(F.struct("ts_ms", *fields))).alias("rows"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", content("rows").alias("content"))


def send_risks(stream: DataFrame, send: Callable[[list[dict]], list[bool]], out: str, checkpoint: str, user: str = "user_id", ts_ms: str = "ts_ms", fields: tuple[str, ...] = ("risk_score", "risk_level", "probability")) -> StreamingQuery:
    """Sends each user's latest risk of every micro-batch, from the executors, some at a time: send(payloads) says which have gone. What
    has been sent is kept in out, by micro-batch. A send that raises leaves its payloads unsent, and the stream goes on: a display on
    a wrist is an extra. A micro-batch that is run again sends again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            why = None
            try:
                gone = list(send(rows)) if rows else []
                if len(gone) != len(rows):
                    raise ValueError(f"{len(gone)} answers to {len(rows)} payloads")
            except Exception as e:  # noqa: BLE001 - whatever a transport raises is kept beside its payloads
                gone, why = [False] * len(rows), f"{type(e).__name__}: {e}"
            yield batch.append_column("sent", pa.array(gone, pa.bool_())).append_column("why", pa.array([why] * len(rows), pa.string()))

    def take(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(user).agg(F.max_by(F.struct(*fields), F.struct(ts_ms, *fields)).alias("_r"), F.max(ts_ms).alias(ts_ms)).select(user, ts_ms, "_r.*")
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in latest.schema.fields)
        _landed(batch.sparkSession, out, latest.mapInArrow(run, types + ", sent boolean, why string"), number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
