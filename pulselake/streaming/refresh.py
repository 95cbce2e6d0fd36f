"""Scores against personal baselines that are renewed as a stream goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulselake.operators.baseline import MIN_WINDOWS, due
from pulselake.sources import keyed
from pulselake.streaming.intake import _landed


def scored_against_baselines(stream: DataFrame, folder: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], user: str = "user_id", ts_ms: str = "ts_ms", hours: int = 24, least: int = MIN_WINDOWS) -> StreamingQuery:
    """Scores each micro-batch's windows against the newest baseline of their user, which is renewed first where it is due: older than
    so many hours by the latest window that has come, or not there, and least windows are stored.

    Below folder: windows (all that came), baselines (one row for each user, with computed_at) and scores; windows and scores are
    partitioned by micro-batch, so that one that is run again replaces what it had written. compute(windows of the due
    users) gives (user, figures); score(windows with those figures, null for users without) gives what is kept. Between two
    renewals all windows of a user are scored against the same figures. Windows of users not in the micro-batch aren't read.
    """
    windows_at, baselines_at, scores_at = (f"{folder.rstrip('/')}/{n}" for n in ("windows", "baselines", "scores"))

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _landed(spark, windows_at, batch, number)
        stored = spark.read.schema(batch.schema).parquet(windows_at)
        came = spark.read.schema(batch.schema).parquet(f"{windows_at}/batch={number}")
        now = came.agg(F.max(ts_ms)).first()[0]
        if now is None:
            return
        theirs = stored.join(came.select(user).distinct(), user, "left_semi")
        shape = compute(stored.limit(0)).withColumns({"computed_at": F.lit(now).cast("long"), "day": F.lit(0).cast("long")}).schema
        known = lambda: spark.read.schema(shape).parquet(baselines_at) if keyed.has_partitions(spark, baselines_at) else spark.createDataFrame([], shape)
        users = due(theirs, known(), now, user, hours, least).select(user)
        fresh = compute(theirs.join(users, user, "left_semi")).withColumns({"computed_at": F.lit(now).cast("long"), "day": F.lit(now // 86_400_000).cast("long")})
        keyed.merge(baselines_at, fresh.select(*shape.names), [user], "computed_at", "day")
        figures = known().drop("day")
        _landed(spark, scores_at, score(came.join(figures, user, "left")), number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
