"""Intake of wearable batches from a folder: each good file once, bad ones set aside, nothing lost while no model is there."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulselake.sources import keyed
from pulselake.sources.binary import MAGIC, decode, records


#: What Spark's binaryFile source gives.
FILE = "path string, modificationTime timestamp, length long, content binary"


def batch_kind(content: Column) -> Column:
    """The kind whose mark the content begins with, else null."""
    head = F.substring(content, 1, 4)
    return F.coalesce(*[F.when(head == F.lit(bytes(m)), F.lit(k)) for k, m in MAGIC.items()])


def whole(kind: Column, content: Column) -> Column:
    """Whether the content is a whole batch of its kind."""

    @F.pandas_udf("boolean")
    def checked(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([k is not None and records(k, bytes(c)) is not None for k, c in zip(kinds, contents, strict=True)], dtype=bool)

    return checked(kind, content)


def _landed(spark: SparkSession, path: str, rows: DataFrame, number: int) -> None:
    """Write rows as partition batch=number of path; the same micro-batch again replaces them."""
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


class NoModel(RuntimeError):
    """Batches that need a model have come, and there is none yet."""


def consume(spark: SparkSession, folder: str, out: str, checkpoint: str, ready: Callable[[str], bool] = lambda kind: True, glob: str = "*.bin", most_files: int = 1000, archive: str | None = None) -> StreamingQuery:
    """Take in the files of folder once each, by the mark each begins with: rows of kind k are in out/k, partitioned by
    micro-batch. Files with no known mark, or cut off, are kept whole in out/quarantine with why.

    A micro-batch that fails, or whose driver dies, is run again with the same files and replaces what it had written; files
    count as consumed when all kinds of their micro-batch are written. If ready(kind) is false for a kind that has come, the
    micro-batch fails before anything is written, so its files wait for the next start. archive: a folder that consumed files are
    moved to some micro-batches later; else they stay. Empty files hold nothing and are passed over.
    """
    stream = spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def take(batch: DataFrame, number: int) -> None:
        marked = batch.select("path", "modificationTime", "content", batch_kind(F.col("content")).alias("kind"))
        kinds = [r[0] for r in marked.select("kind").distinct().collect()]  # three, or none known
        missing = [k for k in kinds if k is not None and not ready(k)]
        if missing:
            raise NoModel(f"no model for {', '.join(missing)}")
        checked = marked.withColumn("whole", whole(F.col("kind"), F.col("content")))
        for kind in filter(None, kinds):
            _landed(spark, f"{out}/{kind}", decode(checked.where((F.col("kind") == kind) & F.col("whole")), kind), number)
        bad = checked.where(~F.col("whole")).select("path", "modificationTime", "content", F.when(F.col("kind").isNull(), "unknown mark").otherwise("cut off or malformed").alias("why"))
        _landed(spark, f"{out}/quarantine", bad, number)

    return stream.load(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consumed(spark: SparkSession, out: str, kind: str, schema: str) -> DataFrame:
    """What has been taken in of a kind (or quarantine)."""
    path = f"{out}/{kind}"
    full = schema + ", batch int"
    return spark.read.schema(full).parquet(path) if keyed.has_partitions(spark, path) else spark.createDataFrame([], full)


def finished_sessions(spark: SparkSession, folder: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None) -> StreamingQuery:
    """Run process (a model) over the sleep sessions whose folder holds SESSION.final, once each: (session, ts_ms, f) of all their
    batches, in order of time, go in, and what comes out is in out, partitioned by micro-batch. A session begins to count when its
    marker comes. Without a model (process is None) the micro-batch fails and the sessions wait for the next start."""
    markers = spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", "SESSION.final").option("recursiveFileLookup", "true").load(folder)
    session = F.regexp_replace("path", r"/[^/]+$", "")

    def take(batch: DataFrame, number: int) -> None:
        done = batch.select(session.alias("_final"))
        if process is None:
            if not done.isEmpty():
                raise NoModel("no model for sleep")
            return
        every = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(folder)
        rows = decode(every.join(done, session == F.col("_final"), "left_semi"), "sleep").select(session.alias("session"), "ts_ms", "f")
        _landed(spark, out, process(rows.repartition("session").sortWithinPartitions("session", "ts_ms")), number)

    return markers.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
