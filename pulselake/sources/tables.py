"""Stored tables: schemas, appends, upserts, JSON patches, re-derived days, retention, deletion and export.

A table is a Parquet folder partitioned by date. Changes replace only the partitions that they touch; what is rewritten is staged
in a folder of its own first, so that a lost executor or a failed job leaves the table as it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulselake.sources import keyed

DAY_MS = 86_400_000
REDACTED = "[redacted]"
# Columns of each table, its key (none: rows are appended), its time and how many days it keeps (none: all).
SCHEMAS = {
    "samples": ("user_id long, ts_ms long, kind string, value double, source string", (), "ts_ms", 30),
    "feature_windows": ("user_id long, ts_ms long, window_seconds int, features string", (), "ts_ms", 90),
    "sleep_sessions": ("user_id long, session_start long, session_end long, stages array<struct<start_ms:long,end_ms:long,stage:string>>, quality double", ("user_id", "session_start"), "session_start", 365),
    "baselines": ("user_id long, computed_at long, figures string", (), "computed_at", None),
    "checkins": ("user_id long, id string, ts_ms long, transcript string, sentiment_score double, emotions map<string,double>, meta string", ("user_id", "id"), "ts_ms", 365),
    "recommendations": ("user_id long, id string, ts_ms long, status string, feedback string", ("user_id", "id"), "ts_ms", 90),
    "visits": ("user_id long, ts_ms long, departure_ms long, lat double, lon double, place int", (), "ts_ms", 90),
    "points": ("user_id long, ts_ms long, lat double, lon double, accuracy float", (), "ts_ms", 30),
    "diversity": ("user_id long, ts_ms long, score double", ("user_id", "ts_ms"), "ts_ms", 365),
    "light": ("user_id long, ts_ms long, lux double", (), "ts_ms", 30),
    "light_days": ("user_id long, ts_ms long, minutes long", ("user_id", "ts_ms"), "ts_ms", 365),
    "settings": ("user_id long, name string, ts_ms long, value string", ("user_id", "name"), "ts_ms", None),
}


def day_of(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def merged_json(old: Column, patch: Column) -> Column:
    """A JSON object with the top-level fields of patch over those of old; values keep their JSON, a null side changes nothing."""
    kind = "map<string,variant>"
    a, b = F.from_json(F.coalesce(old, F.lit("{}")), kind), F.from_json(F.coalesce(patch, F.lit("{}")), kind)
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.to_json(F.map_concat(kept, b))


@dataclass(frozen=True)
class Store:
    """The tables below one folder, which driver and executors share."""

    spark: SparkSession
    root: str
    schemas: dict = field(default_factory=lambda: SCHEMAS)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        return keyed.has_partitions(self.spark, self._path(name))

    def read(self, name: str) -> DataFrame:
        """The table under its schema: columns that older files lack are null; a table not written yet is empty."""
        schema = self.schemas[name][0] + ", date date"
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], self.schemas[name][0]).schema
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
        return rows.select(*cols).withColumn("date", day_of(F.col(self.schemas[name][2])))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; one job commits them all or none."""
        keyed.by_partition(self._shaped(name, rows), "date").write.mode("append").partitionBy("date").parquet(self._path(name))

    def _replace(self, name: str, rows: DataFrame) -> None:
        keyed.replace_partitions(rows, self._path(name), "date")

    def _touched(self, rows: DataFrame) -> list:
        return keyed.distinct_values(rows, "date")  # one batch's days

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by the table's key, on whatever days the key's rows are; the latest time stays, of equal ones the row
        that is written last. Only the days that hold rows of these keys are rewritten (see keyed.merge)."""
        keyed.merge(self._path(name), self._shaped(name, rows), list(self.schemas[name][1]), self.schemas[name][2], "date")

    def get(self, name: str, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in wanted, such as settings of users: read from the days that the index names, not all."""
        return keyed.lookup(self._path(name), wanted, list(self.schemas[name][1]), "date", self.read(name).schema)

    def upsert_stream(self, stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """upsert of every micro-batch; a batch that is run again after a failure changes nothing."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.upsert(name, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def patch(self, name: str, column: str, patches: DataFrame) -> None:
        """Merge JSON patches (key, date, patch) into a column of the rows with their keys; other rows stay."""
        key = list(self.schemas[name][1])
        old = self.read(name).where(keyed.among("date", self._touched(patches)))
        j = old.join(patches.select(*key, "date", F.col("patch").alias("_p")), [*key, "date"], "left")
        self._replace(name, j.withColumn(column, F.when(F.col("_p").isNotNull(), merged_json(F.col(column), F.col("_p"))).otherwise(F.col(column))).select(*old.columns))

    def rederive(self, name: str, rows: DataFrame, start_ms: int, end_ms: int) -> None:
        """Replace all rows of [start_ms, end_ms] by rows, so that deriving a day twice is the same as once. Rows of the
        edge days that lie outside stay."""
        ts = self.schemas[name][2]
        days = F.col("date").between(day_of(F.lit(start_ms)), day_of(F.lit(end_ms)))
        old = self.read(name).where(days & ~F.col(ts).between(start_ms, end_ms))
        fresh = old.unionByName(self._shaped(name, rows))
        before, after = set(self._touched(self.read(name).where(days))), set(self._touched(fresh))
        if after:
            self._replace(name, fresh)
        for d in before - after:
            self._drop(name, d)

    def _drop(self, name: str, day) -> None:
        keyed.drop(self.spark, f"{self._path(name)}/date={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")

    def retain(self, as_of_ms: int, days: dict | None = None) -> dict[str, int]:
        """Delete what is older than each table keeps; (table: rows deleted). Whole days go as folders; the edge day is rewritten."""
        out = {}
        for name, (_, _, ts, keep) in self.schemas.items():
            keep = (days or {}).get(name, keep)
            if keep is None or not self.exists(name):
                continue
            cutoff = as_of_ms - keep * DAY_MS
            old = self.read(name).where((F.col("date") <= day_of(F.lit(cutoff))) & (F.col(ts) < cutoff))
            gone = {r[0]: r[1] for r in old.groupBy("date").count().collect()}  # days beyond the limit
            left = {r[0] for r in self.read(name).where(F.col("date").isin(list(gone)) & (F.col(ts) >= cutoff)).select("date").distinct().collect()} if gone else set()
            if left:
                self._replace(name, self.read(name).where(F.col("date").isin(list(left)) & (F.col(ts) >= cutoff)))
            for d in set(gone) - left:
                self._drop(name, d)
            out[name] = sum(gone.values())
        return out

    def delete_all(self, user_id: int | None = None) -> None:
        """Delete every table, points and settings too; or one user's rows in all of them."""
        for name, (_, key, *_) in self.schemas.items():
            if user_id is None:
                keyed.drop(self.spark, self._path(name))
                continue
            if not self.exists(name):
                continue
            theirs = F.col("user_id").eqNullSafe(user_id)  # rows of no user are not theirs
            touched = self._touched(self.read(name).where(theirs))
            rest = self.read(name).where(keyed.among("date", touched) & ~theirs)
            left = self._touched(rest)
            if left:
                self._replace(name, rest)
            for d in set(touched) - set(left):
                self._drop(name, d)
            if key:
                keyed.forget(self._path(name), self.read(name), list(key), "date", theirs)

    def export(self, path: str, start_ms: int, end_ms: int, full: bool = False) -> None:
        """One JSON object for each user and table: (user_id, table, n, rows), as files below path. Transcripts are left out unless full."""
        for name in ("samples", "feature_windows", "sleep_sessions", "checkins", "baselines"):
            df = self.read(name).where(F.col(self.schemas[name][2]).between(start_ms, end_ms))
            if name == "baselines":  # the latest alone
                df = df.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "user_id"]), "computed_at").alias("_r")).select("user_id", "_r.*")
            if "transcript" in df.columns and not full:
                df = df.withColumn("transcript", F.lit(REDACTED))
            df.withColumn("table", F.lit(name)).repartition("user_id").sortWithinPartitions("user_id", self.schemas[name][2]).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def redacted(checkins: DataFrame, column: str = "transcript") -> DataFrame:
    return checkins.withColumn(column, F.lit(REDACTED))


def guarded(text: Column, key: Column) -> Column:
    """Text encrypted with a key of 16, 24 or 32 bytes, as base64; unguarded reverses it."""
    return F.base64(F.aes_encrypt(text, key))


def unguarded(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key).cast("string")


def write_model(spark: SparkSession, path: str, model: dict) -> None:
    """A model's document (features, trees, normalisation) as one JSON line in a folder."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
