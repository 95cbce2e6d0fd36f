"""Tables with one row for each key, in date partitions, with an index from keys to the dates that hold their rows.

A merge looks up in the index where the old rows of its keys are and rewrites those partitions and its own, no others. The index
is a Parquet folder below the table, in buckets by a hash of the key; a leading underscore keeps it out of reads of the table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "_index"
#: Buckets of an index: of those that a batch touches, all rows are rewritten.
BUCKETS = 64


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def drop(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def by_partition(rows: DataFrame, part: str) -> DataFrame:
    """rows dealt out by partition, small ones together and large ones split, so that a write makes few files and none too large."""
    return rows.hint("rebalance", part)


def replace_partitions(rows: DataFrame, path: str, part: str) -> None:
    """Replace the partitions that rows have by rows. They are staged in a folder of this call first: a partition can't be read
    while it is replaced, and two writers must not meet in one folder."""
    spark, staged = rows.sparkSession, f"{path}/_staged/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staged)
        again = spark.read.schema(rows.schema).parquet(staged)
        by_partition(again, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    finally:
        drop(spark, staged)


def distinct_values(df: DataFrame, column: str) -> list:
    """Partitions or buckets that df has: as many as there are days or buckets, not rows."""
    return [r[0] for r in df.select(column).distinct().collect()]


def among(column: str, values: list) -> Column:
    """Whether the column is one of values, null among them or not."""
    known = [v for v in values if v is not None]
    hit = F.col(column).isin(known) if known else F.lit(False)
    return hit | F.col(column).isNull() if None in values else hit


def by_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """df's rows whose keys are (left_semi) or aren't (left_anti) among other's; null keys meet null keys."""
    right = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return df.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), how)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def read_index(spark: SparkSession, path: str, keys: list[str], rows: DataFrame, part: str) -> DataFrame:
    """(keys, part, bucket): partitions that may hold a row of each key; more than do, never fewer."""
    wanted = _bucketed(rows.select(*keys, part), keys, 1).limit(0)
    at = f"{path}/{INDEX}"
    return spark.read.schema(wanted.schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], wanted.schema)


def latest_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order of each key; null keys are keys too."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(rows.columns)


def merge(path: str, rows: DataFrame, keys: list[str], order: str, part: str, buckets: int = BUCKETS) -> None:
    """Insert rows or replace those of their keys, whichever partition these are in: one row stays for each key, that of the
    latest order, and of equal ones the row written last. Null keys are keys; a null order comes before all others.

    The same batch again changes nothing, nor does an older batch that comes late. The steps are in such an order that a merge
    that breaks off leaves no key unfound, and repeating it completes it: the index learns where the new rows will be, then
    partitions are replaced, then the index forgets where the old ones were. One merge runs at a time on a table.
    """
    spark = rows.sparkSession
    work = f"{path}/_staged/{uuid.uuid4().hex}"
    try:
        latest_of(rows, keys, [order]).write.parquet(work)  # a batch may not be read twice alike
        new = spark.read.schema(rows.schema).parquet(work)
        mine = _bucketed(new.select(*keys, part), keys, buckets)
        touched = distinct_values(mine, "bucket")
        if not touched:
            return
        index = read_index(spark, path, keys, new, part).where(F.col("bucket").isin(touched))
        before = by_keys(index, mine, keys, "left_semi")
        days = list(dict.fromkeys([*distinct_values(new, part), *distinct_values(before, part)]))
        by_partition(mine, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{INDEX}")

        old = spark.read.schema(new.schema).parquet(path).where(among(part, days)) if has_partitions(spark, path) else new.limit(0)
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = latest_of(both, keys, [order, "_new"]).drop("_new")
        staged = f"{work}-merged"
        merged.write.parquet(staged)
        again = spark.read.schema(new.schema).parquet(staged)
        left = distinct_values(again, part)
        by_partition(again, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        for day in days:
            if day not in left:
                drop(spark, f"{path}/{part}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")

        # Of the batch's keys the index keeps the partition that now holds them; entries of other keys stay.
        held = by_keys(again.select(*keys, part), mine, keys, "left_semi")
        others = by_keys(read_index(spark, path, keys, new, part).where(F.col("bucket").isin(touched)), mine, keys, "left_anti")
        replace_partitions(others.unionByName(_bucketed(held, keys, buckets)), f"{path}/{INDEX}", "bucket")
    finally:
        drop(spark, work)
        drop(spark, f"{work}-merged")


def has_partitions(spark: SparkSession, path: str) -> bool:
    """Whether the table has any partition; its index alone is none."""
    if not exists(spark, path):
        return False
    fs, target = file_system(spark, path)
    return any(not s.getPath().getName().startswith("_") for s in fs.listStatus(target))


def lookup(path: str, wanted: DataFrame, keys: list[str], part: str, schema) -> DataFrame:
    """The rows of the keys in wanted (a batch), read from the partitions that the index names."""
    spark = wanted.sparkSession
    if not has_partitions(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).parquet(path)
    days = distinct_values(by_keys(read_index(spark, path, keys, table, part), wanted, keys, "left_semi"), part)
    return by_keys(table.where(among(part, days)), wanted, keys, "left_semi")


def forget(path: str, rows: DataFrame, keys: list[str], part: str, where: Column) -> None:
    """Take the keys that where holds for (an expression of key columns) out of the index."""
    spark = rows.sparkSession
    index = read_index(spark, path, keys, rows, part)
    touched = distinct_values(index.where(where), "bucket")
    if not touched:
        return
    kept = index.where(F.col("bucket").isin(touched) & ~F.coalesce(where, F.lit(False)))
    left = distinct_values(kept, "bucket")
    if left:
        replace_partitions(kept, f"{path}/{INDEX}", "bucket")
    for b in set(touched) - set(left):
        drop(spark, f"{path}/{INDEX}/bucket={b}")
