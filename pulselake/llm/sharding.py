"""Contiguous shards of near-equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import materialize, partitions, table

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Deal rows, in the order of id_col, into n_shards contiguous shards of near-equal bytes.

    Range-partitioned rows get local running sums; per-partition totals (one row per partition) give each
    partition's global start. A row belongs to the shard whose equal share of the total holds the row's midpoint.
    Only ids, sizes and checksums are shuffled, never text. Returns id, size, text_crc32, shard, slot.

    Null text counts no bytes and has checksum 0; empty text likewise. Equal and null ids are ordered by checksum
    and size (nulls first); rows equal in all three are interchangeable. An empty table gives no rows. A row larger
    than a share leaves shards empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("_id"), (F.octet_length(raw).cast("long") + overhead).alias("size"), F.crc32(raw).alias("text_crc32"))
    ranged = materialize(rows.repartitionByRange(partitions(spark), "_id", "text_crc32", "size").withColumn("_p", F.spark_partition_id()), "shards")

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (
        ranged.groupBy("_p").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select("_p", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"), F.sum("_bytes").over(everything).alias("_all"))
    )
    local = Window.partitionBy("_p").orderBy("_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"_upto": F.sum("size").over(local), "_nth": F.count(F.lit(1)).over(local)})
        .join(F.broadcast(starts), "_p")  # one row per partition
        .withColumn("_mid2", 2 * (F.col("_byte0") + F.col("_upto")) - F.col("size"))
        .select("_id", "size", "text_crc32", F.least(F.lit(n_shards - 1), F.expr(f"(_mid2 * {n_shards}) div (2 * _all)")).cast("int").alias("shard"), (F.col("_row0") + F.col("_nth") - 1).alias("_g"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_g").alias("_g0"))
    return placed.join(F.broadcast(firsts), "shard").select(  # n_shards rows at most
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_g") - F.col("_g0")).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

