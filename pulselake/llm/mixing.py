"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import WORD, materialize, set_aside, sized, table

MAX_EPOCHS = 3
#: Documents in a group within which fractional repetitions are dealt out.
GROUP_ROWS = 512


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space in text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: (_source, source_size, _rows, target). Sources in code-point order, null last, take
    the weights in turn. Targets share the total size by weight; none exceeds max_epochs times its source's size,
    and what a clamped source can't take is shared again among the others until none is above.

    With sources sorted by cap per weight, the clamped ones come first, and the level of the water is the largest
    of (total - caps before) / (weights from here on): it rises with every clamped source and falls after them.
    A source of size 0 gets target 0.
    """
    per = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))).cast("int") + 1))
    per = per.withColumn("_cap", max_epochs * F.col("source_size").cast("double"))
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - before) / left
    per = per.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return per.select("_source", "source_size", "_rows", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, source: str, size: str, key: str, weights: tuple = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """docs with source_size, target and reps (how often the mix repeats the row; 0 drops it).

    A source's epochs (target / size) split into whole repetitions, which every row gets, and a fraction.
    Rows are ordered by a seeded hash of their key within groups of about GROUP_ROWS rows, so that no source,
    however large, meets in one task; in each group the rows whose midpoint lies below the fraction of the group's
    size get one more repetition. A group misses its share by half a row at most, and reruns agree.

    Null source: a source of its own. Null key: hashed as such. Rows of size 0 are repeated but take nothing.
    Rows with equal keys are ordered by size; identical rows are interchangeable. An empty table gives no rows.
    Columns named source_size, target or reps are replaced; others stay.
    """
    docs, back = set_aside(docs, {"source_size", "target", "reps", "_source", "_rows", "_h", "_g", "_ratio", "_w", "_cap", "_level"})
    source, size, key = (next((n for n, c in back.items() if c == x), x) for x in (source, size, key))
    back = {n: c for n, c in back.items() if c not in ("source_size", "target", "reps")}
    targets = materialize(source_targets(docs, source, size, weights, max_epochs), "targets")
    joined = docs.join(sized(targets), docs[source].eqNullSafe(targets["_source"]), "left")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    groups = F.ceil(F.col("_rows") / GROUP_ROWS)
    joined = joined.withColumns({"_h": F.substring(h, 9, 24), "_g": F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), groups), "_ratio": F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))})
    group = Window.partitionBy("_source", "_g")
    ordered = group.orderBy("_h", key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.floor("_ratio")
    midpoint2 = 2 * F.sum(size).over(ordered) - F.col(size)
    extra = F.when(midpoint2 < 2.0 * (F.col("_ratio") - whole) * F.sum(size).over(group), 1).otherwise(0)
    return joined.withColumn("reps", (whole + extra).cast("int")).drop("_source", "_rows", "_h", "_g", "_ratio", *[n for n in docs.columns if n.startswith("__own") and n not in back]).withColumnsRenamed(back)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")), "sizes")
    return mix(sized, "source", "size", "doc_id").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))
