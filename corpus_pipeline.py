"""From raw documents to token ids: toxicity filter, near-duplicate removal, repeated-passage removal, mixing, encoding.

Stages keep the columns of their documents, whatever these are called. A null or empty text scores as a text without words, is
near nothing, loses nothing, and takes part in the mix with size 0 (as often as its source's whole epochs); it encodes to no
tokens. Rows with one id and one text are copies, of which near-duplicate removal keeps every row of the id that stays; they
repeat one another's passages. Ties go to the smaller id. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.bpe import encode
from pulselake.llm.common import free_name, materialize, table
from pulselake.llm.mixing import mix, word_count
from pulselake.llm.ngram_join import keep_one
from pulselake.llm.substring_dedup import remove_repeats
from pulselake.llm.toxicity import fit, held_out, score

#: Documents that score at least this are rejected.
TOXIC = 0.5
#: Text bytes of a block, and bytes of distinct words that a task remembers, in the last stage: half of what encoding alone
#: takes, since executors that ran the stages before it have their heaps and Python workers already.
BLOCK_BYTES, MEMORY_BYTES = 1 << 20, 3 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    own = free_name(docs, "_score")
    return score(docs, fit(docs, labels), out_col=own).where(F.col(own) < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates."""
    return keep_one(docs).select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; texts without any stay as they are."""
    back = {f"__kept{i}": c for i, c in enumerate(docs.columns) if c in ("n_words", "n_removed", "kept_text")}
    out = remove_repeats(docs.withColumnsRenamed({c: n for n, c in back.items()}))
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_words", "n_removed", "kept_text").withColumnsRenamed(back).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    size, rep = free_name(docs, "_size"), free_name(docs, "_rep")
    back = {f"__kept{i}": c for i, c in enumerate(docs.columns) if c in ("source_size", "target", "reps")}
    sized = docs.withColumnsRenamed({c: n for n, c in back.items()}).withColumn(size, word_count(docs["text"]))
    mixed = mix(sized, "source", size, "doc_id").where(F.col("reps") > 0).withColumn(rep, F.explode(F.sequence(F.lit(1), F.col("reps"))))
    return mixed.drop("source_size", "target", "reps").withColumnsRenamed(back).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_le (little-endian unsigned 32-bit ids), and whether they decode to the text."""
    marked = docs.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    out = encode(marked, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES, memory_bytes=MEMORY_BYTES)
    return out.select("doc_id", "source", "n_tokens", "ids_le", (F.xxhash64(F.col("decoded").cast("string")) == F.col("_hash")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: SQL can express neither the classifier nor BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
