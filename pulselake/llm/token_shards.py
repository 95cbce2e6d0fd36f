"""Texts as shards of word codes, and the dictionary that all shards share.

A shard is a block of texts with its own vocabulary. A word is known in its shard by a local code; the vocabulary is dealt by a
hash of the word into buckets, local codes run bucket by bucket, and each bucket's words meet in one group of a shuffle, which
answers every shard with a global number for each of its words. So a word travels once for each shard that holds it, however
often it occurs, and no task sees more than its bucket or its shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import _FOLD, _translated, _word_hashes, materialize, partitions

#: Bytes of text in a shard, about; bytes of input for each bucket of the dictionary, about.
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def marks(chars: bytes) -> bytes:
    """A table for bytes.translate: 1 for each of chars, else 0."""
    return bytes(int(b in chars) for b in range(256))


def words_of(data: np.ndarray, starts: np.ndarray, gap: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes that gap doesn't mark, in texts data[starts[i]:starts[i + 1]]: (words, begins, ends, offsets);
    words[offsets[i]:offsets[i + 1]] are text i's."""
    space = _translated(data, gap).view(bool)
    begin = ~space
    begin[1:] &= space[:-1]
    cut = starts[1:-1]
    cut = cut[cut < len(data)]
    begin[cut] = ~space[cut]  # a text's first byte begins a word even if the text before ends with one
    end = ~space
    end[:-1] &= space[1:]
    last = cut[cut > 0] - 1
    end[last] = ~space[last]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return as_words(data[~space].tobytes(), e - b), b, e, np.searchsorted(b, starts)


def as_words(body: bytes, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of the words that stand one after another in body."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(body)])


def lower(data: np.ndarray) -> np.ndarray:
    return _translated(data, _FOLD)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers of at least 0, plane by plane of their bytes, compressed."""
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    planes = a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(a).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(raw[9:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def runs(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal numbers in a sorted array."""
    values, first = np.unique(a, return_index=True)
    return list(zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(a)][: len(first)], strict=True))


class Vocabulary:
    """The distinct words of a shard: codes (a local code for each word) and pieces, a dict for each bucket with its words in
    the order of their codes and how often each occurs."""

    def __init__(self, words: pa.Array, buckets: int):
        enc = words.dictionary_encode()
        own = enc.dictionary
        off = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1)
        raw = own.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and len(own) else np.zeros(0, np.uint8)
        bucket = (_word_hashes(data, off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        self.codes = code[np.asarray(enc.indices).astype(np.int64)]
        counts = np.bincount(self.codes, minlength=len(own))
        self.pieces = []
        for k, at, to in runs(bucket[order]):
            part = own.take(pa.array(order[at:to]))
            o = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1)
            body = part.buffers()[2].to_pybytes()[o[0] : o[-1]]
            self.pieces.append({"bucket": k, "n_bytes": len(body), "words": pa.compress(body, codec="zstd", asbytes=True), "lengths": pack(np.diff(o)), "counts": pack(counts[at:to])})


#: Type of Vocabulary.pieces.
PIECES = pa.list_(pa.struct({"bucket": pa.int32(), "n_bytes": pa.int64(), "words": pa.binary(), "lengths": pa.binary(), "counts": pa.binary()}))


def piece_words(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The words of all pieces in t, one after another, and how many each piece has."""
    bodies, lengths = [], []
    for n, raw, ls in zip(t["n_bytes"].to_pylist(), t["words"].to_pylist(), t["lengths"].to_pylist(), strict=True):
        bodies.append(pa.decompress(raw, n, codec="zstd", asbytes=True) if n else b"")
        lengths.append(unpack(ls))
    return as_words(b"".join(bodies), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)), np.array([len(x) for x in lengths], np.int64)


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as the session's shuffles have partitions, more for a large input."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Spark puts the size of a table it knows nothing of at 2**63; such are made from memory, in tests.
    return max(partitions(docs.sparkSession), math.ceil(known / BUCKET_BYTES) if known < 1 << 60 else 1)


def numbered(df: DataFrame, by: list[str], order: list, out: str, name: str) -> DataFrame:
    """df, written, with out: from 1 in the given order for each value of by. Ranges of rows are numbered each on its own,
    after the rows that earlier ranges have of the same key; only counts for each range and key meet in one place."""
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(partitions(spark), *by, *order).withColumn("_p", F.spark_partition_id()), name)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return ranged.join(starts, [*by, "_p"]).withColumn(out, F.col("_before") + local).drop("_before", "_p")
