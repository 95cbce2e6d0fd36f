"""Removal of long word sequences that occur more than once, by FM-indexes over content-defined shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulselake.llm.common import Words, arrow_bytes, blocks, materialize, mix, partitions, set_aside, shingle_hashes, sized, table
from pulselake.llm.fm_index import FMIndex

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: Anchors with more distinct regions than this have their windows counted by hash, one by one, and not indexed.
HOT_REGIONS = 2000


class Regions:
    """The windows of a block of texts, grouped into regions.

    A window's anchor is its run of ANCHOR words with the least hash (the leftmost of equals); it depends on the
    window's words alone, so equal windows have equal anchors. A region is a run of successive windows with one
    anchor, and every window is in just one region.
    """

    def __init__(self, words: Words, window: int):
        h, off = words.hashes, words.offsets
        self.words = words
        n = len(h)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        start = np.arange(max(0, n - window + 1))
        start = start[doc[start] == doc[start + window - 1]] if len(start) else start
        if not len(start):
            self.doc = self.begin = self.end = np.zeros(0, np.int64)
            self.anchor = self.digest = np.zeros(0, np.uint64)
            return
        grams = shingle_hashes(h, min(ANCHOR, window))
        views = np.lib.stride_tricks.sliding_window_view(grams, window - min(ANCHOR, window) + 1)
        least = np.empty(len(start), np.int64)
        for k in range(0, len(start), 1 << 16):
            part = start[k : k + (1 << 16)]
            least[k : k + (1 << 16)] = part + views[part].argmin(axis=1)
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[start[1:]] != doc[start[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        self.doc, self.begin, self.end = doc[start[first]], start[first], start[last] + window
        self.anchor = grams[least[first]]
        self.digest = self.run_hash(self.begin, self.end)

    def run_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.words.hashes
        base = 0x9E3779B97F4A7C15
        up, down = np.full(len(h) + 1, base, np.uint64), np.full(len(h) + 1, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_t"):
            words = Words(*arrow_bytes(part["_t"]), fold=False)
            r = Regions(words, window)
            own = words.offsets[r.doc]
            yield pa.RecordBatch.from_arrays([
                pa.array(r.anchor.view(np.int64)), pa.array(r.digest.view(np.int64)), part["_k"].combine_chunks().take(pa.array(r.doc)),
                pa.array((r.begin - own).astype(np.int32)), pa.array((r.end - own).astype(np.int32)),
            ], names=["anchor", "digest", "k", "s", "e"])

    return run


def _cut(window: int):
    """Of each text, the regions asked for: the words, or for hot anchors the hash of each window (words null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_t", 1 << 20):
            data, off = arrow_bytes(part["_t"])
            words = Words(data, off, fold=False)
            r = Regions(words, window)
            cols: list[list] = [[] for _ in range(6)]
            bounds = np.searchsorted(r.doc, np.arange(part.num_rows + 1))
            wanted_all = part["wanted"].to_pylist()
            hashes = None  # of all windows of the block, once one is asked for
            for row in range(part.num_rows):
                wanted = {(x["anchor"], x["digest"]): (x["m"], x["hot"]) for x in wanted_all[row]}
                own, key = words.offsets[row], part["_k"][row].as_py()
                a, d = r.anchor.view(np.int64), r.digest.view(np.int64)
                for i in range(bounds[row], bounds[row + 1]):
                    m, hot = wanted.pop((int(a[i]), int(d[i])), (0, False))
                    if not m:
                        continue
                    s, e = int(r.begin[i]), int(r.end[i])
                    if hot:
                        if hashes is None:
                            at = np.arange(len(words.hashes) - window + 1)
                            hashes = r.run_hash(at, at + window).view(np.int64)
                        found = [(x - own, int(hashes[x]), None) for x in range(s, e - window + 1)]
                    else:
                        found = [(s - own, None, data[words.begin[s] : words.end[e - 1]].tobytes())]
                    for x, h, text in found:
                        for c, v in zip(cols, (int(a[i]), h, key, x, text, m), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], names=["anchor", "hash", "k", "s", "words", "m"])

    return run


def _whole_anchors(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Tables of whole anchors, of about most_bytes of words, from rows in the order of their anchors."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size < most_bytes:
            continue
        t = pa.concat_tables(held)
        anchor = t["anchor"].to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))  # rows of the last anchor may go on
        if last:
            yield t.slice(0, last)
        held = [t.slice(last)]
        size = held[0].nbytes
    if held:
        yield pa.concat_tables(held)


def _search(window: int, most_bytes: int = 4 << 20):
    """Index the regions of whole anchors, which come in order, and stream them through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_anchors(batches, most_bytes):
            # Words are one space apart at least, so texts may be laid end to end with their offsets.
            words = Words(*arrow_bytes(t["words"]), fold=False)
            keys, starts, weights = t["k"].to_numpy(), t["s"].to_numpy(), t["m"].to_numpy()
            index = FMIndex(words.hashes, words.offsets, weights)
            text, end, length = index.matching_statistics(np.flatnonzero(weights == 1), window)
            hit = length >= window
            text, end, length = text[hit], end[hit], length[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys[text]), pa.array((starts[text] + end - length).astype(np.int32)), pa.array((starts[text] + end).astype(np.int32))], names=["k", "s", "e"])

    return run


def _remove(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_t"):
            n_words, n_removed, kept, changed = [], [], [], []
            lists = part["spans"].to_pylist()
            for text, spans in zip(part["_t"], lists, strict=True):
                words = (text.as_py() or "").encode().split()  # splits at 0x20 and 0x09-0x0D, as WORD does
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array([(x["s"], x["e"]) for x in spans])
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    out = np.cumsum(edge[:-1]) > 0
                    words = [w for w, gone in zip(words, out.tolist(), strict=True) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
                changed.append(n_removed[-1] > 0)
            cols = {f.name: part[f.name].combine_chunks() for f in schema}
            cols |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words of text_col that no repeated window covers, one space apart.

    A window is window successive words of one document; it is repeated if its words also start anywhere else.
    1. Windows are grouped into regions by their anchors (see Regions), with a digest of each region's words. Equal
       regions are counted by a plain aggregation; the whole of a region that occurs twice is repeated.
    2. Regions that occur once, but whose anchor occurs again, may hold repeated windows. They and the
       regions they share an anchor with are sent, once for each distinct region, to shards by anchor. A shard
       builds FM-indexes over them, weighted by how often each occurs, and streams the regions through: backward
       search gives the longest run that ends at each word and occurs twice; runs of window words or more are
       reported. As every window is in one region and equal windows meet in one shard, nothing is missed or
       counted twice. A shard reads its anchors in order and holds few at a time. Windows of an anchor with very many
       regions are not indexed: their hashes are counted by an aggregation that combines before the shuffle.
    3. The reported spans of each document are removed.

    Null or empty text: no words, kept text empty. Fewer words than a window: kept. Very long texts are treated whole;
    rows with equal text (and id) are copies of each other, and so repeat one another. An empty table gives no rows.
    Columns named n_words, n_removed or kept_text are replaced; others stay, also text_col.
    """
    spark = docs.sparkSession
    docs, back = set_aside(docs.drop("n_words", "n_removed", "kept_text"), {"_k", "_t", "spans"})
    text_col = next((n for n, c in back.items() if c == text_col), text_col)
    others = [f for f in docs.schema.fields]
    named = [f for f in docs.columns if f != text_col]
    keyed = docs.withColumns({"_t": F.col(text_col), "_k": F.xxhash64(*[F.col(c) for c in [*named[:1], text_col]])})
    found = materialize(keyed.select("_k", "_t").mapInArrow(_find(window), "anchor long, digest long, k long, s int, e int"), "regions")
    distinct = materialize(found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("k")).where(F.lit(True)), "distinct")
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("m").alias("m0"))
    mixed = per_anchor.where("kinds > 1 and m0 = 1").select("anchor", (F.col("kinds") > HOT_REGIONS).alias("hot"))
    wanted = distinct.join(mixed, "anchor").groupBy("k").agg(F.collect_list(F.struct("anchor", "digest", "m", "hot")).alias("wanted"))
    wanted = materialize(wanted.withColumnRenamed("k", "_k"), "wanted")
    texts = keyed.select("_k", "_t").join(sized(wanted.select("_k")), "_k", "left_semi").dropDuplicates(["_k"])
    cut = texts.join(wanted, "_k").select("_k", "_t", "wanted").mapInArrow(_cut(window), "anchor long, hash long, k long, s int, words binary, m long")
    cut = materialize(cut, "cut")
    indexed = cut.where("words is not null").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    partly = indexed.select("anchor", "k", "s", "words", "m").mapInArrow(_search(window), "k long, s int, e int")
    hot = cut.where("words is null").select("anchor", "hash", "k", "s", "m")
    again = hot.groupBy("anchor", "hash").agg(F.sum("m").alias("n")).where("n > 1").select("anchor", "hash")
    partly = partly.unionByName(hot.where("m = 1").join(again, ["anchor", "hash"]).select("k", "s", (F.col("s") + window).alias("e")))
    wholly = found.join(distinct.where("m > 1").select("anchor", "digest"), ["anchor", "digest"]).select("k", "s", "e")
    spans = wholly.unionByName(partly).distinct().groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = materialize(spans.withColumnRenamed("k", "_k"), "spans")
    touched = sized(spans.select("_k"))
    none = F.lit(None).cast("array<struct<s:int,e:int>>")
    both = keyed.join(touched, "_k", "left_semi").join(spans, "_k").unionByName(keyed.join(touched, "_k", "left_anti").withColumn("spans", none))
    schema = T.StructType(others + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return both.select(*docs.columns, "_t", "spans").mapInArrow(_remove(to_arrow_schema(T.StructType(others))), schema).withColumnsRenamed(back)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
