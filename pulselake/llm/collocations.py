"""Phrases whose words stand together more often than their parts do, counted by tiles of ranked word numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pulselake.llm.common import arrow_bytes, blocks, discard, materialize, partitions, table
from pulselake.llm.token_shards import PIECES, SHARD_BYTES, Vocabulary, buckets_for, lower, marks, numbered, pack, piece_words, runs, unpack, words_of

#: Between pieces of a text stand BREAKS; between the words of a piece, BLANKS.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Occurrences that a tile is meant to hold; side of its dense corner, which is counted by address if a share of it is hit.
TILE, SIDE, FILLED = 1 << 19, 512, 16
#: Salted groups that one group of the next round of a top list takes in.
FAN_IN = 32


SHARD = pa.schema({"shard": pa.int64(), "lang": pa.string(), "n": pa.int64(), "tokens": pa.binary(), "vocabulary": PIECES})
FREQUENT = pa.schema({"lang": pa.string(), "bucket": pa.int32(), "word": pa.string(), "f": pa.int64()})
ANSWERS = pa.schema({"shard": pa.int64(), "part": pa.int32(), "ids": pa.binary()})
_TILES = pa.list_(pa.struct({"tile": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}))
LEVEL = pa.schema({"shard": pa.int64(), "lang": pa.string(), "side": pa.int32(), "words": pa.binary(), "left": pa.binary(), "tiles": _TILES})
FOUND = pa.schema({"lang": pa.string(), "side": pa.int32(), "tile": pa.int32(), "a": pa.int64(), "b": pa.int64(), "f": pa.int64()})


def _shards(lang_col: str, text_col: str, buckets: int):
    """(shard, lang, n, tokens, vocabulary) of each language of each block of texts. Tokens are local word codes from 1 in
    the order of the text, with 0 between pieces."""
    gap, broken = marks(BREAKS + BLANKS), marks(BREAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for part in blocks(batches, text_col, SHARD_BYTES):
            langs = pc.fill_null(part[lang_col].cast(pa.string()), "und")
            for lang in sorted(pc.unique(langs).to_pylist()):
                data, off = arrow_bytes(part.filter(pc.equal(langs, lang))[text_col])
                data = lower(data)
                words, begin, _, at = words_of(data, off, gap)
                if not len(words):
                    continue
                breaks = np.concatenate([[0], np.cumsum(_translated_bool(data, broken))])[begin]
                apart = np.concatenate([[True], breaks[1:] > breaks[:-1]])
                apart[at[:-1][at[:-1] < len(words)]] = True
                vocabulary = Vocabulary(words, buckets)
                tokens = np.zeros(len(words) + int(apart.sum()), np.int64)
                tokens[np.arange(len(words)) + np.cumsum(apart)] = vocabulary.codes + 1
                yield pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "n": len(words), "tokens": pack(tokens), "vocabulary": vocabulary.pieces}], SHARD)
                shard += 1

    return run


def _translated_bool(data: np.ndarray, marked: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(marked), np.uint8)


def _frequent(least: int):
    """Of a bucket's pieces: the words that occur at least so often in all."""

    def run(t: pa.Table) -> pa.Table:
        words, _ = piece_words(t)
        enc = words.dictionary_encode()
        f = np.zeros(len(enc.dictionary), np.int64)
        np.add.at(f, np.asarray(enc.indices), np.concatenate([unpack(x) for x in t["counts"].to_pylist()]))
        keep = np.flatnonzero(f >= least)
        own = enc.dictionary.take(pa.array(keep)).cast(pa.large_string()).cast(pa.string())
        return pa.table([pa.array([t["lang"][0].as_py()] * len(keep), pa.string()), pa.array([t["bucket"][0].as_py()] * len(keep), pa.int32()), own, pa.array(f[keep])], schema=FREQUENT)

    return run


def _answer_words(pieces: pa.Table, known: pa.Table) -> pa.Table:
    """For each piece of a bucket: the ranks of its words in the order of their codes, 0 for words that aren't frequent."""
    if not pieces.num_rows:
        return ANSWERS.empty_table()
    words, n = piece_words(pieces)
    at = pc.index_in(words, value_set=known["word"].combine_chunks().cast(pa.binary()).cast(pa.large_binary()))
    rank = np.concatenate([[0], np.asarray(known["rank"]).astype(np.int64)])
    ids = rank[np.asarray(pc.fill_null(at, -1)).astype(np.int64) + 1]
    cut = np.cumsum(n)[:-1]
    return pa.table([pieces["shard"].cast(pa.int64()), pieces["bucket"].cast(pa.int32()), pa.array([pack(x) for x in np.split(ids, cut)], pa.binary())], schema=ANSWERS)


def _ids(answers: pa.Table) -> np.ndarray:
    """The ids that a shard was answered with, in the order of the parts."""
    if not answers.num_rows:
        return np.zeros(0, np.int64)
    return np.concatenate([unpack(x) for x in answers.sort_by("part")["ids"].to_pylist()])


class Cells:
    """The pairs of a shard: left and right (numbers from 1; 0: none) of each place, distinct and sorted by tile. A pair's tile
    is the remainder of both numbers by the tiles of a side, so that frequent numbers are spread over all tiles; its address in
    the tile is their quotients, which are the smaller the more frequent the numbers are."""

    def __init__(self, left: np.ndarray, right: np.ndarray, side: int):
        self.at = np.flatnonzero((left > 0) & (right > 0))
        a, b = left[self.at] - 1, right[self.at] - 1
        base = int(b.max()) + 1 if len(b) else 1
        tile = a % side * side + b % side
        order = np.lexsort((b, a, tile)) if base * (int(a.max()) + 1 if len(a) else 1) * side * side >= 2**62 else np.argsort((tile * (int(a.max()) + 1 if len(a) else 1) + a) * base + b, kind="stable")
        a, b, tile = a[order], b[order], tile[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        self.cell = np.empty(len(a), np.int64)
        self.cell[order] = np.cumsum(new) - 1
        self.a, self.b, self.tile = a[first], b[first], tile[first]
        self.counts = np.diff(np.append(first, len(a)))

    def pieces(self, side: int) -> list[dict]:
        return [{"tile": t, "a": pack(self.a[i:j] // side), "b": pack(self.b[i:j] // side), "c": pack(self.counts[i:j])} for t, i, j in runs(self.tile)]




def _first_level(shard: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's tokens as ranks, and the pairs of frequent words that stand together."""
    if not shard.num_rows:
        return LEVEL.empty_table()
    rank = np.concatenate([[0], _ids(answers)])
    words, row = rank[unpack(shard["tokens"][0].as_py())], shard.drop_columns("tokens").to_pylist()[0]
    tiles = Cells(words[:-1], words[1:], row["side"]).pieces(row["side"])
    return pa.Table.from_pylist([row | {"words": pack(words), "left": pack(words), "tiles": tiles}], LEVEL)


def _next_level(k: int):
    """From phrases of k - 1 words to their ids as phrases of k words, and the pairs of such a phrase and the word after it."""

    def run(shard: pa.Table, answers: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return LEVEL.empty_table()
        row = shard.to_pylist()[0]
        words, left = unpack(row["words"]), unpack(row["left"])
        n = max(0, len(words) - k + 1)
        cells = Cells(left[:n], words[k - 1 :], row["side"])
        own = np.zeros(len(words), np.int64)  # of the phrase of k words that begins at each place
        own[cells.at] = _ids(answers)[cells.cell]
        n = max(0, len(words) - k)
        both = own[:n] * (own[1 : n + 1] > 0)  # a phrase is frequent only if the two that it begins and ends with are
        return pa.Table.from_pylist([row | {"left": pack(both), "tiles": Cells(both, words[k:], row["side"]).pieces(row["side"])}], LEVEL)

    return run




def tally(a: np.ndarray, b: np.ndarray, c: np.ndarray, least: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of c) of the addresses whose sum is at least least. The corner of small addresses is counted by address in a
    dense array if enough of it is hit; the rest as sorted coordinates."""
    near = (a < side) & (b < side)
    if np.count_nonzero(near) * FILLED < side * side:
        near[:] = False
    out = []
    if near.any():
        # Doubles hold whole numbers up to 2**53.
        sums = np.bincount(a[near] * side + b[near], c[near], side * side).astype(np.int64)
        hit = np.flatnonzero(sums >= least)
        out.append((hit // side, hit % side, sums[hit]))
    a, b, c = a[~near], b[~near], c[~near]
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(c, first) if len(first) else c
    hit = sums >= least
    out.append((a[first][hit], b[first][hit], sums[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _count_tile(least: int):
    def run(t: pa.Table) -> pa.Table:
        a, b, c = (np.concatenate([unpack(x) for x in t[n].to_pylist()]) for n in "abc")
        a, b, f = tally(a, b, c, least)
        tile, side = t["tile"][0].as_py(), t["side"][0].as_py()
        n = len(f)
        return pa.table([pa.array([t["lang"][0].as_py()] * n, pa.string()), pa.array([side] * n, pa.int32()), pa.array([tile] * n, pa.int32()), pa.array(a * side + tile // side), pa.array(b * side + tile % side), pa.array(f)], schema=FOUND)

    return run


def _answer_cells(pieces: pa.Table, known: pa.Table) -> pa.Table:
    """For each piece of a tile: the ids of its pairs, 0 for those that aren't frequent."""
    if not pieces.num_rows:
        return ANSWERS.empty_table()
    side, tile = pieces["side"][0].as_py(), pieces["tile"][0].as_py()
    base = 1 << 31  # of quotients; numbers stay below 2**31 times the tiles of a side
    key = (np.asarray(known["a"]) // side) * base + np.asarray(known["b"]) // side if known.num_rows else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, ids = key[order], np.asarray(known["id"]).astype(np.int64)[order] if known.num_rows else key
    out = []
    for a, b in zip(pieces["a"].to_pylist(), pieces["b"].to_pylist(), strict=True):
        own = unpack(a) * base + unpack(b)
        at = np.searchsorted(key, own)
        hit = np.zeros(len(own), np.int64)
        ok = at < len(key)
        ok[ok] = key[at[ok]] == own[ok]
        hit[ok] = ids[at[ok]]
        out.append(pack(hit))
    return pa.table([pieces["shard"].cast(pa.int64()), pieces["tile"].cast(pa.int32()), pa.array(out, pa.binary())], schema=ANSWERS)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals: lang, n), (words: lang, rank, word, f), (phrases: lang, ranks, f): all phrases of 2 to most_words words that
    occur at least least times within pieces of texts, as ranks of their words, and all such words.

    Words are ranked by frequency in each language. Pairs of ranks are dealt into tiles by their remainders, summed once in
    each shard, and counted tile by tile. The frequent pairs are ranked anew and take the part of words: a phrase of three
    words is a pair of a pair's number and a word's. A longer phrase is frequent only if its parts are, so nothing else is counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = materialize(rows.mapInArrow(_shards("lang", "text", buckets_for(rows)), from_arrow_schema(SHARD)), "shards")
    totals = materialize(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    pieces = shards.select("shard", "lang", F.inline("vocabulary"))
    frequent = pieces.groupBy("lang", "bucket").applyInArrow(_frequent(least), from_arrow_schema(FREQUENT))
    words = materialize(numbered(frequent, ["lang"], [F.desc("f"), "word"], "rank", "words"), "ranks")
    answers = pieces.groupBy("lang", "bucket").cogroup(words.groupBy("lang", "bucket")).applyInArrow(_answer_words, from_arrow_schema(ANSWERS))
    # No more tiles than keep every tile's number an integer; beyond 10**15 words a tile holds more.
    sides = totals.select("lang", F.least(F.lit(40_000), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / TILE)))).cast("int").alias("side"))
    sided = shards.select("shard", "lang", "tokens").join(sides, "lang").select("shard", "lang", "side", "tokens")
    level = materialize(sided.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_first_level, from_arrow_schema(LEVEL)), "level")
    discard(shards)
    found, held = [], words.select("lang", "rank", F.array("rank").alias("ranks"))
    for k in range(2, most_words + 1):
        tiles = level.select("shard", "lang", "side", F.inline("tiles"))
        counted = tiles.groupBy("lang", "tile").applyInArrow(_count_tile(least), from_arrow_schema(FOUND))
        ranked = materialize(numbered(counted, ["lang"], [F.desc("f"), "a", "b"], "id", f"phrases{k}"), f"ids{k}")
        of = held.select("lang", (F.col("rank") - 1).alias("a"), "ranks")
        named = materialize(ranked.join(of, ["lang", "a"]).select("lang", F.col("id").alias("rank"), F.concat("ranks", F.array(F.col("b") + 1)).alias("ranks"), "f"), f"named{k}")
        found.append(named.select("lang", "ranks", "f"))
        held = named.select("lang", "rank", "ranks")
        if k < most_words:
            answers = tiles.groupBy("lang", "tile").cogroup(ranked.groupBy("lang", "tile")).applyInArrow(_answer_cells, from_arrow_schema(ANSWERS))
            done, level = level, materialize(level.select("shard", "lang", "side", "words", "left").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_next_level(k), from_arrow_schema(LEVEL)), "level")
            discard(done)
    discard(level)
    none = spark.createDataFrame([], "lang string, ranks array<bigint>, f bigint")
    return totals, words.select("lang", "rank", "word", "f"), reduce(DataFrame.unionByName, found, none)


def top_rows(df: DataFrame, by: str, order: list, rows: int, salt_by: list[str], out: str = "rank") -> DataFrame:
    """The first rows of each key with their place. Rows are ranked first in many salted groups, then in ever fewer, so that
    no key, however large, is ordered in one task."""
    salts = partitions(df.sparkSession)
    df = df.withColumn("_s", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    while True:
        w = Window.partitionBy(by, "_s").orderBy(*order)
        df = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= rows)
        if salts == 1:
            return df.drop("_s")
        salts = math.ceil(salts / FAN_IN)
        df = df.withColumn("_s", F.pmod("_s", F.lit(salts)))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of a occurrences is cut after its first word, second word and so on into parts of l and r occurrences, and scores
    floor(1000000 a a / (l r)) at the cut where that is least, the earliest of equals. Phrases that stand inside a longer one with
    at least covered per cent of their occurrences are left out. Products are decimals of 38 digits: exact up to 10**16
    occurrences, an error beyond.

    Null language: und. Null and empty texts have no words. Ties go by a, then by the phrase's bytes. Repeated rows count as
    often as they stand. An empty table, and a language without frequent phrases, gives no rows. Other columns are ignored.
    """
    totals, words, phrases = phrase_counts(docs, lang_col, text_col, most_words, least)
    m = F.size("ranks")
    every = phrases.unionByName(words.select("lang", F.array("rank").alias("ranks"), "f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1))).withColumns({"_l": F.slice("ranks", 1, F.col("k")), "_r": F.slice("ranks", F.col("k") + 1, m - F.col("k"))})
    for name, ranks in (("l", "_l"), ("r", "_r")):
        cuts = cuts.join(every.select("lang", F.col("ranks").alias(ranks), F.col("f").alias(name)), ["lang", ranks])
    score = F.expr("(cast(f as decimal(19,0)) * cast(f as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cut = cuts.withColumn("score", score).groupBy("lang", "ranks").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("f").alias("a"))
    # A longer phrase that holds this one and occurs so often holds one of a single word more that occurs as often at least.
    inner = F.array(F.slice("ranks", 1, m - 1), F.slice("ranks", 2, m - 1))
    longer = phrases.where(m > 2).select("lang", F.explode(inner).alias("ranks"), "f").groupBy("lang", "ranks").agg(F.max("f").alias("_longer"))
    own = cut.join(longer, ["lang", "ranks"], "left").where(F.coalesce(100 * F.col("_longer"), F.lit(0)) < covered * F.col("a"))
    own = materialize(own.select("lang", "ranks", "a", "c.l", "c.r", "c.score"), "scored")
    spelt = own.select("lang", "ranks", F.posexplode("ranks").alias("_i", "rank")).join(words.select("lang", "rank", "word"), ["lang", "rank"])
    spelt = spelt.groupBy("lang", "ranks").agg(F.array_sort(F.collect_list(F.struct("_i", "word"))).alias("_w"))  # most_words at most
    named = own.join(spelt, ["lang", "ranks"]).select("lang", F.array_join("_w.word", " ").alias("phrase"), "a", "l", "r", "score")
    first = top_rows(named, "lang", [F.desc("score"), F.desc("a"), "phrase"], top, ["phrase"])
    return first.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # totals: a row for each language


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    out = collocations(table(spark, sf_dir, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))
