"""How a chain of text filters interacts: what each filter removes in every order, from a sparse document-term matrix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from pulselake.llm.common import arrow_bytes, blocks, discard, materialize, table
from pulselake.llm.token_shards import PIECES, SHARD_BYTES, Vocabulary, buckets_for, marks, pack, piece_words, unpack, words_of

#: Words are runs of anything else.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: A: fewest words. B: least distinct words, in per cent. C: most capitals, in per cent of the code points. D: symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
FILTERS = "ABCDE"


def _local_shards(id_type: pa.DataType, part_type: pa.DataType, buckets: int):
    """A row for each block of texts: its rows' ids and parts, what the plain filters need, and the block's document-term matrix
    in compressed rows over local word codes. And the rows' schema."""
    import hashlib

    schema = pa.schema({
        "shard": pa.int64(), "ids": pa.list_(id_type), "parts": pa.list_(part_type), "capitals": pa.list_(pa.int64()), "points": pa.list_(pa.int64()), "symbols": pa.list_(pa.bool_()),
        "digests": pa.list_(pa.binary()), "starts": pa.binary(), "terms": pa.binary(), "counts": pa.binary(), "vocabulary": PIECES,
    })
    gap, capital, symbol = marks(SPACE), marks(bytes(range(65, 91))), marks(SYMBOLS)
    inside = bytes(int(b & 0xC0 == 0x80) for b in range(256))  # bytes that continue a code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for part in blocks(batches, "text", SHARD_BYTES):
            data, off = arrow_bytes(part["text"])
            raw = data.tobytes()

            def held(marked: bytes) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(np.frombuffer(raw.translate(marked), np.uint8), dtype=np.int64)])  # noqa: B023 - used in this turn only
                return sums[off[1:]] - sums[off[:-1]]  # noqa: B023

            words, _, _, at = words_of(data, off, gap)
            vocabulary = Vocabulary(words, buckets)
            size = max(1, int(vocabulary.codes.max()) + 1) if len(words) else 1
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))
            cell = np.sort(doc * size + vocabulary.codes)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            counts, cell = np.diff(np.append(first, len(cell))), cell[first]
            starts = np.searchsorted(cell, np.arange(part.num_rows + 1) * size)
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "ids": part["id"].to_pylist(), "parts": part["part"].to_pylist(), "capitals": held(capital), "points": np.diff(off) - held(inside), "symbols": held(symbol) > 0,
                "digests": [hashlib.sha256(raw[i:j]).digest() for i, j in zip(off[:-1], off[1:], strict=True)],
                "starts": pack(starts), "terms": pack(cell % size), "counts": pack(counts), "vocabulary": vocabulary.pieces,
            }], schema)
            shard += 1

    return run, schema


def _number_bucket(t: pa.Table) -> pa.Table:
    """Numbers the distinct words of a bucket from 0; for each piece, the numbers of its words, and how many words there are."""
    words, n = piece_words(t)
    enc = words.dictionary_encode()
    ids = [pack(x) for x in np.split(np.asarray(enc.indices).astype(np.int64), np.cumsum(n)[:-1])]
    return pa.table({"shard": t["shard"].cast(pa.int64()), "bucket": t["bucket"].cast(pa.int32()), "ids": pa.array(ids, pa.binary()), "size": pa.array([len(enc.dictionary)] * t.num_rows, pa.int64())})


def _globally(shard: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's matrix with global word numbers for local codes."""
    if not shard.num_rows:
        return shard
    own = answers.sort_by("bucket")
    of = np.concatenate([np.zeros(0, np.int64), *[first + unpack(ids) for first, ids in zip(own["first"].to_pylist(), own["ids"].to_pylist(), strict=True)]])
    terms = of[unpack(shard["terms"][0].as_py())]
    return shard.set_column(shard.column_names.index("terms"), "terms", pa.array([pack(terms)], pa.binary()))


def document_terms(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """The document-term matrix in shards of compressed sparse rows, written: (shard, ids, parts, capitals, points, symbols,
    digests, starts, terms, counts). Row i of a shard has the words terms[starts[i]:starts[i + 1]] so often as counts says; words
    have one number in all shards. starts, terms and counts are packed (token_shards.unpack).

    Words are numbered bucket by bucket, and a bucket's numbers start after those of the buckets before it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), F.col(text_col).cast("string").alias("text"))
    run, schema = _local_shards(to_arrow_type(rows.schema["id"].dataType), to_arrow_type(rows.schema["part"].dataType), buckets_for(rows))
    local = materialize(rows.mapInArrow(run, from_arrow_schema(schema)), "local-terms")
    numbered = materialize(local.select("shard", F.inline("vocabulary")).groupBy("bucket").applyInArrow(_number_bucket, "shard long, bucket int, ids binary, size long"), "words")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    firsts = numbered.groupBy("bucket").agg(F.max("size").alias("size")).select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    answers = numbered.select("shard", "bucket", "ids").join(F.broadcast(firsts), "bucket")
    kept = local.drop("vocabulary")
    out = materialize(kept.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_globally, kept.schema), "terms")
    discard(local, numbered)
    return out


def _row_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and numbers of entries of the shards' matrices."""
    for batch in batches:
        sums, entries = [], []
        for starts, counts in zip(batch["starts"], batch["counts"], strict=True):
            at, upto = unpack(starts.as_py()), np.concatenate([[0], np.cumsum(unpack(counts.as_py()))])
            entries.append(np.diff(at))
            sums.append(np.diff(upto[at]))
        t = pa.Table.from_batches([batch]).drop_columns(["starts", "counts"])
        t = t.append_column("n_words", pa.array(sums, pa.list_(pa.int64()))).append_column("n_distinct", pa.array(entries, pa.list_(pa.int64())))
        yield from t.to_batches()


def flagged(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, A, B, C, D, E) of each row: whether it fails each filter. A: too few words; B: too few distinct ones; C: too
    many capitals; D: a symbol; E: the text of a smaller id. Null text counts as empty. Nothing is smaller than a null id, nor
    is a null id smaller than any; rows of one id don't fail E by each other. Texts are compared by SHA-256."""
    terms = document_terms(docs, id_col, part_col, text_col)
    plain = ["ids", "parts", "capitals", "points", "symbols", "digests"]
    types = dict(terms.dtypes)
    figures = terms.select(*plain, "starts", "counts").mapInArrow(_row_figures, ", ".join([*(f"{c} {types[c]}" for c in plain), "n_words array<long>", "n_distinct array<long>"]))
    rows = figures.select(F.inline(F.arrays_zip(*plain, "n_words", "n_distinct"))).withColumnsRenamed({"ids": "id", "parts": "part", "digests": "digest"})
    fails = {
        "A": F.col("n_words") < LEAST_WORDS, "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), "D": F.col("symbols"),
    }
    rows = materialize(rows.select("id", "part", "digest", *[c.alias(n) for n, c in fails.items()]), "flags")
    least = rows.groupBy("digest").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_least")
    return rows.join(least, "digest", "left").select("id", "part", *fails, F.coalesce(F.col("_least") < F.col("id"), F.lit(False)).alias("E"))


def audit(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id", filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step (part, filter_order, step): kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Rows are counted by part, failed filters and labels first. What a step removes depends on which filters came before it, not on
    their order: each pair of such a set and a filter is worked out once for each part, and then set into all orders.
    A row is good or toxic if any label row of its id says so; null ids have no labels. Null parts are the empty string. An
    empty table gives no rows. Parts that occur get all their rows, zeros included.
    """
    n = len(filters)
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    held = flags.select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), mask.alias("mask")).join(marked, "id", "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    patterns = held.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("rows"), one("good").alias("good"), one("bad").alias("bad"))

    # (filters before, own bit, orders in which just these come before it)
    sets = [(s, 1 << i, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for i in range(n) for s in range(1 << n) if not s >> i & 1]
    each = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(own).alias("own"), F.lit(w).alias("weight")) for s, own, w in sets])
    seen, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("own")) != 0
    count = lambda c, of="rows": F.sum(F.when(c, F.col(of)).otherwise(0))
    by_set = patterns.select("*", F.inline(each)).groupBy("part", "before", "own", "weight").agg(
        count(~fails & ~seen).alias("kept"), count(fails & ~seen).alias("removed"), count(fails & seen).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~seen, "good").alias("good_lost"), count(fails & ~seen, "bad").alias("toxic_lost"))
    by_set = by_set.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(Window.partitionBy("part", "own")))
    orders = [("".join(filters[i] for i in o), k + 1, sum(1 << i for i in o[:k]), 1 << o[k]) for o in permutations(range(n)) for k in range(n)]
    # A row for each order and step.
    placed = flags.sparkSession.createDataFrame(sorted(orders), "filter_order string, step int, before int, own int")
    return by_set.join(F.broadcast(placed), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
