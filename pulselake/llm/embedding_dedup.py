"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosine, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import materialize, partitions, sized, table, whole_groups
from pulselake.llm.components import components
from pulselake.llm.vectors import by_length

COSINE = 0.95
#: Chance that a pair at the threshold itself shares a bucket in no table.
MISS = 0.005
#: Vectors of a bucket that are compared at a time; rows that a task takes in at a time.
BLOCK, ROWS = 512, 8192


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, x) of each row; digest is null for vectors that link with nothing."""
    for batch in batches:
        digest: list = [None] * batch.num_rows
        for rows, x in by_length(batch["x"]):
            for r, v in zip(rows, x + 0.0, strict=True):  # -0.0 becomes 0.0
                if v.any():
                    digest[r] = hashlib.blake2b(v.tobytes(), digest_size=16).hexdigest()
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(digest, pa.string()), batch["x"]], names=["id", "digest", "x"])


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _hash(bits: int, tables: int, seed: int):
    """A row for each table: the bucket; and once for each vector, its buckets and doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for rows, x in by_length(batch["x"]):
                for at in range(0, len(rows), 4096):
                    part, v = rows[at : at + 4096], x[at : at + 4096]
                    signs = v @ planes(v.shape[1], bits, tables, seed) >= 0
                    codes = signs.reshape(len(v), tables, bits) @ place
                    yield pa.RecordBatch.from_arrays([
                        batch["id"].take(pa.array(part)), batch["w"].take(pa.array(part)),
                        pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int64())),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in v], pa.binary()),
                    ], names=["id", "w", "codes", "packed", "v"])

    return run


def _compare(cosine: float):
    """Links in each group of a sorted partition: weighted link counts of each vector (v null), and edges that span the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["t", "code", "dim", "i", "j"], ROWS):
            yield from compared(t)

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([t[c].to_numpy() for c in ("t", "code", "dim", "i", "j")])
        order = np.arange(t.num_rows)
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        begins = np.append(np.flatnonzero(new), len(order))
        ids, ws, own, packed, vectors = t["id"].to_numpy(), t["w"].to_numpy(), t["own"].to_numpy(), t["packed"].combine_chunks(), t["v"].combine_chunks()
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            rows = order[a:b]
            if len(rows) < 2:
                continue
            raw = [vectors[int(r)].as_py() for r in rows]
            x = np.frombuffer(b"".join(raw)).reshape(len(rows), -1)
            norm = np.sqrt((x * x).sum(axis=1))
            cos = (x @ x.T) / (norm[:, None] * norm[None, :])
            codes = np.frombuffer(b"".join(packed[int(r)].as_py() for r in rows), np.int64).reshape(len(rows), -1)
            i, j = np.nonzero(np.triu(cos >= cosine, 1))
            if keys[3, rows[0]] != keys[4, rows[0]]:  # pairs within a block are another group's
                apart = own[rows[i]] != own[rows[j]]
                i, j = i[apart], j[apart]
            table_ = int(keys[0, rows[0]])
            fresh = ~(codes[i, :table_] == codes[j, :table_]).any(axis=1) if table_ else np.ones(len(i), bool)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            w = np.bincount(i, ws[rows[j]], len(rows)) + np.bincount(j, ws[rows[i]], len(rows))
            label = np.arange(len(rows))
            while True:
                low = label.copy()
                np.minimum.at(low, i, label[j])
                np.minimum.at(low, j, label[i])
                if (low == label).all():
                    break
                label = low[low]
            some, tied = np.flatnonzero(w), np.flatnonzero(label != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[rows[some]], ids[rows[tied]]])),
                pa.array([None] * len(some) + ids[rows[label[tied]]].tolist(), pa.int64()),
                pa.array(np.concatenate([w[some].astype(np.int64), np.zeros(len(tied), np.int64)])),
            ], names=["u", "v", "w"])

    return run


def table_count(bits: int, cosine: float, miss: float) -> int:
    """Tables needed for a pair at the threshold to share a bucket but for the chance miss."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS, seed: int = 11) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row.

    Equal vectors are one, with a weight, and link with each other without a comparison. Each is hashed by the signs
    of its products with random hyperplanes; the bits of a bucket grow with the logarithm of the number of vectors,
    so that chance meetings grow in proportion, and the number of tables keeps the chance of a miss at the threshold below
    miss. Buckets of over BLOCK vectors are cut into blocks, and pairs of blocks are compared by a matrix product, so
    none meets whole. A pair is counted in the first table that it shares only; comparisons send on counts and a
    spanning forest, never all pairs. Cosines are exact doubles, so no link found is below the threshold.

    Vectors that are null, zero or hold null or non-finite components link with nothing, as do vectors of different
    lengths with each other. A null id: no links, null component. Ids may repeat: each row counts as a vector of its own,
    whether the vectors of an id are equal or not, and component_id is the least id of the rows that a row is linked
    to by its own vector; kept goes by the id, so all rows with a component's least id are kept. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    named = rows.mapInArrow(_identify, f"id long, digest string, x {rows.schema['x'].dataType.simpleString()}")
    known = materialize(named.select("id", "digest"), "digests")
    usable = known.where("digest is not null and id is not null")
    reps = usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    reps = materialize(reps.withColumn("vertex", F.monotonically_increasing_id()), "vectors")
    n = reps.count()
    bits = max(8, math.ceil(math.log2(max(n, 2))) + 3)
    tables = table_count(bits, cosine, miss)
    once = named.where("digest is not null and id is not null").select("digest", "x").dropDuplicates(["digest"])
    one = once.join(reps, "digest").select(F.col("vertex").alias("id"), "w", "x")
    hashed = one.mapInArrow(_hash(bits, tables, seed), "id long, w long, codes array<long>, packed binary, v binary")
    hashed = materialize(hashed.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "hashed")
    entries = hashed.select("id", "own", F.octet_length("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    full = entries.groupBy("t", "code", "dim").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = entries.join(full, ["t", "code", "dim"]).withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod("own", F.col("nb")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("id", "t", "code", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = dealt.join(hashed.select("id", "w", "packed", "v"), "id")
    found = groups.repartition(partitions(spark), "t", "code", "dim", "i", "j").sortWithinPartitions("t", "code", "dim", "i", "j").mapInArrow(_compare(cosine), "u long, v long, w long")
    found = materialize(found, "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("vertex")).agg(F.sum("w").alias("more"))
    comp = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "vertex")
    least = materialize(comp.join(reps, "vertex").groupBy("component").agg(F.min("rep").alias("least")), "least")
    placed = reps.join(counts, "vertex", "left").join(comp, "vertex", "left").join(sized(least), "component", "left")
    out = known.join(placed, "digest", "left")
    component = F.coalesce("least", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(F.col("w") - 1 + F.coalesce("more", F.lit(0)), F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
