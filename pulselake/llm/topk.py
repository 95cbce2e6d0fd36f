"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import materialize, table
from pulselake.llm.vectors import by_length

SCALE = 256
#: Vectors of an index shard, queries that meet a shard in one group, and queries that are answered together.
SHARD, ASKED, QUERIES = 8192, 4096, 256
#: Components are quantised to multiples of this.
STEP = 4


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in by_length(batch["x"]):
            if x.shape[1]:
                q = np.floor(SCALE * x).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), pa.array(np.full(len(q), q.shape[1], np.int32)), pa.array([r.tobytes() for r in q], pa.binary())], names=["id", "dim", "v"])


class ImpactIndex:
    """Postings of each dimension in segments of equal quantised value, ordered by descending impact (its size)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        level = np.floor_divide(2 * x + STEP, 2 * STEP)
        impact = np.abs(level)
        doc, dim = np.divmod(np.arange(x.size), x.shape[1])
        order = np.lexsort((doc, level.ravel(), dim, -impact.ravel()))
        doc, dim, level, impact = doc[order], dim[order], level.ravel()[order], impact.ravel()[order]
        new = np.ones(len(order), bool)
        new[1:] = (dim[1:] != dim[:-1]) | (level[1:] != level[:-1])
        begins = np.append(np.flatnonzero(new), len(order))
        self.segments = [(int(impact[a]), int(dim[a]), int(level[a]) * STEP, doc[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True) if impact[a]]
        # How far a vector may be from what has been added for it, once all impacts of at least so much are done; tried at
        # impacts after which half, six tenths and so on of the postings have been added.
        sizes = np.array([len(s[3]) for s in self.segments])
        self.added = np.concatenate([[0], np.cumsum(sizes)])
        self.impacts = sorted({s[0] for s in self.segments}, reverse=True)
        of = np.array([s[0] for s in self.segments])
        upto = {i: int(self.added[np.count_nonzero(of >= i)]) for i in self.impacts}
        shares = [next((i for i in self.impacts if upto[i] >= share * self.added[-1]), None) for share in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
        size, rest = np.abs(level_of(x)), x.astype(float)
        gap = rest - STEP * level_of(x)
        self.residual = {i: np.sqrt(np.where(size >= i, gap**2, rest**2).sum(axis=1)) for i in shares if i is not None}
        self.left_out = 0  # postings that searches had no need of

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, exact scores) of the k best rows of each query (all, if fewer), ties to smaller ids; a query's own id is left out."""
        n = len(self.x)
        acc = np.zeros((n, len(q)), np.float64)
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        weights = q.T.astype(np.float64)
        stops = set(self.residual)
        mine = ids[:, None] == own[None, :]
        at, possible = 0, np.ones((n, len(q)), bool)
        for impact in self.impacts:
            while at < len(self.segments) and self.segments[at][0] == impact:
                _, dim, value, docs = self.segments[at]
                acc[docs] += value * weights[dim]
                at += 1
            if impact not in stops or n <= k + 1:
                continue
            slack = self.residual[impact][:, None] * norm[None, :] * (1 + 1e-9) + 1e-6
            low = np.where(mine, -np.inf, acc - slack)
            least = np.partition(low, n - k, axis=0)[n - k]  # a k-th best score is at least this
            possible = acc + slack >= least[None, :]  # proven: no other row can be among the k best
            # The possible rows are scored exactly in any case: stop when that is less work than the postings left.
            if possible.sum() * self.x.shape[1] <= (self.added[-1] - self.added[at]) * len(q):
                self.left_out += int(self.added[-1] - self.added[at]) * len(q)
                break
        possible &= ~mine
        out = []
        for j in range(len(q)):
            rows = np.flatnonzero(possible[:, j])
            scores = self.x[rows] @ q[j]
            best = np.lexsort((ids[rows], -scores))[:k]
            out.append((rows[best], scores[best]))
        return out


def level_of(x: np.ndarray) -> np.ndarray:
    return np.floor_divide(2 * x + STEP, 2 * STEP)


ANSWERS = pa.schema({"query_id": pa.int64(), "id": pa.int64(), "score": pa.int64()})


def _answer(k: int):
    """A group of one shard and one block of queries: the shard's k best for each query."""

    def run(t: pa.Table) -> pa.Table:
        ask, ids = t["query"].to_numpy(), t["id"].to_numpy()
        if ask.all() or not ask.any():
            return ANSWERS.empty_table()
        x = np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(len(ids), -1)
        index, own, theirs, q = ImpactIndex(x[~ask]), ids[ask], ids[~ask], x[ask]
        best = [y for c in range(0, len(q), QUERIES) for y in index.search(q[c : c + QUERIES], own[c : c + QUERIES], theirs, k)]
        n = [len(r) for r, _ in best]
        return pa.table([pa.array(np.repeat(own, n)), pa.array(np.concatenate([theirs[r] for r, _ in best])), pa.array(np.concatenate([s for _, s in best]).astype(np.int64))], schema=ANSWERS)

    return run


def top_k(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of greatest integer inner product for each query; all, if fewer.

    queries: a condition on id_col. Components become floor(256 x). Rows are dealt into index shards, queries into
    blocks; each pair of a shard and a block is one group, so neither side is broadcast or collected. In a
    group, posting segments (a dimension and a quantised value) are added score at a time by descending impact. After
    half of the postings and each further tenth, Cauchy-Schwarz on what is left of each vector bounds every score and proves
    rows out; the possible rest is scored exactly, and processing stops when that is less work than the postings left. A
    group is one shard and one block of queries, so a task holds that much. The best of all shards are then ranked.

    Vectors null, empty or with null or non-finite components take no part, nor null ids; vectors of another length
    than the query's are no candidates. Rows with one id are one vector: equal ones count once, of
    different ones the shorter, then the bytewise least counts. Ties go to the smaller id. Scores must
    fit a long. An empty table gives no rows; other columns are ignored.
    """
    usable = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    one = usable.mapInArrow(_integers, "id long, dim int, v binary").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("_r"))
    whole = materialize(one.select("id", "_r.dim", "_r.v"), "integers")
    ask = queries(F.col("id"))
    n, n_ask = whole.agg(F.count(F.lit(1)), F.count_if(ask)).first()
    shards, n_blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n_ask / ASKED))
    salt = F.xxhash64("id")
    rows = whole.select("*", F.lit(False).alias("query"), F.pmod(salt, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    asked = whole.where(ask).select("*", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(salt, F.lit(n_blocks)).cast("int").alias("block"))
    best = rows.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(_answer(k), "query_id long, id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
