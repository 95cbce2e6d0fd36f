"""Quality scores from a sparse ensemble of rules over statistics of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulselake.llm.common import Words, arrow_bytes, blocks, materialize, set_aside, table
from pulselake.llm.toxicity import held_out

STATISTICS = ("log_words", "word_length", "capitals", "digits", "symbols", "shouts", "stops", "short_words", "repeated", "distinct", "lines", "beyond_ascii")
#: The bound of the labelled sample that the rules and their weights are fitted on.
MOST_ROWS = 20_000
#: Trees that rules are read from, their depth, and the strength of the penalty on the rules' weights.
TREES, DEPTH, PENALTY = 24, 3, 1e-3
#: Bytes of text whose statistics are worked out together.
BLOCK_BYTES = 4 << 20

_SYMBOLS, _SHOUTS, _STOPS = b"#$%&*+/<=>@[\\]^_`{|}~", b"!?", b".,;:"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table_of(chars) -> bytes:
        return bytes(int(b in chars) for b in range(256))

    tables = {"capitals": range(65, 91), "digits": range(48, 58), "symbols": _SYMBOLS, "shouts": _SHOUTS, "stops": _STOPS, "lines": b"\n", "beyond": range(192, 256), "inside": range(128, 192)}
    tables = {n: table_of(c) for n, c in tables.items()}
    for part in blocks(batches, "text", BLOCK_BYTES):
        data, off = arrow_bytes(part["text"])
        raw = data.tobytes()

        def held(n: str) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(np.frombuffer(raw.translate(tables[n]), np.uint8), dtype=np.int64)])  # noqa: B023 - used in this turn only
            return sums[off[1:]] - sums[off[:-1]]  # noqa: B023

        words = Words(data, off, fold=False)
        n, doc = words.counts(), np.repeat(np.arange(part.num_rows), words.counts())
        length = words.end - words.begin
        per = lambda x: np.bincount(doc, x, part.num_rows)  # noqa: B023, E731
        again = np.zeros(len(doc), bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((words.hashes, doc))
        new = np.ones(len(doc), bool)
        new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (doc[1:] != doc[:-1])
        count, points = np.maximum(n, 1), np.maximum(np.diff(off) - held("inside"), 1)
        figures = {
            "log_words": np.log1p(n), "word_length": per(length) / count, "capitals": held("capitals") / points, "digits": held("digits") / points, "symbols": held("symbols") / count,
            "shouts": held("shouts") / count, "stops": held("stops") / count, "short_words": per(length == 1) / count, "repeated": per(again) / count,
            "distinct": np.where(n > 0, per(new[np.argsort(order)] if len(order) else new) / count, 1.0), "lines": held("lines") / count, "beyond_ascii": held("beyond") / points,
        }
        t = part.drop_columns(["text"])
        for name in STATISTICS:
            t = t.append_column(f"_{name}", pa.array(figures[name], pa.float64()))
        yield from t.to_batches()


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, with a column of doubles _<name> for each of STATISTICS: the logarithm of the number of words
    (runs of non-white-space), bytes a word, shares of capitals, digits and letters beyond ASCII among code points, symbols,
    shouts, stops and line ends a word, shares of words of one byte, of words equal to the one before, and of distinct ones.
    Null and empty texts have no words: 0 everywhere, but all words distinct. Whole texts count."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("text"))
    schema = StructType([*docs.select(kept).schema.fields, *[StructField(f"_{s}", DoubleType()) for s in STATISTICS]])
    return rows.mapInArrow(_statistics, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions low < statistic <= high; weight is added to the logit where it holds."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out &= F.col(f"_{name}") > low
            if high < math.inf:
                out &= F.col(f"_{name}") <= high
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def logit(self) -> Column:
        out = F.lit(self.bias)
        for r in self.rules:
            out += F.when(r.holds(), r.weight).otherwise(0.0)
        return out


def path_rules(model) -> list[Rule]:
    """The paths from the root to every other node of a forest's trees, without repeats, in the order of the trees."""
    found: dict[tuple, Rule] = {}

    def walk(node, path: dict[int, tuple[float, float]]) -> None:
        if path:
            bounds = tuple((STATISTICS[i], *path[i]) for i in sorted(path))
            found.setdefault(bounds, Rule(bounds))
        if node.numDescendants() == 0:
            return
        split = node.split()
        i, at = split.featureIndex(), split.threshold()
        low, high = path.get(i, (-math.inf, math.inf))
        walk(node.leftChild(), path | {i: (low, min(high, at))})
        walk(node.rightChild(), path | {i: (max(low, at), high)})

    for t in model.trees:
        walk(t._call_java("rootNode"), {})
    return list(found.values())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7) -> Ensemble:
    """Rules read off the trees of a random forest on the statistics, weighted by a logistic regression with an L1 penalty, which
    leaves most of them out. Fitted on at most most_rows labelled rows: those of least hashed id, the same in every run.

    Null labels and ids are left out; null text counts as empty. Rows of one id are texts of their own, each with the id's
    label (the largest, where labels repeat). Without rows of both labels the ensemble is the base rate.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    names = [f"_{s}" for s in STATISTICS]
    held = statistics(texts.join(F.broadcast(chosen), "_id"), "_t")  # most_rows rows at most
    ordered = held.orderBy(F.xxhash64("_id"), "_id", *names).limit(most_rows)  # ids may repeat in docs
    sample = materialize(ordered.select("_y", *names).coalesce(1), "sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not n or not pos or pos == n:
        return Ensemble(math.log(((pos or 0) + 0.5) / (n - (pos or 0) + 0.5)), ())
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(sample)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=3, seed=seed).fit(data)
    rules = path_rules(forest)
    if not rules:
        return Ensemble(math.log(pos / (n - pos)), ())
    matrix = sample.select("_y", *[r.holds().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(matrix).select("_y", "_x")
    lasso = LogisticRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=200).fit(matrix)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs without their text, with a score from 0 to 1 as out_col, which replaces a column of that name; others stay. Empty and
    null texts get the score of no words. Whole texts count, however long. Repeated rows score alike; an empty table stays so."""
    own = [f"_{s}" for s in STATISTICS]
    docs, back = set_aside(docs.drop(out_col), {*own, "text"} - {text_col})
    out = statistics(docs, text_col).withColumn(out_col, 1 / (1 + F.exp(-model.logit()))).drop(*own)
    return out.withColumnsRenamed(back)


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
