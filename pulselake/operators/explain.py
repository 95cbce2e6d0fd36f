"""Exact attributions of tree ensembles: what each feature adds to a score, by the game that a tree's covers define."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.operators.scoring import flatten


def covers(df: DataFrame, model: dict, missing: str = "yes") -> np.ndarray:
    """How many rows of df reach each node of the model's flattened trees. Tasks count their rows; their counts are summed."""
    flat, features = flatten(model["trees"], model["features"], missing), model["features"]
    size = len(flat["feature"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += _reached(flat, _matrix(batch, features))
        yield pa.RecordBatch.from_pydict({"node": np.arange(size), "n": total})

    counted = df.select(*[F.col(f).cast("double") for f in features]).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in counted.collect():  # a row for each node of the model
        out[r["node"]] = r["n"]
    return out


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch[f].cast(pa.float64()).fill_null(np.nan)) for f in features], axis=1) if batch.num_rows else np.zeros((0, len(features)))


def _reached(flat: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flat["feature"]), np.int64)
    at = np.repeat(flat["roots"][None, :], len(x), axis=0)
    alive = np.ones(at.shape, bool)
    while alive.any():
        np.add.at(total, at[alive], 1)
        f = flat["feature"][at]
        alive &= f >= 0
        v = np.take_along_axis(x, np.maximum(f, 0), axis=1)
        at = np.where(alive, np.where(np.isnan(v), flat["empty"][at], np.where(v < flat["value"][at], flat["yes"][at], flat["no"][at])), at)
    return total


@dataclass(frozen=True)
class Path:
    """A leaf: its value; for each feature on the way to it, the share of the rows at its splits that go this way without looking
    (shares), and the splits themselves as (threshold, whether below it, whether missing values go this way)."""

    value: float
    features: tuple[int, ...]
    shares: tuple[float, ...]
    splits: tuple[tuple[tuple[float, bool, bool], ...], ...]


def paths(flat: dict[str, np.ndarray], cover: np.ndarray) -> list[Path]:
    """All leaves of all trees. At a node that no row has reached, both ways count alike."""
    out: list[Path] = []

    def go(node: int, met: dict[int, tuple[float, tuple]]) -> None:
        f = int(flat["feature"][node])
        if f < 0:
            out.append(Path(float(flat["value"][node]), tuple(met), tuple(s for s, _ in met.values()), tuple(c for _, c in met.values())))
            return
        n = cover[flat["yes"][node]] + cover[flat["no"][node]]
        for way in ("yes", "no"):
            share = cover[flat[way][node]] / n if n else 0.5
            before, splits = met.get(f, (1.0, ()))
            go(int(flat[way][node]), met | {f: (before * share, (*splits, (float(flat["value"][node]), way == "yes", bool(flat["empty"][node] == flat[way][node]))))})

    for root in flat["roots"]:
        go(int(root), {})
    return out


def attributions_of(leaves: list[Path], x: np.ndarray) -> np.ndarray:
    """What each feature adds to each row's sum of leaves: the mean, over all orders of the features, of the change when the feature
    becomes known. With a set known, a leaf counts by whether the row goes its way at the splits of known features, and by the
    shares of the others; so each leaf's part is a sum over sets by size of a product's coefficients."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        goes = []
        for f, splits in zip(leaf.features, leaf.splits, strict=True):
            v = x[:, f]
            goes.append(np.logical_and.reduce([np.where(np.isnan(v), empty, (v < at) == below) for at, below, empty in splits]).astype(float))
        for i, f in enumerate(leaf.features):
            # Coefficients by how many of the other features are known.
            by_size = [np.ones(len(x))]
            for j in range(d):
                if j != i:
                    known, share = goes[j], leaf.shares[j]
                    by_size = [(by_size[k] * share if k < len(by_size) else 0.0) + (by_size[k - 1] * known if k else 0.0) for k in range(len(by_size) + 1)]
            mean = sum(c * (factorial(k) * factorial(d - 1 - k) / factorial(d)) for k, c in enumerate(by_size))
            out[:, f] += leaf.value * (goes[i] - leaf.shares[i]) * mean
    return out


def expected(leaves: list[Path]) -> float:
    """The sum of leaves when nothing is known of a row."""
    return float(sum(p.value * np.prod(p.shares) for p in leaves))


def attributed(df: DataFrame, model: dict, cover: np.ndarray, missing: str = "yes", out: str = "attributions") -> tuple[DataFrame, float]:
    """df with an array of doubles, one for each of the model's features in order; and the expectation. A row's attributions add up to
    its score without sigmoid less base score and expectation. Null and NaN values take a tree's missing branch. A column of
    the name out is replaced; others pass as they came."""
    flat, features = flatten(model["trees"], model["features"], missing), model["features"]
    leaves = paths(flat, cover)
    df = df.drop(out)
    taken = {f: f"_x{i}" for i, f in enumerate(features)}
    while set(taken.values()) & set(df.columns):
        taken = {f: "_" + n for f, n in taken.items()}
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch[n].fill_null(np.nan)) for n in taken.values()], axis=1) if batch.num_rows else np.zeros((0, len(features)))
            got = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(features), pa.int32()), pa.array(attributions_of(leaves, x).ravel()))
            yield batch.drop_columns(list(taken.values())).append_column(out, got)

    rows = df.select("*", *[F.col(f).cast("double").alias(n) for f, n in taken.items()])
    return rows.mapInArrow(run, schema), expected(leaves)


def long_attributions(df: DataFrame, model: dict, keep: list[str], column: str = "attributions") -> DataFrame:
    """(keep, feature, value, x): a row for each feature, as attribution_ranks takes them."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.get(column, F.lit(i)).alias("value"), F.col(f).cast("double").alias("x")) for i, f in enumerate(model["features"])])
    return df.select(*keep, F.inline(rows))


# ---------------------------------------------------------------- gradients of sequence models


def numeric_gradient(logits: Callable[[np.ndarray], np.ndarray], h: float = 1e-4) -> Callable[[np.ndarray, int], np.ndarray]:
    """The gradient that integrated_gradients asks for, by central differences: two calls of the model for each epoch and feature."""

    def gradient(x: np.ndarray, c: int) -> np.ndarray:
        out = np.zeros_like(x)
        for at in np.ndindex(x.shape[1:]):
            up, down = x.copy(), x.copy()
            up[(slice(None), *at)] += h
            down[(slice(None), *at)] -= h
            out[(slice(None), *at)] = (logits(up)[:, :, c].mean(axis=1) - logits(down)[:, :, c].mean(axis=1)) / (2 * h)
        return out

    return gradient


def integrated_gradients(windows: DataFrame, keep: list[str], gradient: Callable[[np.ndarray, int], np.ndarray], classes: int, steps: int = 32, col: str = "x") -> DataFrame:
    """(keep, class, attributions array<array<double>>): how far each epoch's each feature moves the mean logit of a class, on
    the straight way from zeros, a night's median, to the window; they sum to the change of that logit. gradient(x, c) of
    windows (n, length, features) has their shape. Midpoints of steps stretches. Null windows give no rows; null values of a
    window are zeros, which move nothing. Narrow: windows go through in Arrow batches."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keep).schema.fields)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            shapes: dict[tuple, list] = {}
            for i, w in enumerate(pdf[col]):
                x = np.nan_to_num(np.stack([np.asarray(e, float) for e in w])) if len(w) else np.zeros((0, 0))
                shapes.setdefault(x.shape, []).append((i, x))
            for group in shapes.values():
                at, x = [i for i, _ in group], np.stack([x for _, x in group])
                for c in range(classes):
                    mean = sum(gradient(x * ((k + 0.5) / steps), c) for k in range(steps)) / steps if x.size else x
                    out = pdf[keep].iloc[at].reset_index(drop=True)
                    out["class"] = np.int32(c)
                    out["attributions"] = pd.Series([list(a) for a in mean * x], dtype=object)
                    yield out

    return windows.where(F.col(col).isNotNull()).select(*keep, col).mapInPandas(run, f"{fields}, class int, attributions array<array<double>>")


def gradient_importance(attributed: DataFrame, of: str = "feature") -> DataFrame:
    """(class, feature or epoch, importance): mean absolute attribution over all windows and the other of the two."""
    rows = attributed.select("class", F.posexplode("attributions").alias("epoch", "_a")).select("class", "epoch", F.posexplode("_a").alias("feature", "_v"))
    return rows.groupBy("class", of).agg(F.avg(F.abs("_v")).alias("importance"))


def rank_agreement(scores: DataFrame, by: list[str], item: str, a: str, b: str) -> DataFrame:
    """(by, agreement): correlation of the ranks that a and b give the items of a group, equals by item; null for one item. Each row
    is an item of a model, not of the data."""
    rank = lambda x: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(x), item)).cast("double")
    return scores.select(*by, rank(a).alias("_a"), rank(b).alias("_b")).groupBy(*by).agg(F.when(F.count(F.lit(1)) > 1, F.corr("_a", "_b")).alias("agreement"))
