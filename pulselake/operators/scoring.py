"""Tree ensembles as column expressions or over Arrow batches, normalisation, contributors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import sigmoid
from pulselake.operators.features import activity_code

#: Nodes up to which an ensemble becomes one expression; larger ones are walked as arrays, batch by batch.
MOST_EXPRESSION_NODES = 400


def _nodes(tree: dict) -> int:
    return 1 + sum(_nodes(c) for c in tree.get("children", ()))


def _child(tree: dict, node: int) -> dict | None:
    return next((c for c in tree.get("children", ()) if c["nodeid"] == node), None)


def split_name(split: str, features: list[str]) -> str:
    """The feature a node splits on: its name, or f and its number, as models that were trained on arrays are dumped. A feature that is
    itself called so comes first."""
    if split in features:
        return split
    if split[:1] == "f" and split[1:].isdigit() and int(split[1:]) < len(features):
        return features[int(split[1:])]
    raise ValueError(f"a tree splits on {split!r}, which is none of the model's features")


def tree_column(tree: dict | None, missing: str, features: list[str] | None = None) -> Column:
    """One tree as nested conditions; missing names the branch ('yes' or 'no') for null and NaN without a branch of their own."""
    if tree is None:
        return F.lit(0.0)
    if "leaf" in tree:
        return F.lit(float(tree["leaf"]))
    x = F.col(split_name(tree["split"], features) if features else tree["split"])
    to = lambda k: tree_column(_child(tree, tree[k]), missing, features)
    return F.when(x.isNull() | F.isnan(x), to("missing" if "missing" in tree else missing)).when(x < tree["split_condition"], to("yes")).otherwise(to("no"))


def flatten(trees: list[dict], features: list[str], missing: str) -> dict[str, np.ndarray]:
    """Arrays of all nodes: feature (-1: leaf), threshold or leaf value, and the numbers of the three next nodes."""
    rows: list[list] = []

    def add(tree: dict | None) -> int:
        at = len(rows)
        rows.append([-1, 0.0 if tree is None else float(tree.get("leaf", 0.0)), at, at, at])
        if tree is not None and "leaf" not in tree:
            yes, no = add(_child(tree, tree["yes"])), add(_child(tree, tree["no"]))
            empty = tree.get("missing", tree[missing])
            rows[at] = [features.index(split_name(tree["split"], features)), float(tree["split_condition"]), yes, no, yes if empty == tree["yes"] else no]
        return at

    roots = [add(t) for t in trees]
    cols = list(zip(*rows, strict=True))
    return {"roots": np.array(roots), "feature": np.array(cols[0]), "value": np.array(cols[1]), "yes": np.array(cols[2]), "no": np.array(cols[3]), "empty": np.array(cols[4])}


def walk(flat: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum of the leaves that each row of x reaches."""
    at = np.repeat(flat["roots"][None, :], len(x), axis=0)
    while True:
        f = flat["feature"][at]
        if (f < 0).all():
            return flat["value"][at].sum(axis=1)
        v = np.take_along_axis(x, np.maximum(f, 0), axis=1)
        at = np.where(f < 0, at, np.where(np.isnan(v), flat["empty"][at], np.where(v < flat["value"][at], flat["yes"][at], flat["no"][at])))


def tree_sum(model: dict, missing: str) -> Column:
    """Base score and leaves of all trees, without the sigmoid (for models of a quantity). Small ensembles are one expression,
    larger ones are walked as arrays, batch by batch."""
    trees, features, base = model["trees"], model["features"], float(model["baseScore"])
    if sum(map(_nodes, trees)) <= MOST_EXPRESSION_NODES:
        return sum((tree_column(t, missing, features) for t in trees), F.lit(base))
    flat = flatten(trees, features, missing)

    @F.pandas_udf("double")
    def walked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(base + walk(flat, np.stack([c.to_numpy(float) for c in cols], axis=1)))

    return walked(*[F.col(f).cast("double") for f in features])


def score_trees(df: DataFrame, model: dict, out: str = "prob", missing: str = "yes") -> DataFrame:
    """df with the ensemble's probability: sigmoid of the base score and all leaves. model: features, baseScore, trees."""
    return df.withColumn(out, sigmoid(tree_sum(model, missing)))


def raw_value(f: str) -> Column:
    """A feature as a number, missing values as 0; activities by their codes."""
    return F.coalesce(activity_code(F.col(f)) if f == "activity_type" else F.col(f).cast("double"), F.lit(0.0))


def by_deviation(x: Column, mean: Column, std: Column) -> Column:
    """A z-score; 0 where there is no deviation to measure by."""
    return F.when(std > 0, (x - mean) / std).otherwise(0.0)


def normalise(df: DataFrame, stats: DataFrame, by: list[str], model: dict) -> DataFrame:
    """df with the model's features as z-scores: by the user's own figures where their deviation is above 0, else the
    model's; 0 where that is 0 too. stats: (by, feature, mean, std). Missing values count as 0 before."""
    wide = stats.groupBy(*by).pivot("feature", model["features"]).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    j = df.join(wide, by, "left")
    cols = {}
    for f in model["features"]:
        own = F.col(f"{f}_s") > 0
        m = F.when(own, F.col(f"{f}_m")).otherwise(F.lit(float(model["normalization"]["mean"].get(f, 0))))
        s = F.when(own, F.col(f"{f}_s")).otherwise(F.lit(float(model["normalization"]["std"].get(f, 1))))
        cols[f] = by_deviation(raw_value(f), m, s)
    return j.withColumns(cols).drop(*[f"{f}_{x}" for f in model["features"] for x in "ms"])
