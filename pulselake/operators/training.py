"""Splits, boosted trees, searches and explanations for models of feature tables.

Rows stay in DataFrames; the driver sees metrics, a row for each fold or trial.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 40)) / float(1 << 40)


def leave_one_out(df: DataFrame, group: str) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """(group value, train, test) for each value of group: a subject or a data set, so few."""
    for (v,) in df.select(group).distinct().orderBy(group).collect():
        yield v, df.where(~F.col(group).eqNullSafe(F.lit(v))), df.where(F.col(group).eqNullSafe(F.lit(v)))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0, parts: int = 64) -> DataFrame:
    """Adds fold: within each label and hash part rows are dealt in turn, so that labels are even over folds to within a row
    a part, and no label's rows meet in one task."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    part = F.pmod(h, F.lit(parts))
    w = Window.partitionBy(label, part).orderBy(h, key)
    return df.withColumn("fold", F.pmod(F.row_number().over(w) + part, F.lit(k)).cast("int"))


def subject_split(df: DataFrame, subject: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds is_validation: whole subjects, about share of them, by a seeded hash."""
    return df.withColumn("is_validation", hashed_share(seed, subject) < share)


def nested_split(df: DataFrame, subject: str, fold: str, test: int, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Adds part (train, stop or test): rounds are stopped on subjects of the training folds, never on the test fold."""
    return df.withColumn("part", F.when(F.col(fold) == test, "test").when(hashed_share(seed, subject) < share, "stop").otherwise("train"))


def class_balance(df: DataFrame, label: str) -> float:
    """Negatives over positives, as the weight of a positive row; 1 if either is missing."""
    n, p = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return n / p if n and p else 1.0


def boosted(train: DataFrame, features: list[str], label: str, kind: str = "classifier", weighted: bool = True, rounds: int = 50, depth: int = 4, rate: float = 0.1, stop: str | None = None, seed: int = 42):
    """A fitted pipeline of gradient-boosted trees. Null features count as 0. Classifiers weight positives by
    class_balance; with stop (a boolean column) rounds end when the loss on those rows no longer falls."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    data = train.na.fill(0.0, features)
    common = {"featuresCol": "_x", "labelCol": label, "maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
    if stop:
        common["validationIndicatorCol"] = stop
    if kind == "classifier":
        if weighted:
            data = data.withColumn("_w", F.when(F.col(label) == 1, class_balance(train, label)).otherwise(1.0))
            common["weightCol"] = "_w"
        model = GBTClassifier(**common)
    else:
        model = GBTRegressor(**common)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(data)


def predicted(fitted, df: DataFrame, features: list[str], out: str = "prob") -> DataFrame:
    """df with the probability of label 1, or the value, as out."""
    from pyspark.ml.functions import vector_to_array

    got = fitted.transform(df.na.fill(0.0, features))
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in got.columns else F.col("prediction")
    return got.withColumn(out, value).select(*df.columns, out)


def side_by_side(work: Callable, items: list, parallel: int = 1) -> list:
    """work(item) of each item, so many at a time: Spark runs the jobs of several threads next to one another. In the items' order."""
    if parallel <= 1 or len(items) <= 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(min(parallel, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(work), items))


def cross_validated(df: DataFrame, fold: str, k: int, features: list[str], label: str, parallel: int = 1, **settings) -> DataFrame:
    """Every row with the prediction of the model that never saw its fold. parallel folds are fitted at a time."""
    fitted = side_by_side(lambda i: boosted(df.where(F.col(fold) != i), features, label, **settings), list(range(k)), parallel)
    parts = [predicted(m, df.where(F.col(fold) == i), features) for i, m in enumerate(fitted)]
    return reduce(DataFrame.unionByName, parts)


def transfer_matrix(sets: dict[str, DataFrame], fit: Callable, score: Callable[[object, DataFrame], float]) -> list[tuple[str, str, float]]:
    """(train set, test set, score) for every ordered pair of data sets."""
    return [(a, b, score(m, sets[b])) for a in sets for m in [fit(sets[a])] for b in sets if a != b]


def leak_gap(within: float, across: float) -> float:
    """How much better a score looks within a data set than across sets."""
    return within - across


def swarm(loss: Callable[[dict], float], bounds: dict[str, tuple[float, float]], particles: int = 8, rounds: int = 5, seed: int = 42, inertia: float = 0.7, own: float = 1.5, shared: float = 1.5, parallel: int = 1) -> tuple[dict, float]:
    """Least loss over a box, by particles that are drawn to their own best and the common best place. Each trial is a Spark job; a
    round's particles all move by the best places of the rounds before, so that parallel of them can be tried at a time and
    the result is the same."""
    rng = random.Random(seed)
    names = list(bounds)
    inside = lambda v, n: min(max(v, bounds[n][0]), bounds[n][1])
    at = [{n: rng.uniform(*bounds[n]) for n in names} for _ in range(particles)]
    speed = [dict.fromkeys(names, 0.0) for _ in range(particles)]
    best = list(zip(side_by_side(loss, [dict(p) for p in at], parallel), [dict(p) for p in at], strict=True))
    top = min(best, key=lambda b: b[0])
    for _ in range(rounds):
        for i, p in enumerate(at):
            for n in names:
                speed[i][n] = inertia * speed[i][n] + own * rng.random() * (best[i][1][n] - p[n]) + shared * rng.random() * (top[1][n] - p[n])
                p[n] = inside(p[n] + speed[i][n], n)
        for i, got in enumerate(side_by_side(loss, [dict(p) for p in at], parallel)):
            if got < best[i][0]:
                best[i] = (got, dict(at[i]))
                top = min(top, best[i], key=lambda b: b[0])
    return top[1], top[0]


def pack(loss: Callable[[dict], float], bounds: dict[str, tuple[float, float]], wolves: int = 8, rounds: int = 5, seed: int = 42, parallel: int = 1) -> tuple[dict, float]:
    """Least loss over a box, by a pack that closes in on its three best places; a round moves by those of the rounds before, and
    parallel of its trials run at a time."""
    rng = random.Random(seed)
    names = list(bounds)
    at = [{n: rng.uniform(*bounds[n]) for n in names} for _ in range(wolves)]
    tried = lambda: [(got, i, dict(p)) for i, (got, p) in enumerate(zip(side_by_side(loss, [dict(p) for p in at], parallel), at, strict=True))]
    seen = sorted(tried(), key=lambda x: x[:2])[:3]
    for r in range(rounds):
        a = 2.0 * (1 - r / rounds)
        for p in at:
            for n in names:
                moves = []
                for _, _, leader in seen:
                    pull, spread = a * (2 * rng.random() - 1), 2 * rng.random()
                    moves.append(leader[n] - pull * abs(spread * leader[n] - p[n]))
                p[n] = min(max(sum(moves) / len(moves), bounds[n][0]), bounds[n][1])
        seen = sorted([*seen, *tried()], key=lambda x: x[:2])[:3]
    return seen[0][2], seen[0][0]


# ---------------------------------------------------------------- results of models


def subject_means(pred: DataFrame, subject: str, y: str, p: str, order: str) -> DataFrame:
    """(subject, y, p, n): a subject's mean prediction and its first label by order."""
    return pred.groupBy(subject).agg(F.min_by(y, order).alias(y), F.avg(p).alias(p), F.count(F.lit(1)).alias("n"))


def median_split(df: DataFrame, by: list[str], value: str, out: str = "label") -> DataFrame:
    """Adds out: 1 above the group's median, else 0 (null too). One aggregation, joined back."""
    m = df.groupBy(*by).agg(F.median(value).alias("_m"))
    return df.join(m, by, "left").withColumn(out, F.when(F.col(value) > F.col("_m"), 1).otherwise(0)).drop("_m")


def occlusion(df: DataFrame, features: list[str], score: Callable[[DataFrame, str], DataFrame], key: list[str], base: float = 0.0) -> DataFrame:
    """(feature, effect): mean absolute change of the score when a feature is set to base. score(df, out) adds a score. All
    features are scored in one pass over the rows."""
    out = score(df, "_s0")
    for i, f in enumerate(features):
        kept = out.withColumn("_keep", F.col(f)).withColumn(f, F.lit(base).cast(dict(df.dtypes)[f]))
        out = score(kept, f"_s{i + 1}").withColumn(f, F.col("_keep")).drop("_keep")
    g = out.agg(*[F.avg(F.abs(F.col(f"_s{i + 1}") - F.col("_s0"))).alias(f) for i, f in enumerate(features)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("effect")) for f in features])).alias("_e")).select("_e.*")


def attribution_ranks(attributions: DataFrame, feature: str = "feature", value: str = "value", of: str = "x") -> DataFrame:
    """(feature, importance, rank, direction): mean absolute attribution, its rank, and whether it rises (1) or falls (-1)
    with the feature's value; rows without a value (null or NaN) say nothing on that."""
    x = F.col(of).cast("double")
    g = attributions.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"), F.coalesce(F.covar_pop(value, F.when(~F.isnan(x), x)), F.lit(0.0)).alias("_c"))
    w = Window.orderBy(F.desc("importance"), feature)  # a row for each feature
    return g.withColumns({"rank": F.row_number().over(w), "direction": F.signum("_c").cast("int")}).drop("_c")


def physiological_agreement(ranks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(agreement, n): share of the importance of features whose direction is the expected one, over those that expect one."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col("feature"))
    r = ranks.withColumn("_w", want).where(F.col("_w").isNotNull())
    return r.agg(F.try_divide(F.sum(F.when(F.col("_w") == F.col("direction"), F.col("importance")).otherwise(0.0)), F.sum("importance")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def smallest_within(scores: DataFrame, k: str, score: str, slack: float = 0.01) -> DataFrame:
    """(k, score): the fewest features whose score is within slack of the best. scores: a row for each number of features."""
    best = scores.agg(F.max(score).alias("_b"))
    return scores.join(F.broadcast(best), F.col(score) >= F.col("_b") - slack).agg(F.min_by(F.struct(k, score), k).alias("_r")).select("_r.*")  # one row


def recalibrated(pred: DataFrame, y: str, p: str, key: str, seed: int = 0, out: str = "calibrated") -> DataFrame:
    """Adds out: p by the line y = a p + b that fits the other half of the rows (halves by a hash of key)."""
    half = (hashed_share(seed, key) < 0.5).cast("int")
    d = pred.withColumn("_h", half)
    lines = d.groupBy("_h").agg(F.regr_slope(y, p).alias("_a"), F.regr_intercept(y, p).alias("_b")).withColumn("_h", 1 - F.col("_h"))
    return d.join(F.broadcast(lines), "_h", "left").withColumn(out, F.coalesce(F.col("_a") * F.col(p) + F.col("_b"), F.col(p))).drop("_h", "_a", "_b")  # two rows


# ---------------------------------------------------------------- portable trees


def portable(fitted, features: list[str]) -> dict:
    """A boosted Spark model as the exchange format that the scorers read: nested nodes, leaves scaled by their tree's weight.
    Spark goes left where x <= threshold, the format where x < threshold: thresholds move to the next number up."""
    import math

    model = fitted.stages[-1]

    def node(n, weight: float, counter: list[int]) -> dict:
        own = counter[0]
        counter[0] += 1
        if n.numDescendants() == 0:
            return {"nodeid": own, "leaf": n.prediction() * weight}
        split = n.split()
        left = node(n.leftChild(), weight, counter)
        right = node(n.rightChild(), weight, counter)
        return {"nodeid": own, "split": features[split.featureIndex()], "split_condition": math.nextafter(split.threshold(), math.inf), "yes": left["nodeid"], "no": right["nodeid"], "missing": left["nodeid"], "children": [left, right]}

    # A classifier's probability is sigmoid(2 x margin).
    factor = 2.0 if "Classification" in type(model).__name__ else 1.0
    trees = [node(t._call_java("rootNode"), w * factor, [0]) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return {"features": features, "baseScore": 0.0, "normalization": {"mean": {}, "std": {}}, "trees": trees}


def parity(a: DataFrame, b: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(n, worst): how far two scorings of the same keys are apart."""
    return a.select(*key, F.col(x).alias("_x")).join(b.select(*key, F.col(y).alias("_y")), key).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("_x") - F.col("_y"))).alias("worst"))
