"""Splits, metrics, thresholds and gates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folds(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: all rows of a group share one, by a seeded hash, so that no shuffle or driver list is needed."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(k)).cast("int"))


def binary_metrics(pred: DataFrame, by: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, Matthews' and kappa from confusion counts; AUC by mean ranks."""
    hit = F.col(p) >= threshold
    pos = F.col(y) == 1
    c = pred.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    d = {x: F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn")}
    n = d["tp"] + d["fp"] + d["fn"] + d["tn"]
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    chance = ((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) + (d["fn"] + d["tn"]) * (d["fp"] + d["tn"])) / (n * n)
    acc = (d["tp"] + d["tn"]) / n
    c = c.withColumns({
        "accuracy": acc, "precision": zero(d["tp"], d["tp"] + d["fp"]), "recall": zero(d["tp"], d["tp"] + d["fn"]), "f1": zero(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"]),
        "mcc": zero(d["tp"] * d["tn"] - d["fp"] * d["fn"], F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))), "kappa": zero(acc - chance, 1 - chance),
    })
    # Mean ranks from counts of equal scores: the window runs over distinct scores, not rows.
    per = pred.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("np"))
    w = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0)
    a = per.groupBy(*by).agg(F.sum(F.col("_rank") * F.col("np")).alias("_s"), F.sum("np").cast("double").alias("_p"), F.sum(F.col("n") - F.col("np")).cast("double").alias("_q"))
    a = a.select(*by, F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q")).alias("auc"))
    return c.join(a, by) if by else c.crossJoin(a)  # one row each


def confusion(pred: DataFrame, y: str, z: str) -> DataFrame:
    return pred.groupBy(F.col(y).alias("actual"), F.col(z).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequencies, scaled so that they sum to the number of classes."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return n.withColumn("weight", (1.0 / F.col("n")) * F.count(F.lit(1)).over(every) / F.sum(1.0 / F.col("n")).over(every))


def regression_metrics(pred: DataFrame, by: list[str], y: str, z: str) -> DataFrame:
    e = F.col(z) - F.col(y)
    g = pred.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.try_divide(F.covar_pop(y, z), F.stddev_pop(y) * F.stddev_pop(z)).alias("r"), F.regr_slope(y, z).alias("slope"), F.regr_intercept(y, z).alias("intercept"))
    return g


def pick_threshold(pred: DataFrame, y: str, p: str, by: str = "f1", points: int = 101, digits: int | None = 6) -> DataFrame:
    """(threshold, f1, youden, balanced): the score quantile that is best by one of the three, the least of equals.

    Rows are counted by score first; scores count to so many digits, so that there are a million and one different ones
    at most. digits=None takes them as they are: exact, and the quantiles then hold all different scores in one task. The grid
    of points quantiles reaches the driver; scores find their place in it by halving, as conditions of one expression.
    Null scores are left out.
    """
    score = F.col(p).cast("double") if digits is None else F.round(p, digits)
    s = pred.where(F.col(p).isNotNull()).groupBy(score.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("np"))
    grid = sorted(set(s.agg(F.percentile("_p", F.array(*[F.lit(i / (points - 1)) for i in range(points)]), F.col("n")).alias("g")).first()["g"] or []))
    if not grid:
        return s.sparkSession.createDataFrame([], "threshold double, f1 double, youden double, balanced double")

    def place(low: int, high: int) -> Column:
        """How many of the grid are at most the score, which is from low to high."""
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(F.col("_p") < grid[half], place(low, half)).otherwise(place(half + 1, high))

    c = s.groupBy(place(0, len(grid)).alias("_i")).agg(F.sum("n").alias("n"), F.sum("np").alias("np"))
    every = s.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "_i int, threshold double")
    c = every.join(c, "_i", "full").na.fill(0, ["n", "np"])
    down, all_ = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # points rows and one
    c = c.withColumns({"_hit": F.sum("n").over(down), "_tp": F.sum("np").over(down), "_n": F.sum("n").over(all_), "_all": F.sum("np").over(all_)})
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    recall, fall = zero(F.col("_tp"), F.col("_all")), zero(F.col("_hit") - F.col("_tp"), F.col("_n") - F.col("_all"))
    c = c.where("threshold is not null").select("threshold", zero(2 * F.col("_tp"), F.col("_hit") + F.col("_all")).alias("f1"), (recall - fall).alias("youden"), ((recall + 1 - fall) / 2).alias("balanced"))
    return c.orderBy(F.desc(by), "threshold").limit(1)


def base_rate_threshold(pred: DataFrame, by: list[str], p: str, prior: float) -> DataFrame:
    """(by, threshold): the quantile above which a share of prior lies."""
    return pred.groupBy(*by).agg(F.percentile(p, 1.0 - prior).alias("threshold"))


def class_metrics(pred: DataFrame, by: list[str], y: str, z: str) -> DataFrame:
    """(by, accuracy, macro_f1, weighted_f1, kappa) over any number of classes, from the counts of (actual, predicted). A
    class counts if it is actual or predicted; one without hits has an F1 of 0."""
    c = pred.where(F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(*by, F.col(y).alias("_y"), F.col(z).alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    both = F.explode(F.array(F.struct(F.col("_y").alias("c"), F.col("_n").alias("a"), F.lit(0).cast("long").alias("p")), F.struct(F.col("_z").alias("c"), F.lit(0).cast("long").alias("a"), F.col("_n").alias("p"))))
    e = c.select(*by, F.when(F.col("_y") == F.col("_z"), F.col("_n")).otherwise(0).alias("_t"), both.alias("_e"))
    k = e.groupBy(*by, F.col("_e.c").alias("_c")).agg(F.sum("_e.a").alias("_a"), F.sum("_e.p").alias("_p"), (F.sum(F.when(F.col("_e.a") > 0, F.col("_t")).otherwise(0))).alias("_t"))
    f1 = 2.0 * F.col("_t") / (F.col("_a") + F.col("_p"))
    g = k.groupBy(*by).agg(F.sum("_a").cast("double").alias("_n"), F.sum("_t").cast("double").alias("_hit"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("_a")) / F.sum("_a")).alias("weighted_f1"), F.sum(F.col("_a").cast("double") * F.col("_p")).alias("_e"))
    acc, chance = F.col("_hit") / F.col("_n"), F.col("_e") / (F.col("_n") * F.col("_n"))
    return g.select(*by, acc.alias("accuracy"), "macro_f1", "weighted_f1", F.coalesce(F.try_divide(acc - chance, 1 - chance), F.lit(0.0)).alias("kappa"))


def gate(candidate: DataFrame, champion: DataFrame) -> DataFrame:
    """(model, status): candidates against champions on (model, eval_set_id, value, direction, min_delta, secondary)."""
    j = candidate.alias("a").join(champion.select("model", F.col("eval_set_id").alias("_e"), F.col("value").alias("_v"), F.col("secondary").alias("_s")).alias("b"), "model", "left")
    sign = F.when(F.col("direction") == "min", -1).otherwise(1)
    better = sign * F.col("value") >= sign * F.col("_v") + F.col("min_delta")
    status = F.when(F.col("_v").isNull(), "new").when(F.col("eval_set_id") != F.col("_e"), "not_comparable").when(~better, "worse").when(sign * F.col("secondary") < sign * F.col("_s"), "secondary_regressed").otherwise("pass")
    return j.select("model", status.alias("status"))
