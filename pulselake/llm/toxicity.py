"""Toxicity scores from a counterfactually regularised word classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import materialize, partitions, table

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Groups of words that name people, in the languages of the texts; a swap within a group must not move a score. A parameter.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("elderly", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
)
#: The bound of the labelled sample on which the classifier is fitted.
MOST_ROWS = 20_000
#: Words are features if the log-likelihood ratio of their presence and the label exceeds this.
LEAST_G2 = 20.0


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def words_of(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.split(F.lower(text), WORD_GAP, -1))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, groups: tuple = IDENTITY_GROUPS, penalty: float = 10.0, l2: float = 1e-3) -> Model:
    """A logistic classifier on the presence of words, fitted on at most most_rows labelled rows.

    The rows are those of least hashed id, so the sample is the same in every run. Features are all words whose
    log-likelihood ratio with the label over the sample is beyond chance, however many, and the identity words. For each labelled text
    and each identity word in it, the word is swapped for the others of its group, and the squared change of the
    score's logit is penalised along with the loss: what labels say about texts that happen to mention a group
    can't settle on the group's name.
    The texts are read once, for the sample, which is written. Only its (row, feature) numbers reach the driver: at most
    most_rows times the features.
    Null labels and ids are left out, null text counts as empty; rows of docs with one id are texts of their own, each with
    the id's label (the largest, where labels repeat), and count among most_rows; without rows of both labels the model is the
    base rate.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    held = texts.join(F.broadcast(chosen), "_id").select("_id", "_y", words_of(F.col("_t")).alias("_w"))  # most_rows ids at most
    sample = materialize(held.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_w")).limit(most_rows).repartition(partitions(docs.sparkSession)), "sample")

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).first()
    n, pos = totals["n"], totals["p"] or 0
    if not n or not pos or pos == n:
        return Model(float(np.log((pos + 0.5) / (n - pos + 0.5))), {})
    per_word = sample.select("_y", F.explode("_w").alias("w")).where("w != ''").groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("_y").cast("double").alias("tp"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    d, t = F.col("df"), F.col("tp")
    g2 = 2 * (part(t, d * pos / n) + part(d - t, d * (n - pos) / n) + part(pos - t, (n - d) * pos / n) + part(n - pos - d + t, (n - d) * (n - pos) / n))
    named = [w for g in groups for w in g]
    best = [r["w"] for r in per_word.where((d >= 5) & (d < n)).withColumn("g2", g2).where(F.col("g2") > LEAST_G2).orderBy(F.desc("g2"), "w").collect()]  # words of the sample that tell labels apart
    vocabulary = list(dict.fromkeys([*best, *named]))
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = sample.select("_y", F.array_intersect("_w", F.array(*map(F.lit, vocabulary))).alias("f")).collect()
    y = np.array([r["_y"] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    feature = np.array([number[w] for r in rows for w in r["f"]], int)

    k = len(vocabulary)
    swaps: list[tuple[int, int]] = []  # (feature that goes, feature that comes) of each counterfactual text
    group_of = {number[w]: [number[x] for x in g if x != w] for g in groups for w in g}
    for r in rows:
        held = {number[w] for w in r["f"]}
        swaps += [(f, k if o in held else o) for f in sorted(held) for o in group_of.get(f, ())]
    # The texts' other words are the same on both sides, so a swap's change of the logit is w[goes] - w[comes]. Where the
    # text holds the word that comes already, nothing comes: feature k, whose weight is 0.
    # Every group takes part with weight one in any case, so that names no labelled text mentions stay equal too.
    swaps += [(a, b) for g in groups for a, b in zip((number[w] for w in g), (number[w] for w in g[1:]), strict=False)]
    goes, comes = np.array(swaps, int).reshape(-1, 2).T

    # Weights are drawn towards each word's own log odds (towards 0 for identity words): a word that always comes with
    # others of its kind then still counts where it stands alone.
    rate = pos / n
    df, tp = np.bincount(feature, minlength=k), np.bincount(feature, y[at], k)
    prior = np.log((tp + rate) / (df - tp + 1 - rate)) - np.log(rate / (1 - rate))
    prior[[number[x] for x in named]] = 0.0
    w, b = prior.copy(), float(np.log(pos / (n - pos)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, 401):
        z = b + np.bincount(at, w[feature], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.bincount(feature, e[at], k) + l2 * (w - prior)
        change = (w[goes] - np.append(w, 0.0)[comes]) * (2 * penalty / len(goes))
        g += np.bincount(goes, change, k) - np.bincount(comes, change, k + 1)[:k]
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {x: float(w[i]) for x, i in number.items() if abs(w[i]) > 1e-6})


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 as out_col, which replaces a column of that name; others stay. Empty and null texts get
    the score of no words. Whole texts count, however long; a word counts once. Repeated rows score alike; an empty
    table stays so."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    logit = F.lit(model.bias)
    if model.weights:
        weight = F.create_map(*[c for w, x in model.weights.items() for c in (F.lit(w), F.lit(x))])
        held = F.array_intersect(F.split(F.lower(text), WORD_GAP, -1), F.array(*map(F.lit, model.weights)))
        logit = F.aggregate(held, F.lit(model.bias), lambda acc, w: acc + F.element_at(weight, w))
    return docs.withColumn(out_col, 1 / (1 + F.exp(-logit)))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
