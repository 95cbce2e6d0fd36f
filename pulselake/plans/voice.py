"""Queries on voice and on sequence models: scores over stand-in figures of turns, and the whole path from samples over tones made of users' numbers;
importances by gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.operators import explain, night, voice
from pulselake.plans.views import events


def voice_scores(spark, d):
    """Arousal and valence of each turn; its figures are stand-ins from its length and numbers."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    n = F.length("text").cast("double")
    figures = c.select("conv_id", "turn", (0.3 * n / (n + 500)).alias("rms_mean"), (F.col("turn") % 9).cast("double").alias("syllable_rate"), ((F.col("conv_id") % 10) / 10).alias("pause_ratio"),
                       (n % 90).alias("pitch_std"), (((F.col("conv_id") * 7 + F.col("turn")) % 10) / 10).alias("voiced_fraction"))
    return voice.composites(figures).select("conv_id", "turn", "arousal", "valence")


def voice_tones(spark, d):
    """For each user a recording of half a second of a tone, a pause of 0.4 s and 0.3 s of the tone: the pauses found, whether the pitch is within
    2 %, whether the pause's frames are unvoiced, and whether the voice counts as steady."""
    # By number and by another key than the distinct's: else the few bytes a user are gathered into one task before they become sound.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    u = events(spark, d).select("user_id").distinct().repartition(parts, F.xxhash64("user_id")).withColumn("hz", 100.0 + 10 * F.pmod("user_id", F.lit(30)))
    i = lambda k: F.when((k < 8000) | (k >= 14400), 0.5 * F.sin(2 * 3.141592653589793 * F.col("hz") * k / 16000)).otherwise(0.0)
    x = u.select("user_id", "hz", F.transform(F.sequence(F.lit(0), F.lit(19199)), i).alias("x"))
    v = voice.voices_in_full(x, ["user_id", "hz"])
    near = F.abs(F.col("pitch_mean") / F.col("hz") - 1) < 0.02
    return v.select("user_id", "pauses", near.alias("near"), F.col("voiced_fraction").between(0.55, 0.85).alias("pause_unvoiced"), (F.col("valence") < 0.1).alias("steady"))


def gradient_ranks(spark, d):
    """Importance of each feature for each class of a sequence model over whole windows of 41 vectors (here: features are the first four of their
    components, and a class's logit is 1,000 times the product of two of them, next to each other)."""
    import numpy as np

    def gradient(x, c):
        out = np.zeros_like(x)
        out[:, :, c], out[:, :, (c + 1) % 4] = x[:, :, (c + 1) % 4], x[:, :, c]
        return out * (1000 / x.shape[1])

    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 100).alias("night"), F.pmod("vec_id", F.lit(100)).alias("epoch"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("x"))
    windows = night.sequence_windows(v, ["night"], "epoch", "x", stride=night.SEQUENCE)
    found = explain.gradient_importance(explain.integrated_gradients(windows, ["night", "win"], gradient, 4))
    return found.select("class", "feature", F.round("importance", 6).alias("importance"))


QUERIES = {f.__name__: f for f in (voice_scores, voice_tones, gradient_ranks)}
ORACLES = {
    "voice_scores": """WITH f AS (SELECT conv_id, turn, 0.3 * length(text) / (length(text) + 500.0) AS e, CAST(turn % 9 AS DOUBLE) AS s, (conv_id % 10) / 10.0 AS p, CAST(length(text) % 90 AS DOUBLE) AS d, (conv_id * 7 + turn) % 10 AS v
  FROM conversations) SELECT conv_id, turn, CASE WHEN e IS NOT NULL THEN round(greatest(0.0, least(1.0, 0.4 * least(1.0, CAST(e AS DOUBLE) / 0.15) + 0.4 * least(1.0, s / 6) + 0.2 * (1 - CAST(p AS DOUBLE)))), 4) END AS arousal,
  CAST(round(CASE WHEN v < 1 THEN 0.5 ELSE greatest(0.0, least(1.0, d / 60)) END, 4) AS DOUBLE) AS valence FROM f""",
    "voice_tones": "SELECT DISTINCT user_id, CAST(1 AS BIGINT) AS pauses, true AS near, true AS pause_unvoiced, true AS steady FROM events WHERE user_id IS NOT NULL",
    "gradient_ranks": """WITH v AS (SELECT list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE vec_id % 100 < 82), c AS (SELECT unnest(range(4)) AS c), f AS (SELECT unnest(range(4)) AS f)
SELECT CAST(c AS INTEGER) AS class, CAST(f AS INTEGER) AS feature, CAST(round(avg(CASE WHEN f = c OR f = (c + 1) % 4 THEN abs(x[c + 1] * x[(c + 1) % 4 + 1]) * 500 / 41 ELSE 0 END), 6) AS DOUBLE) AS importance FROM v, c, f GROUP BY 1, 2""",
}
