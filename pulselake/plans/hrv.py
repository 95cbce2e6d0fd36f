"""Heart-rate-variability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.operators import hrv
from pulselake.plans.views import EVENTS, events, rounded


def _rr(spark, d, profile=hrv.DEVICE):
    e = events(spark, d).select("event_id", "user_id", "ts", (40 + F.col("value")).alias("bpm"))
    return hrv.rr_intervals(e, ["user_id"], ["ts", "event_id"], profile=profile)


def _features(spark, d):
    return hrv.time_domain(_rr(spark, d), ["user_id"], ["ts", "event_id"])


def hrv_stress_summary(spark, d):
    out = hrv.rule_focus(hrv.rule_anxiety(hrv.rule_stress(_features(spark, d))))
    return rounded(out)


RR = EVENTS + """,
b AS (SELECT event_id, user_id, ts, 40 + value AS bpm, 60000.0 / (40 + value) AS rr FROM ev WHERE 40 + value > 30 AND 40 + value < 220 AND 60000.0 / (40 + value) BETWEEN 300 AND 2000),
m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY rr, ts, event_id) AS r FROM b),
q AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN rr END) OVER (PARTITION BY user_id) AS med FROM m),
rr AS (SELECT event_id, user_id, ts, bpm, rr FROM q WHERE n <= 5 OR abs(rr - med) / med < 0.30)"""
TIME = RR + """,
d AS (SELECT *, rr - lag(rr) OVER w AS dd, rr + lag(rr) OVER w AS ss FROM rr WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(*) AS n_rr, avg(rr) AS mean_rr, stddev_samp(rr) AS sdnn, sqrt(avg(dd * dd)) AS rmssd,
  100.0 * count(*) FILTER (abs(dd) > 50) / nullif(count(dd), 0) AS pnn50, 100.0 * count(*) FILTER (abs(dd) > 20) / nullif(count(dd), 0) AS pnn20,
  avg(60000.0 / rr) AS hr_mean, stddev_samp(60000.0 / rr) AS hr_std, max(60000.0 / rr) - min(60000.0 / rr) AS hr_range,
  stddev_samp(dd) / sqrt(2) AS sd1, stddev_samp(ss) / sqrt(2) AS sd2 FROM d GROUP BY user_id),
f AS (SELECT user_id, n_rr, """ + ", ".join(f"CASE WHEN n_rr < 5 THEN 0.0 ELSE coalesce({e}, 0) END AS {c}" for c, e in {c: c for c in ("mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "hr_mean", "hr_std", "hr_range")}.items()) + """,
  CASE WHEN n_rr < 5 THEN 0.0 ELSE coalesce(sdnn / mean_rr, 0) END AS cv_rr, CASE WHEN n_rr < 10 THEN 0.0 ELSE coalesce(sd1, 0) END AS sd1, CASE WHEN n_rr < 10 THEN 0.0 ELSE coalesce(sd2, 0) END AS sd2 FROM g)"""
SUMMARY = "WITH " + TIME + """,
s AS (SELECT *, greatest(0, least(100, floor(30.0 + CASE WHEN rmssd < 25 THEN 30 WHEN rmssd < 40 THEN 15 WHEN rmssd > 60 THEN -15 ELSE 0 END + CASE WHEN hr_mean > 90 THEN 20 WHEN hr_mean > 80 THEN 10 WHEN hr_mean < 65 THEN -10 ELSE 0 END + 0.5))) AS stress,
  greatest(0, least(100, floor(30.0 + CASE WHEN rmssd < 20 THEN 30 WHEN rmssd < 35 THEN 15 ELSE 0 END + CASE WHEN hr_mean > 95 THEN 25 ELSE 0 END + 0.5))) AS anx,
  greatest(0, least(100, 60.0 - CASE WHEN hr_mean > 90 THEN 20 WHEN hr_mean > 80 THEN 8 ELSE 0 END - CASE WHEN rmssd < 20 THEN 20 WHEN rmssd < 35 THEN 10 ELSE 0 END)) AS foc FROM f)
SELECT user_id, n_rr, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "hr_mean", "hr_std", "hr_range", "cv_rr", "sd1", "sd2")) + """,
  round(CASE WHEN sd2 = 0 THEN 0.0 ELSE sd1 / sd2 END, 6) AS sd1_sd2, CAST(stress AS DOUBLE) AS stress_score,
  CASE WHEN stress < 25 THEN 'low' WHEN stress < 50 THEN 'moderate' WHEN stress < 75 THEN 'elevated' ELSE 'high' END AS stress_level,
  CAST(anx AS DOUBLE) AS anxiety_index, CAST(foc AS DOUBLE) AS focus_score FROM s"""


def rr_intervals(spark, d):
    return rounded(_rr(spark, d).select("event_id", "user_id", "rr"))


def rr_intervals_train(spark, d):
    return rounded(_rr(spark, d, hrv.TRAIN).select("event_id", "user_id", "rr"))


def hrv_series(spark, d):
    """Spectrum, sample entropy and scaling exponent of each user's beats, week by week, by both profiles (no SQL; the tests have a plain twin)."""
    rr = _rr(spark, d).select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604_800).alias("week"), "ts", "event_id", "rr")
    by, order = ["user_id", "week"], ["ts", "event_id"]
    return rounded(hrv.series_features(rr, by, order).withColumn("profile", F.lit(hrv.DEVICE)).unionByName(hrv.series_features(rr, by, order, hrv.TRAIN).withColumn("profile", F.lit(hrv.TRAIN))))


QUERIES = {"hrv_stress_summary": hrv_stress_summary, "rr_intervals": rr_intervals, "rr_intervals_train": rr_intervals_train, "hrv_series": hrv_series}
ORACLES = {
    "hrv_stress_summary": SUMMARY,
    "rr_intervals": "WITH " + RR + " SELECT event_id, user_id, round(rr, 6) AS rr FROM rr",
    "rr_intervals_train": "WITH " + EVENTS + """, b AS (SELECT event_id, user_id, 60000.0 / (40 + value) AS rr FROM ev WHERE 40 + value > 0),
m AS (SELECT user_id, count(*) AS n, quantile_cont(rr, 0.5) AS med FROM b GROUP BY user_id)
SELECT event_id, user_id, round(rr, 6) AS rr FROM b JOIN m USING (user_id) WHERE rr BETWEEN 300 AND 2000 AND (n <= 5 OR abs(rr - med) / med < 0.30)""",
}
