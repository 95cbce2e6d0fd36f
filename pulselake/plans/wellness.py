"""Night, baseline, movement, light, text, scoring, evaluation and recommendation queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.functions import text as T
from pulselake.operators import actigraphy, baseline, evaluation, places, recommend, scoring, sleep
from pulselake.plans.views import EVENTS, STAGES, WINDOWS, events, rounded, stages, table, windows

MINUTE = 60_000
MOVEMENT = ("mean_activity", "std_activity", "max_activity", "min_activity", "p10", "p25", "p50", "p75", "p90", "inactive_minutes", "active_minutes", "very_active_minutes", "day_mean", "night_mean", "day_night_ratio", "longest_rest_period", "rest_period_count", "activity_range", "activity_cv", "activity_entropy")


# ---------------------------------------------------------------- nights, baselines, movement, light


def night_summary(spark, d):
    """A row for each user and day: durations, latency, wake after onset, awakenings, efficiency, quality."""
    n = sleep.quality(sleep.nights(stages(spark, d), ["user_id", "day"], tie="event_id"))
    cols = ("in_bed_min", "sleep_min", "onset_min", "waso_min", "light_min", "deep_min", "rem_min", "awake_min", "efficiency", "fragmentation", "deep_pct", "rem_pct", "quality")
    return rounded(n.select("user_id", "day", "session_start", "session_end", "awakenings", *cols))


def personal_baseline(spark, d):
    return rounded(baseline.baseline(windows(spark, d), least=20))


def baseline_anomalies(spark, d):
    w = windows(spark, d).select("event_id", "user_id", "ts", "hr_mean", "rmssd", "sdnn")
    return rounded(baseline.anomalies(w, baseline.baseline(w, least=20)).select("event_id", "type", "severity", "z"))


def user_normaliser(spark, d):
    return rounded(baseline.normaliser(windows(spark, d), ["user_id"], ["hr_mean", "rmssd", "sdnn"], least=30))


def daily_movement(spark, d):
    """Movement figures of each user's day, from intervals of ten minutes spread over their minutes."""
    s = events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ms").alias("start_ms"), (F.col("ms") + 10 * MINUTE).alias("end_ms"), F.coalesce("k", F.lit(0.0)).alias("count"))
    by = ["user_id", "day"]
    return rounded(actigraphy.daily_features(actigraphy.stretches(s, by), by).select(*by, *MOVEMENT), 10)


def daily_sunlight(spark, d):
    e = events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", (F.col("value") * 30).alias("lux"))
    return rounded(places.sunlight(e, ["user_id", "day"]))


def place_stays(spark, d):
    """Stays, places with labels and their diversity; order-dependent, so the operators are tested on literal cases."""
    p = events(spark, d).select("user_id", "event_id", F.col("ms").alias("ts_ms"), (30 + F.floor(F.coalesce("k", F.lit(0.0)) / 34) * 0.01).alias("lat"), (31 + F.pmod("user_id", F.lit(7)) * 0.01).alias("lon"))
    v = places.stays(p)
    by = ["user_id"]
    return rounded(places.diversity(v, places.place_summary(v, by), by))


# ---------------------------------------------------------------- text


def sentiment_scores(spark, d):
    """Sentiment of what users said; the assistant's turns are not check-ins, so role = 'user' is part of the question."""
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("w", T.tokens(F.coalesce("text", F.lit(""))))
    c = c.withColumn("sentiment", T.sentiment(F.col("w")))
    return rounded(c.select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), "sentiment", S.sentiment_label(F.col("sentiment")).alias("label")))


def emotion_profile(spark, d):
    """Emotion scores of each document, one column each."""
    c = table(spark, d, "documents").withColumn("w", T.tokens(F.coalesce("text", F.lit("")))).withColumn("e", T.emotion_scores(F.col("w")))
    return rounded(c.select("doc_id", *[F.element_at("e", F.lit(k)).alias(k) for k in T.EMOTIONS]))


def scrubbed(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.scrub(F.coalesce("text", F.lit(""))).cast("binary")).alias("scrubbed_md5"))


# ---------------------------------------------------------------- scoring, evaluation, rules

#: A small ensemble with the fields of the exchange format; the queries score line items with it.
MODEL = {
    "features": ["l_quantity", "l_discount", "l_tax"], "baseScore": -0.2,
    "normalization": {"mean": {}, "std": {}},
    "trees": [
        {"nodeid": 0, "split": "l_quantity", "split_condition": 25.0, "yes": 1, "no": 2, "missing": 1, "children": [
            {"nodeid": 1, "leaf": -0.4},
            {"nodeid": 2, "split": "l_discount", "split_condition": 0.05, "yes": 3, "no": 4, "missing": 3, "children": [{"nodeid": 3, "leaf": 0.3}, {"nodeid": 4, "leaf": 0.6}]}]},
        {"nodeid": 0, "split": "l_tax", "split_condition": 0.04, "yes": 1, "no": 2, "missing": 2, "children": [{"nodeid": 1, "leaf": 0.1}, {"nodeid": 2, "leaf": -0.1}]},
    ],
}


def _scored(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return scoring.score_trees(li, MODEL)


def tree_scores(spark, d):
    s = _scored(spark, d).withColumn("score", S.half_up(F.round(F.col("prob") * 100, 6)))
    return rounded(s.select("l_orderkey", "l_linenumber", "prob", "score", S.depression_level(F.col("score")).alias("level")))


def tree_metrics(spark, d):
    """Metrics of the scores for each supplier, against whether the item was returned."""
    p = _scored(spark, d).select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round("prob", 9).alias("p"))
    return rounded(evaluation.binary_metrics(p, ["l_suppkey"], "y", "p", 0.45))


def label_metrics(spark, d):
    p = table(spark, d, "labels").where("quality is not null and toxic is not null").select(F.lit("all").alias("model"), F.col("quality").alias("y"), (1 - F.col("toxic")).cast("double").alias("p"))
    return rounded(evaluation.binary_metrics(p, ["model"], "y", "p"))


def label_confusion(spark, d):
    return evaluation.confusion(table(spark, d, "labels"), "quality", "toxic")


def type_weights(spark, d):
    return rounded(evaluation.class_weights(table(spark, d, "events"), "event_type"))


def price_regression(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("z"))
    return rounded(evaluation.regression_metrics(li, ["l_returnflag"], "y", "z"), 4)


def _state(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id").agg(
        F.avg("value").alias("stress"), F.avg("k").alias("anxiety"), (F.max("value") / 2).alias("sleep_quality"), F.pmod(F.max("event_id"), F.lit(24)).cast("int").alias("hour"),
        (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("sun_progress"), F.count_if(F.col("event_type") == "view").cast("double").alias("sun_minutes"))


def recommendations(spark, d):
    return rounded(recommend.recommend(_state(spark, d), ["user_id"]))


QUERIES = {f.__name__: f for f in (night_summary, personal_baseline, baseline_anomalies, user_normaliser, daily_movement, daily_sunlight, place_stays, sentiment_scores, emotion_profile, scrubbed, tree_scores, tree_metrics, label_metrics, label_confusion, type_weights, price_regression, recommendations)}

# ---------------------------------------------------------------- the same in SQL

_NIGHTS = "WITH " + STAGES + """,
a AS (SELECT *, (end_ms - start_ms) / 60000.0 AS mins, stage NOT IN ('awake', 'out_of_bed', 'unknown') AS zz FROM st),
b AS (SELECT *, coalesce(lag(zz) OVER w, false) AND NOT zz AS woke, coalesce(max(CASE WHEN zz THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS aft FROM a WINDOW w AS (PARTITION BY user_id, day ORDER BY start_ms, event_id)),
g AS (SELECT user_id, day, min(start_ms) AS session_start, max(end_ms) AS session_end, count(*) FILTER (woke) AS awakenings, coalesce(sum(mins) FILTER (stage IN ('awake', 'out_of_bed')), 0.0) AS awake_min,
  coalesce(sum(mins) FILTER (stage IN ('light', 'sleeping')), 0.0) AS light_min, coalesce(sum(mins) FILTER (stage = 'deep'), 0.0) AS deep_min, coalesce(sum(mins) FILTER (stage = 'rem'), 0.0) AS rem_min,
  coalesce(sum(mins) FILTER (aft AND stage = 'awake'), 0.0) AS waso_min, min(start_ms) FILTER (zz) AS onset FROM b GROUP BY 1, 2),
h AS (SELECT *, (session_end - session_start) / 60000.0 AS in_bed_min, light_min + deep_min + rem_min AS sleep_min, coalesce(greatest(0.0, (onset - session_start) / 60000.0), 0.0) AS onset_min FROM g),
i AS (SELECT *, CASE WHEN in_bed_min = 0 THEN 0.0 ELSE sleep_min / in_bed_min END AS efficiency, CASE WHEN sleep_min = 0 THEN 0.0 ELSE awakenings / (sleep_min / 60) END AS fragmentation,
  CASE WHEN sleep_min = 0 THEN 0.0 ELSE deep_min / sleep_min END AS deep_pct, CASE WHEN sleep_min = 0 THEN 0.0 ELSE rem_min / sleep_min END AS rem_pct FROM h),
q AS (SELECT *, 0.25 * greatest(0, least(100, (efficiency - 0.6) / 0.25 * 100)) + 0.20 * greatest(0, least(100, deep_pct / 0.20 * 100)) + 0.15 * greatest(0, least(100, rem_pct / 0.25 * 100))
  + 0.20 * CASE WHEN sleep_min BETWEEN 420 AND 540 THEN 100.0 WHEN sleep_min < 420 THEN greatest(0, least(100, sleep_min / 420 * 100)) ELSE greatest(50, least(100, 100 - (sleep_min - 540) * 0.5)) END
  + 0.10 * greatest(0, least(100, 100 - fragmentation * 25)) + 0.10 * CASE WHEN onset_min <= 15 THEN 100.0 ELSE greatest(0, least(100, 100 - (onset_min - 15) / 15 * 100)) END AS quality FROM i)
SELECT user_id, day, session_start, session_end, awakenings, """ + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("in_bed_min", "sleep_min", "onset_min", "waso_min", "light_min", "deep_min", "rem_min", "awake_min", "efficiency", "fragmentation", "deep_pct", "rem_pct", "quality")) + " FROM q"

_BASE = WINDOWS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN hr_mean > 0 THEN hr_mean END NULLS LAST) <= greatest(1, ceil(count(CASE WHEN hr_mean > 0 THEN 1 END) OVER (PARTITION BY user_id) * 0.1)) AND hr_mean > 0 AS low,
  hour(ts) >= 22 OR hour(ts) < 6 AS night FROM fw),
base AS (SELECT user_id, count(*) AS sample_count, coalesce(avg(hr_mean) FILTER (low), 0.0) AS resting_hr_mean, coalesce(stddev_samp(hr_mean) FILTER (low), 0.0) AS resting_hr_std,
  coalesce(avg(hr_mean) FILTER (night AND hr_mean > 0), avg(hr_mean) FILTER (low), 0.0) AS sleeping_hr_mean, coalesce(avg(rmssd) FILTER (rmssd > 0), 0.0) AS rmssd_mean, coalesce(stddev_samp(rmssd) FILTER (rmssd > 0), 0.0) AS rmssd_std,
  coalesce(avg(sdnn) FILTER (sdnn > 0), 0.0) AS sdnn_mean, coalesce(stddev_samp(sdnn) FILTER (sdnn > 0), 0.0) AS sdnn_std, coalesce(avg(rmssd) FILTER (night AND rmssd > 0), avg(rmssd) FILTER (rmssd > 0), 0.0) AS nocturnal_rmssd_mean
  FROM r GROUP BY 1 HAVING count(*) >= 20)"""
_BASE_COLS = ("resting_hr_mean", "resting_hr_std", "sleeping_hr_mean", "rmssd_mean", "rmssd_std", "sdnn_mean", "sdnn_std", "nocturnal_rmssd_mean")

_MOVE = "WITH " + EVENTS + """,
s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ms AS a, ms + 600000 AS b, coalesce(k, 0.0) AS c FROM ev),
f AS (SELECT user_id, day, min(a) AS t0, max(b) AS t1 FROM s GROUP BY 1, 2),
sp AS (SELECT user_id, day, t0, unnest(range(0, greatest(1, CAST(ceil((t1 - t0) / 60000.0) AS BIGINT)))) AS minute FROM f),
i AS (SELECT s.user_id, s.day, c, CAST(floor((a - t0) / 60000.0) AS BIGINT) AS lo, CAST(ceil((b - t0) / 60000.0) AS BIGINT) AS hi, greatest(1, CAST(ceil((t1 - t0) / 60000.0) AS BIGINT)) AS n FROM s JOIN f ON s.user_id = f.user_id AND s.day = f.day),
p AS (SELECT user_id, day, c / greatest(1, hi - lo) AS v, unnest(range(lo, least(hi, n))) AS minute FROM i),
m AS (SELECT sp.user_id, sp.day, sp.minute, any_value(sp.t0) + sp.minute * 60000 AS mm, coalesce(sum(v), 0.0) AS v FROM sp LEFT JOIN p ON sp.user_id = p.user_id AND sp.day = p.day AND sp.minute = p.minute GROUP BY 1, 2, 3),
x AS (SELECT *, v < 20 AS idle, (mm // 3600000) % 24 BETWEEN 7 AND 21 AS dayt FROM m),
y AS (SELECT *, CASE WHEN idle AND NOT coalesce(lag(idle) OVER (PARTITION BY user_id, day ORDER BY minute), false) THEN 1 ELSE 0 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY minute) AS run FROM y),
rr AS (SELECT user_id, day, max(c) AS longest, count(*) AS runs FROM (SELECT user_id, day, run, count(*) AS c FROM z WHERE idle GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT user_id, day, avg(v) AS mean_activity, stddev_pop(v) AS std_activity, max(v) AS max_activity, min(v) AS min_activity, """ + ", ".join(f"quantile_cont(v, {q / 100}) AS p{q}" for q in (10, 25, 50, 75, 90)) + """,
  count(*) FILTER (v < 20) AS inactive_minutes, count(*) FILTER (v > 200) AS active_minutes, count(*) FILTER (v > 500) AS very_active_minutes, coalesce(avg(v) FILTER (dayt), 0.0) AS day_mean, coalesce(avg(v) FILTER (NOT dayt), 0.0) AS night_mean, max(v) - min(v) AS activity_range FROM z GROUP BY 1, 2),
hb AS (SELECT z.user_id, z.day, least(19, floor((v - min_activity) / ((max_activity - min_activity + 1e-9) / 20))) AS b, count(*) AS c FROM z JOIN g ON z.user_id = g.user_id AND z.day = g.day GROUP BY 1, 2, 3),
he AS (SELECT user_id, day, sum(-(c / t) * log2(c / t)) AS activity_entropy FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id, day) AS DOUBLE) AS t FROM hb) GROUP BY 1, 2)
SELECT g.user_id, g.day, """ + ", ".join(f"round({c}, 10) AS {c}" for c in ("mean_activity", "std_activity", "max_activity", "min_activity", "p10", "p25", "p50", "p75", "p90", "day_mean", "night_mean", "activity_range")) + """,
  round(day_mean / (night_mean + 1), 10) AS day_night_ratio, round(std_activity / (mean_activity + 1e-6), 10) AS activity_cv, round(activity_entropy, 10) AS activity_entropy, active_minutes, very_active_minutes,
  inactive_minutes, coalesce(longest, 0) AS longest_rest_period, coalesce(runs, 0) AS rest_period_count FROM g LEFT JOIN rr ON g.user_id = rr.user_id AND g.day = rr.day JOIN he ON g.user_id = he.user_id AND g.day = he.day"""


def _words(ws) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _map(values: dict) -> str:
    return f"MAP {{{', '.join(f'{_words([k])[1:-1]}: {v}' for k, v in values.items())}}}"


_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z''\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
_SENT = f"""WITH t AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t),
q AS (SELECT conv_id, turn, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS b FROM p),
v AS (SELECT conv_id, turn, sum({_map(T.VALENCE)}[x] * CASE WHEN list_contains({_words(T.NEGATORS)}, b) THEN -0.75 ELSE 1.0 END * coalesce({_map(T.AMPLIFIERS)}[b], 1.0)) AS s FROM q WHERE list_contains({_words(T.VALENCE)}, x) GROUP BY 1, 2),
r AS (SELECT t.conv_id, t.turn, len(w) AS n, coalesce(CAST(s AS DOUBLE), 0.0) AS s FROM t LEFT JOIN v ON t.conv_id = v.conv_id AND t.turn = v.turn), f AS (SELECT conv_id, turn, n, s / sqrt(s * s + 15) AS z FROM r)
SELECT conv_id, turn, n AS n_tokens, round(z, 6) AS sentiment, CASE WHEN z >= 0.3 THEN 'positive' WHEN z >= -0.1 THEN 'neutral' WHEN z >= -0.5 THEN 'concerned' ELSE 'distressed' END AS label FROM f"""
_EMO = f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents), s AS (SELECT doc_id, " + ", ".join(f"least(1.0, len(list_intersect(w, {_words(ws)})) / 2.0) AS {e}" for e, ws in T.EMOTIONS.items()) + " FROM t) SELECT doc_id, " + ", ".join(
    (f"CAST(CASE WHEN greatest({', '.join(T.EMOTIONS)}) = 0 THEN 0.3 ELSE calm END AS DOUBLE) AS calm" if e == "calm" else f"CAST({e} AS DOUBLE) AS {e}") for e in T.EMOTIONS) + " FROM s"

_SCORE = """sc AS (SELECT *, 1 / (1 + exp(-(-0.2 + CASE WHEN l_quantity IS NULL OR l_quantity < 25 THEN -0.4 WHEN l_discount IS NULL OR l_discount < 0.05 THEN 0.3 ELSE 0.6 END + CASE WHEN l_tax < 0.04 THEN 0.1 ELSE -0.1 END))) AS prob FROM lineitem)"""


def _metrics(rows: str, by: str, threshold: float) -> str:
    return f"""WITH {rows},
c AS (SELECT {by}, count(*) FILTER (p >= {threshold} AND y = 1) AS tp, count(*) FILTER (p >= {threshold} AND y <> 1) AS fp, count(*) FILTER (p < {threshold} AND y = 1) AS fn, count(*) FILTER (p < {threshold} AND y <> 1) AS tn FROM d GROUP BY 1),
k AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM d),
u AS (SELECT {by}, sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS np, count(*) FILTER (y <> 1) AS nn FROM k GROUP BY 1),
e AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS chance FROM c)
SELECT e.{by}, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
  round(coalesce(((tp + tn) / n - chance) / nullif(1 - chance, 0), 0), 6) AS kappa, round((s - np * (np + 1) / 2.0) / nullif(CAST(np AS DOUBLE) * nn, 0), 6) AS auc FROM e JOIN u ON e.{by} = u.{by}"""


# The rules' thresholds and priorities, as SQL, for the inputs that _state gives.
_RULES = """WITH """ + EVENTS + """, s AS (SELECT user_id, avg(value) AS stress, avg(k) AS anxiety, max(value) / 2 AS sq, CAST(max(event_id) % 24 AS INTEGER) AS hour, count(*) FILTER (event_type = 'click') / count(*) AS sun, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS sm FROM ev GROUP BY 1),
r AS (""" + " UNION ALL ".join(f"SELECT user_id, {n} AS n, '{i}' AS intervention, '{t}' AS trigger, {p} AS priority FROM s WHERE {c}" for n, (c, i, t, p) in enumerate([
    ("stress >= 70", "breathing_box", "biometric", 0.95), ("stress >= 70", "meditation_grounding", "biometric", 0.85),
    ("stress >= 50 AND stress < 70", "breathing_coherent", "biometric", 0.7), ("stress >= 50 AND stress < 70", "physical_walk", "biometric", 0.6),
    ("anxiety >= 70", "meditation_grounding", "biometric", 0.9), ("anxiety >= 70", "breathing_478", "biometric", 0.85),
    ("anxiety >= 50 AND anxiety < 70", "journaling_expressive", "biometric", 0.6), ("sq < 50", "sleep_wind_down", "pattern", 0.7),
    ("hour BETWEEN 20 AND 23 AND stress > 40", "sleep_wind_down", "schedule", 0.55), ("hour BETWEEN 6 AND 9", "journaling_gratitude", "schedule", 0.3),
    ("sun < 0.5 AND hour BETWEEN 10 AND 14", "outdoor_sunlight", "pattern", 0.8), ("sun < 0.5 AND NOT hour BETWEEN 10 AND 14 AND hour < 15", "outdoor_walk_sunshine", "schedule", 0.6),
    ("sm < 10 AND hour >= 14", "outdoor_sunlight", "pattern", 0.75)])) + """),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, intervention ORDER BY priority DESC, n) AS o FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, n) AS rank FROM b WHERE o = 1)
SELECT user_id, CAST(rank AS INTEGER) AS rank, intervention, trigger, CAST(priority AS DOUBLE) AS priority FROM k WHERE rank <= 3"""

ORACLES = {
    "night_summary": _NIGHTS,
    "personal_baseline": "WITH " + _BASE + " SELECT user_id, sample_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _BASE_COLS) + " FROM base",
    "baseline_anomalies": "WITH " + _BASE + """, j AS (SELECT event_id, rmssd_std, resting_hr_std, (rmssd - rmssd_mean) / nullif(rmssd_std, 0) AS lz, (hr_mean - resting_hr_mean) / nullif(resting_hr_std, 0) AS hz FROM fw JOIN base USING (user_id))
SELECT event_id, 'hrv_low' AS type, CASE WHEN lz < -3 THEN 'high' ELSE 'moderate' END AS severity, round(lz, 6) AS z FROM j WHERE rmssd_std > 0 AND lz < -2
UNION ALL SELECT event_id, 'hr_elevated', CASE WHEN hz > 3 THEN 'high' ELSE 'moderate' END, round(hz, 6) FROM j WHERE resting_hr_std > 0 AND hz > 2""",
    "user_normaliser": "WITH " + WINDOWS + ", l AS (" + " UNION ALL ".join(f"SELECT user_id, '{c}' AS feature, {c} AS x FROM fw" for c in ("hr_mean", "rmssd", "sdnn")) + ") SELECT user_id, feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(x) >= 30",
    "daily_movement": _MOVE,
    "daily_sunlight": "WITH " + EVENTS + """, l AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS h, value * 30 AS lux FROM ev)
SELECT user_id, day, count(*) FILTER (lux >= 1000) AS outdoor_minutes, count(*) FILTER (lux >= 1000 AND h BETWEEN 10 AND 14) AS optimal_minutes, round(greatest(max(lux), 0.0), 6) AS peak_lux, round(coalesce(avg(lux) FILTER (lux >= 1000), 0.0), 6) AS avg_outdoor_lux, round(least(1.0, CAST(count(*) FILTER (lux >= 1000) AS DOUBLE) / 30), 6) AS goal_progress FROM l GROUP BY 1, 2""",
    "scrubbed": "SELECT conv_id, turn, md5(" + functools.reduce(lambda c, pn: f"regexp_replace({c}, '{pn[0]}', '{pn[1]}', 'g')", T.PERSONAL, "coalesce(text, '')") + ") AS scrubbed_md5 FROM conversations",
    "sentiment_scores": _SENT,
    "emotion_profile": _EMO,
    "tree_scores": f"WITH {_SCORE}, z AS (SELECT *, floor(round(prob * 100, 6) + 0.5) AS s FROM sc) SELECT l_orderkey, l_linenumber, round(prob, 6) AS prob, CAST(s AS BIGINT) AS score, CASE WHEN s < 30 THEN 'minimal' WHEN s < 50 THEN 'mild' WHEN s < 70 THEN 'moderate' ELSE 'high' END AS level FROM z",
    "tree_metrics": _metrics(f"{_SCORE}, d AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(prob, 9) AS p FROM sc)", "l_suppkey", 0.45),
    "label_metrics": _metrics("d AS (SELECT 'all' AS model, quality AS y, CAST(1 - toxic AS DOUBLE) AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)", "model", 0.5),
    "label_confusion": "SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2",
    "type_weights": "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((1.0 / n) * count(*) OVER () / sum(1.0 / n) OVER (), 6) AS weight FROM c",
    "price_regression": """WITH d AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1000 AS z FROM lineitem)
SELECT l_returnflag, round(avg(abs(z - y)), 4) AS mae, round(sqrt(avg((z - y) * (z - y))), 4) AS rmse, round(1 - sum((z - y) * (z - y)) / (var_pop(y) * count(y)), 4) AS r2, round(covar_pop(y, z) / (stddev_pop(y) * stddev_pop(z)), 4) AS r, round(regr_slope(y, z), 4) AS slope, round(regr_intercept(y, z), 4) AS intercept FROM d GROUP BY 1""",
    "recommendations": _RULES,
}
