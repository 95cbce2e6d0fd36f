"""Feature windows, model entry points, nights in full, check-ins, joins by time and evaluation, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.functions import text as T
from pulselake.operators import baseline, checkins, evaluation, features, hrv, joins, models, night, signal, sleep, training, windows
from pulselake.plans.hrv import TIME
from pulselake.plans.views import EVENTS, STAGES, events, rounded, stages, table
from pulselake.plans.wellness import _NIGHTS, _SCORE, _SENT, _TOK, _scored, _words

WEEK = 604_800
WIN = ["user_id", "week"]

# ---------------------------------------------------------------- feature windows: a user's week of events


def _weeks(spark, d):
    return events(spark, d).withColumn("week", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / WEEK))


def _master(spark, d):
    e = _weeks(spark, d)
    beats = hrv.rr_intervals(e.select("event_id", *WIN, "ts", (40 + F.col("value")).alias("bpm")), WIN, ["ts", "event_id"])
    time = hrv.time_domain(beats, WIN, ["ts", "event_id"])
    temp = features.temperature(e.select(*WIN, F.col("ms").alias("ts_ms"), (30 + F.col("value") / 20).alias("temperature_c")), WIN)
    steps = e.groupBy(*WIN).agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("step_count"))
    measured = e.where("week % 2 = 0").groupBy(*WIN).agg(F.avg(15 + F.col("k")).alias("direct_rmssd"))
    return features.master(time, WIN, temp, steps, measured, 900)


MASTER = ("mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "hr_mean", "hr_std", "hr_range", "cv_rr", "sd1", "sd2", "temp_mean", "temp_slope", "temp_std", "temp_range", "step_count", "accel_mean", "accel_std")


def feature_master(spark, d):
    """The feature window of each user's week: variability, temperature, steps, activity, measured rmssd where it is far off."""
    return rounded(_master(spark, d).select(*WIN, "n_rr", *MASTER, "activity_type"))


def _leaf(i, v):
    return {"nodeid": i, "leaf": v}


def _split(feature, cut, yes, no, missing="yes"):
    """A node with two leaves, or deeper ones, under new numbers."""
    a = yes if isinstance(yes, dict) else _leaf(1, yes)
    b = no if isinstance(no, dict) else _leaf(2, no)
    a, b = a | {"nodeid": 1}, b | {"nodeid": 2}
    return {"nodeid": 0, "split": feature, "split_condition": cut, "yes": 1, "no": 2, "missing": 1 if missing == "yes" else 2, "children": [a, b]}


STRESS = {
    "features": ["hr_mean", "rmssd", "temp_mean", "step_count"], "baseScore": 0.1, "decisionThreshold": 0.55, "importances": {"rmssd": 0.5, "hr_mean": 0.3, "step_count": 0.2},
    "normalization": {"mean": {"hr_mean": 85.0, "rmssd": 40.0, "temp_mean": 32.5, "step_count": 500.0}, "std": {"hr_mean": 15.0, "rmssd": 20.0, "temp_mean": 1.0, "step_count": 300.0}},
    "trees": [_split("rmssd", 0.03125, 0.6, -0.5), _split("hr_mean", 0.28125, -0.3, 0.7), _split("temp_mean", -0.40625, -0.1, 0.2)],
}
ANXIETY = {"features": ["rmssd", "hr_mean", "activity_type"], "baseScore": 40.0, "normalization": {"mean": {}, "std": {}}, "trees": [_split("rmssd", 30.0, 25.0, -12.0), _split("hr_mean", 90.5, -5.0, 9.0), _split("activity_type", 1.5, 1.0, -3.0)]}
AGE = {
    "features": ["hr_mean", "rmssd", "sdnn"], "baseScore": 35.0, "normalization": {"mean": {"hr_mean": 85.0, "rmssd": 40.0, "sdnn": 90.0}, "std": {"hr_mean": 15.0, "rmssd": 20.0, "sdnn": 40.0}},
    "trees": [_split("rmssd", -0.53125, 12.0, -6.0, "no"), _split("sdnn", 0.21875, 4.25, -3.5, "no"), _split("hr_mean", 0.15625, -2.0, 5.0, "no")],
}
DEPRESSION = {
    "features": ["mean_activity", "inactive_minutes", "age_num"], "baseScore": -0.3, "importances": {"inactive_minutes": 0.6, "mean_activity": 0.4}, "normalization": {"mean": {"mean_activity": 2.0, "inactive_minutes": 500.0}, "std": {}},
    "trees": [_split("mean_activity", 0.25, 0.5, -0.4, "no"), _split("inactive_minutes", 100.5, -0.6, 0.8, "no"), _split("age_num", 0.5, 0.05, -0.05, "no")],
}


FOCUS = {
    "features": ["hr_mean", "rmssd", "sdnn"], "baseScore": 0.2, "normalization": {"mean": {"hr_mean": 85.0, "rmssd": 40.0, "sdnn": 90.0}, "std": {"hr_mean": 15.0, "rmssd": 20.0, "sdnn": 40.0}},
    "trees": [_split("hr_mean", 0.15625, 0.5, -0.6), _split("sdnn", 0.21875, _split("rmssd", -0.53125, -0.4, 0.1), 0.3), _split("rmssd", 0.03125, -0.2, 0.35)],
}


def _numbered(tree: dict, features: list[str]) -> dict:
    """A tree as a model that was trained on arrays is dumped: splits by the features' numbers."""
    if "leaf" in tree:
        return tree
    return tree | {"split": f"f{features.index(tree['split'])}", "children": [_numbered(c, features) for c in tree["children"]]}


def _names(column, field="feature"):
    return F.array_join(F.transform(column, lambda x: x[field]), ",")


def stress_predictions(spark, d):
    """Stress of each feature window, by z-scores of the user's own windows where there are four."""
    m = _master(spark, d)
    stats = baseline.normaliser(m, ["user_id"], STRESS["features"], least=4)
    p = models.predict_stress(m, WIN, STRESS, stats, ["user_id"])
    return rounded(p.select(*WIN, "stress_score", "stress_level", "is_stressed", "confidence", _names("contributors").alias("why"), _names("contributors", "direction").alias("sides")))


def stress_by_rules(spark, d):
    """The fallback, against each user's baseline of the event windows."""
    from pulselake.plans.views import windows as event_windows

    m = _master(spark, d).join(baseline.baseline(event_windows(spark, d), least=20).select("user_id", "rmssd_mean", "rmssd_std", "resting_hr_mean", "resting_hr_std"), "user_id", "left")
    return rounded(models.predict_stress(m, WIN, None).select(*WIN, "stress_score", "stress_level", "is_stressed", "confidence"))


def anxiety_predictions(spark, d):
    return rounded(models.predict_anxiety(_master(spark, d), WIN, ANXIETY))


def focus_predictions(spark, d):
    """Focus of each feature window by trees that were dumped by feature number."""
    dumped = FOCUS | {"trees": [_numbered(t, FOCUS["features"]) for t in FOCUS["trees"]]}
    p = models.predict_focus(_master(spark, d).withColumn("sampen", F.lit(None).cast("double")), WIN, dumped)
    return rounded(p.select(*WIN, "focus_score", "focus_level", _names("elevated").alias("elevated")))


def bio_age(spark, d):
    """Age estimate of each user from the medians of single-event windows."""
    e = events(spark, d)
    w = e.select("user_id", (40 + F.col("value")).alias("hr_mean"), (15 + F.col("k")).alias("rmssd"), (30 + F.col("value")).alias("sdnn"), (60000 / (40 + F.col("value"))).alias("mean_rr"))
    ages = e.groupBy("user_id").agg((20 + F.pmod(F.max("event_id"), F.lit(50))).cast("int").alias("age"))
    p = models.predict_bio_age(w, ["user_id"], AGE, ages)
    return rounded(p.withColumn("note", models.age_gap_text(F.col("ready"), F.col("predicted_age"), F.col("age_gap"))))


def depression_predictions(spark, d):
    """Risk of each user from movement: a user's mean k, minutes between events as idle ones; the age group is missing for some."""
    e = events(spark, d).groupBy("user_id").agg(F.avg("k").alias("mean_activity"), (F.count(F.lit(1)) * 7.0).alias("inactive_minutes"), F.when(F.pmod("user_id", F.lit(3)) != 0, (F.col("user_id") % 2).cast("double")).alias("age_num"), F.count_distinct(F.to_date("ts")).alias("days"))
    p = models.predict_depression(e, ["user_id"], DEPRESSION)
    return rounded(p.select("user_id", "probability", "risk_score", "risk_level", _names("contributors").alias("why"), "data_quality"))


def sustained_anxiety(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.col("ms").alias("ts_ms"), F.col("value").alias("anxiety_index"))
    return models.sustained(e, ["user_id"], above=20.0, minutes=24 * 60).select("event_id", "sustained")


# ---------------------------------------------------------------- nights in full


def _nights(spark, d):
    return sleep.quality(sleep.nights(stages(spark, d), ["user_id", "day"], tie="event_id"))


def sleep_baselines(spark, d):
    return rounded(night.sleep_baseline(_nights(spark, d), ["user_id"]))


def night_analysis(spark, d):
    """Nights with their heart figures, recovery and consistency against the user's own."""
    n = _nights(spark, d)
    heart = night.night_heart(events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (40 + F.col("value")).alias("bpm"), F.col("k").alias("rmssd"), "event_id"), ["user_id", "day"], order=["event_id"])
    usual = night.sleep_baseline(n, ["user_id"]).join(events(spark, d).groupBy("user_id").agg(F.avg("k").alias("nocturnal_rmssd_mean")), "user_id")
    return rounded(night.analysed(n, ["user_id"], heart, ["day"], usual).select("user_id", "day", "avg_hr", "min_hr", "avg_hrv", "max_hrv", "recovery", "consistency"))


def hr_deltas(spark, d):
    """Change of each user's mean from the day before; a day without events is a gap."""
    e = events(spark, d).groupBy("user_id", F.floor(F.col("ms") / 86_400_000).alias("n")).agg(F.avg("value").alias("m"))
    return rounded(night.previous_delta(e, ["user_id"], "n", "m"))


def sleep_weeks(spark, d):
    g = night.sleep_grid(_nights(spark, d).select("user_id", "day", F.round("sleep_min", 6).alias("sleep_min")), ["user_id"], "day", "sleep_min", F.lit("2024-01-29").cast("date"))
    return rounded(g)


def staged_sequences(spark, d):
    """Windows of 41 vectors through a staging model (here: the first four components as logits): class shares of each night."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("night"), F.pmod("vec_id", F.lit(100)).alias("epoch"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("x"))
    staged = night.stage_night(night.sequence_windows(v, ["night"], "epoch", "x"), ["night"], lambda x: x * 10)
    merged = staged.withColumn("three", night.merged_classes(F.col("class")))
    conf = night.night_confidence(merged, ["night"])
    counts = merged.groupBy("night").agg(*[F.count_if(F.col("three") == i).alias(f"c{i}") for i in range(3)])
    return rounded(conf.join(counts, "night"))


# ---------------------------------------------------------------- check-ins


def _checkins(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("w", T.tokens(F.coalesce("text", F.lit(""))))
    return c.withColumns({"who": F.pmod("conv_id", F.lit(20)), "emotions": T.emotion_scores(F.col("w")), "score": T.sentiment(F.col("w"))})


def dominant_feelings(spark, d):
    return checkins.dominant_emotion(checkins.emotion_totals(_checkins(spark, d), ["who"]), ["who"])


def plain_scores(spark, d):
    """The fallback scorer on every document: score and the joy and fatigue it finds."""
    c = table(spark, d, "documents").withColumn("w", T.tokens(F.coalesce("text", F.lit(""))))
    e = checkins.plain_emotions(F.col("w"))
    return rounded(c.select("doc_id", checkins.plain_sentiment(F.col("w")).alias("score"), F.element_at(e, F.lit("joy")).alias("joy"), F.element_at(e, F.lit("fatigue")).alias("fatigue")))


def parsed_replies(spark, d):
    """Replies made of each turn's number: text, then a JSON block that is sometimes broken, unknown or out of range."""
    t = F.col("turn") + F.col("conv_id")
    body = F.concat(F.lit('{"sentiment": "'), F.when(t % 3 == 0, "neutral").otherwise("odd"), F.lit('", "sentimentScore": '), ((t % 7) - 3).cast("string"), F.lit(', "themes": ["work", "x'), (t % 2).cast("string"), F.lit('"], "emotions": {"joy": '), (t % 3).cast("string"), F.lit("}}"))
    reply = F.when(t % 5 == 0, F.concat(F.lit(" plain "), F.col("turn").cast("string"))).when(t % 5 == 1, F.lit("hi ```json {broken ```")).otherwise(F.concat(F.lit("hello ```json "), body, F.lit(" ```")))
    r = table(spark, d, "conversations").select("conv_id", "turn", checkins.parsed_reply(reply).alias("r"))
    return rounded(r.select("conv_id", "turn", "r.empathy", "r.sentiment", "r.sentiment_score", F.array_join("r.themes", ",").alias("themes"), "r.intensity", F.element_at("r.emotions", F.lit("joy")).alias("joy")))


def checkin_insights(spark, d):
    c = _checkins(spark, d)
    codes = checkins.insight_codes(F.round("score", 9), F.col("emotions"), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(100)), F.pmod("conv_id", F.lit(60)))
    return c.select("conv_id", "turn", F.array_join(codes, ",").alias("codes"))


def maturity_levels(spark, d):
    """Levels of each group of conversations, with the stand-ins: voice on even turns, latency from the number."""
    c = _checkins(spark, d)
    n = F.col("conv_id") + F.col("turn")
    c = c.select("who", (F.lit(1_700_000_000_000) + n * 86_400_000).alias("ts_ms"), "emotions", F.array(F.when(n % 9 == 0, F.lit("Your body metrics look steady"))).alias("insights"), F.when(n % 2 == 0, "why").alias("follow_up"),
                 F.when(n % 2 == 0, "voice").otherwise("text").alias("input_mode"), F.when(n % 4 == 0, "nemotron").when(n % 4 == 2, "other").alias("asr"), F.when(n % 3 != 0, F.when(n % 3 == 1, "local").otherwise("far")).alias("llm"), F.when(n % 5 == 0, n * 40.0).alias("latency_ms"))
    return checkins.maturity(c, ["who"], F.lit(1_720_000_000_000))


# ---------------------------------------------------------------- joins by time, gaps


def nearest_purchase_day(spark, d):
    """For every signup, the first purchase less than a day away."""
    e = events(spark, d)
    days = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("ms").alias("at"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ms").alias("start"), F.col("event_id").alias("purchase"))
    return joins.nearest_day(days, buys, ["user_id"], "at", "start", "purchase", ["purchase"]).select("event_id", "purchase")


def week_labels(spark, d):
    """The return flag that at least 80 % of three neighbouring lines of an order carry."""
    s = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("at"), "l_returnflag")
    w = s.select("l_orderkey", (F.floor(F.col("at") / 3) * 3).alias("start")).distinct()
    return joins.pure_label(w, s, ["l_orderkey"], "start", 3, "at", "l_returnflag")


def index_lookup(spark, d):
    """Events with the value of a daily series at floor((ms - first) / day)."""
    e = events(spark, d)
    origin = e.groupBy("user_id").agg(F.min("ms").alias("t0"))
    series = e.join(origin, "user_id").groupBy("user_id", F.floor((F.col("ms") - F.col("t0")) / 86_400_000).alias("i")).agg(F.max("value").alias("load"))
    return rounded(joins.at_index(e.where("event_type = 'click'").select("user_id", "event_id", (F.col("ms") + 86_400_000).alias("centre")).join(origin, "user_id"), series, ["user_id"], "centre", "t0", 86_400_000.0, "i", "load").select("event_id", "load"))


def filled_gaps(spark, d):
    """Values of purchases are taken out and filled on the line between their neighbours."""
    e = events(spark, d).withColumn("v", F.when(F.col("event_type") != "purchase", F.col("value")))
    e = e.groupBy("user_id", "ms").agg(F.max("v").alias("v"))
    return rounded(signal.interpolated(e, ["user_id"], "ms", "v", "filled").select("user_id", "ms", "filled"))


def quiet_runs(spark, d):
    """Runs of low values in each user's order of events, of three at least."""
    e = events(spark, d)
    e = e.withColumn("i", F.row_number().over(windows._w(["user_id"], ["ms", "event_id"]))).withColumn("silent", F.col("value") < 20)
    return rounded(signal.silences(e, ["user_id"], "i", "silent", 0.5, 1.5))


def flat_users(spark, d):
    return rounded(night.flat_epochs(events(spark, d), ["user_id"], "event_id", "value", 20.0, 0.3))


def epoch_motion(spark, d):
    return rounded(night.epoch_motion(_weeks(spark, d), ["user_id"], "week", "event_id", "value", "train"))


def side_features(spark, d):
    e = _weeks(spark, d)
    return rounded(night.auxiliary(e, WIN, "event_id", "value", "k", "value"))


# ---------------------------------------------------------------- evaluation


def stage_class_metrics(spark, d):
    """Metrics of a rule that names the event type by its value, over five classes and each user."""
    guess = F.when(F.col("value") < 10, "view").when(F.col("value") < 20, "click").when(F.col("value") < 40, "purchase").otherwise("signup")
    return rounded(evaluation.class_metrics(table(spark, d, "events").withColumn("guess", guess), ["user_id"], "event_type", "guess"))


def supplier_means(spark, d):
    s = _scored(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(training.subject_means(s, "l_suppkey", "y", "prob", "o"))


def median_labels(spark, d):
    return training.median_split(events(spark, d).select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", "label")


def best_threshold(spark, d):
    """The threshold of best F1 over 101 quantiles of line items' scores."""
    p = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return rounded(evaluation.pick_threshold(p, "y", "p"))


def base_rate(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("p"))
    return rounded(evaluation.base_rate_threshold(p, ["l_suppkey"], "p", 0.25))


def model_gate(spark, d):
    """Suppliers of even number as candidates against a bar of their nation: pass, worse, or new."""
    s = table(spark, d, "supplier")
    c = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("model"), (F.col("s_suppkey") % 3).alias("eval_set_id"), F.col("s_acctbal").alias("value"), F.when(F.col("s_suppkey") % 5 == 0, "min").otherwise("max").alias("direction"), F.lit(10.0).alias("min_delta"), F.col("s_nationkey").cast("double").alias("secondary"))
    champion = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("model"), (F.col("s_suppkey") % 2).alias("eval_set_id"), (F.col("s_acctbal") - F.col("s_suppkey")).alias("value"), F.lit(12.0).alias("secondary"))
    return evaluation.gate(c, champion)


def recent_rows(spark, d):
    """Each user's last five events of the two weeks before the 20th."""
    e = windows.trailing_days(events(spark, d), "ts", F.lit("2024-01-20").cast("timestamp"), 14)
    return windows.capped(e, ["user_id"], ["ms", "event_id"], 5).select("event_id")


def questionnaires(spark, d):
    """Sums and severities of nine and seven answers made from each user's number; anxiety scales as an index."""
    u = events(spark, d).select("user_id").distinct()
    of = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.col("user_id") * i, F.lit(4)).cast("int"))
    (p, ps), (g, gs) = S.questionnaire(of(9), *S.PHQ9), S.questionnaire(of(7), *S.GAD7)
    return rounded(u.select("user_id", p.alias("phq9"), ps.alias("phq9_severity"), g.alias("gad7"), gs.alias("gad7_severity"), S.stai_index(20 + F.pmod("user_id", F.lit(61))).alias("stai"), S.bai_index(F.pmod("user_id", F.lit(64))).alias("bai")))


_ALL = (feature_master, stress_predictions, stress_by_rules, anxiety_predictions, focus_predictions, bio_age, depression_predictions, sustained_anxiety, sleep_baselines, night_analysis, hr_deltas, sleep_weeks, staged_sequences,
        dominant_feelings, plain_scores, parsed_replies, checkin_insights, maturity_levels, nearest_purchase_day, week_labels, index_lookup, filled_gaps, quiet_runs, flat_users, epoch_motion, side_features, stage_class_metrics, supplier_means,
        median_labels, best_threshold, base_rate, model_gate, recent_rows, questionnaires)
QUERIES = {f.__name__: f for f in _ALL}

# ---------------------------------------------------------------- the same in SQL


def _r(*cols: str, of: str = "") -> str:
    return ", ".join(f"round(CAST({of}{c} AS DOUBLE), 6) AS {c}" for c in cols)


def _case(tree: dict, column: str = "{}") -> str:
    """A tree as CASE; nulls take the missing branch."""
    if "leaf" in tree:
        return str(tree["leaf"])
    x, child = column.format(tree["split"]), {c["nodeid"]: c for c in tree["children"]}
    yes, no, empty = (_case(child[tree[k]], column) for k in ("yes", "no", "missing"))
    return f"CASE WHEN {x} IS NULL THEN {empty} WHEN {x} < {tree['split_condition']} THEN {yes} ELSE {no} END"


def _sum(model: dict, column: str = "{}") -> str:
    return f"({model['baseScore']} + " + " + ".join(_case(t, column) for t in model["trees"]) + ")"


def _zsql(model: dict, f: str) -> str:
    return f"(coalesce(CAST({f} AS DOUBLE), 0) - {model['normalization']['mean'].get(f, 0)}) / {model['normalization']['std'].get(f, 1)}"


_EV = EVENTS.replace(" FROM events", f", epoch_us(ts) // {WEEK}000000 AS week FROM events")
_TIME = _EV + re.sub(r"\bFROM ([bmqdg])\b", r"FROM \1_", re.sub(r"\n([bmqdg]) AS \(", r"\n\1_ AS (", TIME[len(EVENTS):])).replace("user_id", "user_id, week")
_MASTER = "WITH " + _TIME + """,
tp AS (SELECT user_id, week, CASE WHEN count(*) < 2 THEN 33.5 ELSE avg(30 + value / 20) END AS temp_mean, CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(regr_slope(30 + value / 20, ms / 60000.0 - 28400000), 0.0) END AS temp_slope, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_samp(30 + value / 20) END AS temp_std,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE max(30 + value / 20) - min(30 + value / 20) END AS temp_range, coalesce(sum(k), 0.0) AS step_count, CASE WHEN week % 2 = 0 THEN avg(15 + k) END AS dr FROM ev GROUP BY 1, 2),
m1 AS (SELECT f.* EXCLUDE (rmssd), CASE WHEN abs(rmssd - dr) > 20 THEN dr ELSE rmssd END AS rmssd, temp_mean, temp_slope, temp_std, temp_range, step_count FROM f JOIN tp ON f.user_id = tp.user_id AND f.week = tp.week),
m AS (SELECT *, CASE WHEN step_count / 15.0 < 1 AND hr_mean > 0 AND hr_mean < 55 THEN 'sleeping' WHEN step_count / 15.0 < 1 THEN 'sedentary' WHEN step_count / 15.0 < 40 THEN 'walking' ELSE 'active' END AS activity_type FROM m1)"""
_NAMED = "array_to_string(list_transform(list_slice(list_filter([{}], lambda x: x IS NOT NULL), 1, 3), lambda x: x), ',')"
_RULE = """greatest(0, least(100, floor(30.0 + CASE WHEN rmssd < 25 THEN 30 WHEN rmssd < 40 THEN 15 WHEN rmssd > 60 THEN -15 ELSE 0 END + CASE WHEN hr_mean > 90 THEN 20 WHEN hr_mean > 80 THEN 10 WHEN hr_mean < 65 THEN -10 ELSE 0 END {} + 0.5)))"""


def _level(s: str, t: float = 0.5) -> str:
    return f"CASE WHEN {s} < {t * 50} THEN 'low' WHEN {s} < {t * 100} THEN 'moderate' WHEN {s} < {t * 100 + (100 - t * 100) / 2} THEN 'elevated' ELSE 'high' END"


_SF = STRESS["features"]
_STRESS = _MASTER + ", l AS (" + " UNION ALL ".join(f"SELECT user_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM m" for f in _SF) + """),
s AS (SELECT user_id, feature, avg(x) AS mu, stddev_pop(x) AS sd FROM l WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(x) >= 4),
w AS (SELECT user_id, """ + ", ".join(f"max(mu) FILTER (feature = '{f}') AS {f}_m, max(sd) FILTER (feature = '{f}') AS {f}_s" for f in _SF) + """ FROM s GROUP BY 1),
z AS (SELECT m.*, """ + ", ".join(f"CASE WHEN {f}_s > 0 THEN (coalesce({f}, 0) - {f}_m) / {f}_s ELSE {_zsql(STRESS, f)} END AS z_{f}" for f in _SF) + """ FROM m LEFT JOIN w ON m.user_id = w.user_id),
p AS (SELECT *, rmssd > 0 AND mean_rr > 0 AND hr_mean BETWEEN 30 AND 220 AS ok, 1 / (1 + exp(-""" + _sum(STRESS, "z_{}") + ")) AS prob, " + _RULE.format("") + """ AS rule FROM z),
q AS (SELECT *, CASE WHEN ok THEN floor(round(prob * 100, 9) + 0.5) ELSE rule END AS sc FROM p)
SELECT user_id, week, CAST(sc AS DOUBLE) AS stress_score, CASE WHEN ok THEN """ + _level("sc", 0.55) + " ELSE " + _level("sc") + """ END AS stress_level, CASE WHEN ok THEN prob >= 0.55 ELSE sc >= 50 END AS is_stressed,
  round(CASE WHEN ok THEN greatest(0.1, least(1.0, 0.9 - CASE WHEN hr_mean < 40 OR hr_mean > 150 THEN 0.3 ELSE 0 END - CASE WHEN rmssd = 0 THEN 0.4 ELSE 0 END - CASE WHEN temp_mean = 0 THEN 0.1 ELSE 0 END)) ELSE 0.3 END, 6)::DOUBLE AS confidence,
  CASE WHEN ok THEN 'rmssd,hr_mean,step_count' ELSE '' END AS why, CASE WHEN ok THEN concat_ws(',', CASE WHEN rmssd >= 40.0 THEN 'high' ELSE 'low' END, CASE WHEN hr_mean >= 85.0 THEN 'high' ELSE 'low' END, CASE WHEN step_count >= 500.0 THEN 'high' ELSE 'low' END) ELSE '' END AS sides FROM q"""
_BASES = """, fw AS (SELECT user_id, 40 + value AS h, 15 + k AS r FROM ev), lo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN h > 0 THEN h END NULLS LAST) <= greatest(1, ceil(count(CASE WHEN h > 0 THEN 1 END) OVER (PARTITION BY user_id) * 0.1)) AND h > 0 AS low FROM fw),
b AS (SELECT user_id, coalesce(avg(r) FILTER (r > 0), 0.0) AS rm, coalesce(stddev_samp(r) FILTER (r > 0), 0.0) AS rs, coalesce(avg(h) FILTER (low), 0.0) AS hm, coalesce(stddev_samp(h) FILTER (low), 0.0) AS hs FROM lo GROUP BY 1 HAVING count(*) >= 20)"""
_ANX = _sum(ANXIETY).replace("activity_type", "act")
_NIGHT = _NIGHTS[: _NIGHTS.rindex("SELECT user_id, day, session_start")]
_CLOCK = "floor((({} % 86400000)) / 60000) / 60.0"
_USUAL = """bs AS (SELECT user_id, count(*) AS n_nights, avg(CASE WHEN """ + _CLOCK.format("session_start") + " < 12 THEN " + _CLOCK.format("session_start") + " + 24 ELSE " + _CLOCK.format("session_start") + " END) AS lt, avg(" + _CLOCK.format("session_end") + """) AS typical_wake_hour, avg(sleep_min) AS usual_sleep_min,
  avg(efficiency) AS usual_efficiency, avg(quality) AS usual_quality, avg(deep_pct) AS usual_deep_pct, avg(rem_pct) AS usual_rem_pct FROM q GROUP BY 1), us AS (SELECT *, CASE WHEN lt >= 24 THEN lt - 24 ELSE lt END AS typical_bed_hour FROM bs)"""
_E = "WITH " + EVENTS
_O = "PARTITION BY user_id ORDER BY ms, event_id"
_EM = "least(1.0, len(list_intersect(w, {})) / 2.0)"
_CK = f"WITH t AS (SELECT conv_id, turn, conv_id % 20 AS who, {_TOK} AS w FROM conversations WHERE role = 'user'), e0 AS (SELECT *, " + ", ".join(f"CAST({_EM.format(_words(ws))} AS DOUBLE) AS {e}0" for e, ws in T.EMOTIONS.items()) + " FROM t), e AS (SELECT * EXCLUDE (" + ", ".join(f"{e}0" for e in T.EMOTIONS) + "), " + ", ".join(
    (f"CASE WHEN greatest({', '.join(x + '0' for x in T.EMOTIONS)}) = 0 THEN 0.3 ELSE calm0 END AS calm" if e == "calm" else f"{e}0 AS {e}") for e in T.EMOTIONS) + " FROM e0)"
_PLAIN = "len(list_filter(w, lambda x: list_contains({}, x)))"
_LV = {
    "capture": "CASE WHEN vc = 0 THEN 0 WHEN fr >= 0.75 THEN 4 WHEN fr >= 0.4 THEN 3 WHEN vc >= 3 THEN 2 ELSE 1 END", "understanding": "CASE WHEN told = 0 THEN 0 WHEN lr >= 0.9 THEN 4 WHEN lr >= 0.6 THEN 3 WHEN lr > 0 THEN 2 ELSE 1 END",
    "vocabulary": "CASE WHEN br >= 0.75 THEN 4 WHEN br >= 0.5 THEN 3 WHEN br >= 0.25 THEN 2 ELSE 1 END", "cross_reference": "CASE WHEN al > 0 THEN 1 ELSE 0 END", "responsiveness": "CASE WHEN fo >= 0.6 THEN 4 WHEN fo >= 0.3 THEN 3 WHEN fo > 0 THEN 2 ELSE 1 END",
    "latency": "CASE WHEN la IS NULL THEN 0 WHEN la <= 2500 THEN 4 WHEN la <= 4500 THEN 3 WHEN la <= 7000 THEN 2 ELSE 1 END", "stability": "CASE WHEN n >= 14 AND days >= 14 THEN 4 WHEN n >= 7 AND days >= 7 THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END",
}

ORACLES = {
    "feature_master": _MASTER + ", mv AS (SELECT * FROM (VALUES ('sedentary', 1.0, 0.02), ('walking', 1.05, 0.15), ('active', 1.15, 0.30), ('sleeping', 0.98, 0.01)) AS t(activity_type, accel_mean, accel_std)) SELECT user_id, week, n_rr, " + _r(*MASTER) + ", m.activity_type FROM m JOIN mv ON m.activity_type = mv.activity_type",
    "stress_predictions": _STRESS,
    "stress_by_rules": _MASTER + _BASES + ", r AS (SELECT m.*, " + _RULE.format("+ CASE WHEN rmssd < rm - rs THEN 10 ELSE 0 END + CASE WHEN hr_mean > hm + hs THEN 10 ELSE 0 END") + " AS s FROM m LEFT JOIN b ON m.user_id = b.user_id) SELECT user_id, week, CAST(s AS DOUBLE) AS stress_score, " + _level("s") + " AS stress_level, s >= 50 AS is_stressed, CAST(0.6 AS DOUBLE) AS confidence FROM r",
    "anxiety_predictions": _MASTER + ", a AS (SELECT user_id, week, rmssd, hr_mean, CASE activity_type WHEN 'walking' THEN 1 WHEN 'active' THEN 2 WHEN 'sleeping' THEN 3 ELSE 0 END AS act FROM m), s AS (SELECT user_id, week, greatest(0, least(100, " + _ANX + ")) AS i FROM a) SELECT user_id, week, round(CAST(i AS DOUBLE), 6) AS anxiety_index, CASE WHEN i <= 20 THEN 'minimal' WHEN i <= 45 THEN 'mild' WHEN i <= 70 THEN 'moderate' ELSE 'severe' END AS level, CAST(0 AS DOUBLE) AS baseline_deviation FROM s",
    "focus_predictions": _MASTER + ", u AS (" + " UNION ALL ".join(f"SELECT user_id, week, '{f}' AS feature, {f'{f} - {h}' if bad == 'high' else f'{lo} - {f}'} AS d, {float(h - lo)} AS span FROM m" for f, (lo, h, bad, _) in models.NORMAL_RANGES.items() if f != "sampen") + """), v AS (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY d / span DESC, feature) AS o FROM u WHERE d / span > 0),
g AS (SELECT user_id, week, string_agg(feature, ',' ORDER BY o) AS elevated FROM v WHERE o <= 4 GROUP BY 1, 2), z AS (SELECT user_id, week, """ + ", ".join(f"{_zsql(FOCUS, f)} AS z_{f}" for f in FOCUS["features"]) + """ FROM m), s AS (SELECT user_id, week, greatest(0, least(100, floor(round(100 / (1 + exp(-""" + _sum(FOCUS, "z_{}") + """)), 9) + 0.5))) AS x FROM z)
SELECT s.user_id, s.week, CAST(x AS DOUBLE) AS focus_score, CASE WHEN x < 25 THEN 'scattered' WHEN x < 50 THEN 'drifting' WHEN x < 75 THEN 'steady' ELSE 'sharp' END AS focus_level, coalesce(elevated, '') AS elevated FROM s LEFT JOIN g ON s.user_id = g.user_id AND s.week = g.week""",
    "bio_age": _E + """, w AS (SELECT user_id, 40 + value AS hr_mean, 15 + k AS rmssd, 30 + value AS sdnn, 60000 / (40 + value) AS mean_rr, event_id FROM ev),
g AS (SELECT user_id, count(*) FILTER (rmssd > 0 AND mean_rr > 0) AS n, """ + ", ".join(f"coalesce(median({f}) FILTER (rmssd > 0 AND mean_rr > 0), 0.0) AS {f}" for f in AGE["features"]) + """, CAST(20 + max(event_id) % 50 AS INTEGER) AS age FROM w GROUP BY 1),
z AS (SELECT user_id, n, age, """ + ", ".join(f"{_zsql(AGE, f)} AS {f}" for f in AGE["features"]) + """ FROM g), p AS (SELECT *, CAST(floor(greatest(15, least(95, """ + _sum(AGE) + """)) + 0.5) AS INTEGER) AS a, n >= 10 AS ready FROM z)
SELECT user_id, CASE WHEN ready THEN a ELSE age END AS predicted_age, CASE WHEN ready THEN a - age END AS age_gap, round(CASE WHEN ready THEN least(1.0, n / 60.0) ELSE 0.0 END, 6) AS confidence, ready,
  CASE WHEN NOT ready THEN 'Not enough signal yet' WHEN a - age <= -3 THEN 'Looks ' || (age - a) || ' years younger' WHEN a - age >= 3 THEN 'Looks ' || (a - age) || ' years older' ELSE 'About the actual age' END AS note FROM p""",
    "depression_predictions": _E + """, g AS (SELECT user_id, avg(k) AS mean_activity, count(*) * 7.0 AS inactive_minutes, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 2 AS DOUBLE) END AS age_num, count(DISTINCT CAST(ts AS DATE)) AS days FROM ev GROUP BY user_id),
z AS (SELECT user_id, days, """ + ", ".join(f"{_zsql(DEPRESSION, f)} AS {f}" for f in DEPRESSION["features"]) + """ FROM g), p AS (SELECT *, 1 / (1 + exp(-""" + _sum(DEPRESSION) + """)) AS prob FROM z), q AS (SELECT *, CAST(floor(round(prob * 100, 9) + 0.5) AS BIGINT) AS s FROM p)
SELECT user_id, round(prob, 6) AS probability, s AS risk_score, CASE WHEN s < 30 THEN 'minimal' WHEN s < 50 THEN 'mild' WHEN s < 70 THEN 'moderate' ELSE 'high' END AS risk_level, 'inactive_minutes,mean_activity' AS why, CASE WHEN days >= 7 THEN 'good' WHEN days >= 3 THEN 'partial' ELSE 'mock' END AS data_quality FROM q""",
    "sustained_anxiety": _E + " SELECT a.event_id, min(b.value) FILTER (b.ms >= a.ms - 86400000) > 20 AND count(*) FILTER (b.ms <= a.ms - 86400000) > 0 AS sustained FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ms <= a.ms GROUP BY 1",
    "sleep_baselines": _NIGHT + ", " + _USUAL + " SELECT user_id, n_nights, " + _r("typical_bed_hour", "typical_wake_hour", "usual_sleep_min", "usual_efficiency", "usual_quality", "usual_deep_pct", "usual_rem_pct") + " FROM us",
    "night_analysis": _NIGHT + ", " + _USUAL + """, ht AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(coalesce(avg(40 + value) FILTER (40 + value > 0), 0.0) + 0.5) AS BIGINT) AS avg_hr, coalesce(min(40 + value) FILTER (40 + value > 0), 0.0) AS min_hr, CAST(floor(coalesce(avg(k) FILTER (k > 0), 0.0) + 0.5) AS BIGINT) AS avg_hrv, coalesce(max(k) FILTER (k > 0), 0.0) AS max_hrv FROM ev GROUP BY 1, 2),
nk AS (SELECT user_id, avg(k) AS uk FROM ev GROUP BY 1), j AS (SELECT q.user_id, q.day, avg_hr, min_hr, avg_hrv, max_hrv, uk, typical_bed_hour AS tb, usual_sleep_min AS um, """ + _CLOCK.format("session_start") + """ AS bh, (session_end - session_start) / 60000.0 AS len FROM q JOIN ht ON q.user_id = ht.user_id AND q.day = ht.day JOIN us ON q.user_id = us.user_id JOIN nk ON q.user_id = nk.user_id)
SELECT user_id, day, avg_hr, round(min_hr, 6) AS min_hr, avg_hrv, round(max_hrv, 6) AS max_hrv, CAST(floor(CASE WHEN avg_hrv = 0 THEN 50.0 WHEN uk > 0 THEN greatest(0, least(100, avg_hrv / uk * 70)) WHEN avg_hrv >= 60 THEN 85.0 WHEN avg_hrv >= 40 THEN 70.0 WHEN avg_hrv >= 25 THEN 50.0 ELSE 30.0 END + 0.5) AS BIGINT) AS recovery,
  CAST(floor(round(CASE WHEN coalesce(um, 0) = 0 THEN 50.0 ELSE (greatest(0, least(100, 100 - abs(CASE WHEN bh < 12 THEN bh + 24 ELSE bh END - CASE WHEN tb < 12 THEN tb + 24 ELSE tb END) * 20)) + greatest(0, least(100, 100 - abs(len - um) / 60 * 25))) / 2 END, 9) + 0.5) AS BIGINT) AS consistency FROM j""",
    "hr_deltas": _E + ", g AS (SELECT user_id, ms // 86400000 AS n, avg(value) AS m FROM ev GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER w AS pn, lag(m) OVER w AS pm FROM g WINDOW w AS (PARTITION BY user_id ORDER BY n)) SELECT user_id, n, round(m, 6) AS m, round(CASE WHEN pn = n - 1 THEN m - pm ELSE 0.0 END, 6) AS hr_delta_prev FROM l",
    "sleep_weeks": _NIGHT + ", sw AS (SELECT user_id, date_diff('day', CAST(day AS DATE), DATE '2024-01-29') AS b, round(CAST(sleep_min AS DOUBLE), 6) AS s FROM q) SELECT user_id, CAST(b // 7 AS INTEGER) AS week, " + ", ".join(f"max(s) FILTER (b % 7 = {i}) AS d{i}" for i in range(7)) + " FROM sw WHERE b >= 0 AND b < 28 GROUP BY 1, 2",
    "staged_sequences": """WITH l AS (SELECT CAST(vec_id // 100 AS BIGINT) AS night, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 10) AS l FROM embeddings), s AS (SELECT night, list_position(l, list_max(l)) - 1 AS c, 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS p FROM l)
SELECT night, round(avg(p), 6) AS confidence, count(*) AS n_epochs, count(*) FILTER (c = 0) AS c0, count(*) FILTER (c IN (1, 2)) AS c1, count(*) FILTER (c = 3) AS c2 FROM s GROUP BY 1""",
    "dominant_feelings": _CK + ", s AS (SELECT who, " + ", ".join(f"sum({e}) AS {e}" for e in T.EMOTIONS) + " FROM e GROUP BY 1) SELECT who, CASE greatest(" + ", ".join(T.EMOTIONS) + ") " + " ".join(f"WHEN {e} THEN '{e}'" for e in T.EMOTIONS) + " END AS dominant FROM s",
    "plain_scores": f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, {_PLAIN.format(_words(checkins.PLAIN_POSITIVE))} AS p, {_PLAIN.format(_words(checkins.PLAIN_NEGATIVE))} AS n, {_PLAIN.format(_words(checkins.PLAIN_EMOTIONS['joy']))} AS j, {_PLAIN.format(_words(checkins.PLAIN_EMOTIONS['fatigue']))} AS f FROM t) SELECT doc_id, round((p - n) / CAST(greatest(p + n, 1) AS DOUBLE), 6) AS score, CAST(least(1.0, j * 0.4) AS DOUBLE) AS joy, CAST(least(1.0, f * 0.4) AS DOUBLE) AS fatigue FROM c",
    "parsed_replies": """WITH t AS (SELECT conv_id, turn, turn + conv_id AS t FROM conversations), s AS (SELECT *, t % 5 >= 2 AS j, greatest(-1, least(1, (t % 7) - 3)) AS sc FROM t)
SELECT conv_id, turn, CASE WHEN t % 5 = 0 THEN 'plain ' || turn WHEN t % 5 = 1 THEN 'hi' ELSE 'hello' END AS empathy, CASE WHEN j AND t % 3 = 0 THEN 'neutral' WHEN NOT j THEN 'neutral' WHEN sc >= 0.3 THEN 'positive' WHEN sc >= -0.1 THEN 'neutral' WHEN sc >= -0.5 THEN 'concerned' ELSE 'distressed' END AS sentiment,
  CAST(CASE WHEN j THEN sc ELSE 0 END AS DOUBLE) AS sentiment_score, CASE WHEN j THEN 'work' ELSE 'general' END AS themes, CAST(0.5 AS DOUBLE) AS intensity, CAST(CASE WHEN j THEN least(1, t % 3) ELSE 0 END AS DOUBLE) AS joy FROM s""",
    "checkin_insights": _CK + ", z AS (" + _SENT + "), f AS (SELECT e.conv_id, e.turn, sentiment < -0.3 AS tense, (e.conv_id * 7 + e.turn) % 100 > 60 AS strained, e.conv_id % 60 AS hrv, greatest(" + ", ".join(T.EMOTIONS) + ") AS top, CASE greatest(" + ", ".join(T.EMOTIONS) + ") " + " ".join(f"WHEN {x} THEN '{x}'" for x in T.EMOTIONS) + """ END AS feel FROM e JOIN z ON e.conv_id = z.conv_id AND e.turn = z.turn)
SELECT conv_id, turn, concat_ws(',', CASE WHEN tense AND strained THEN 'words_and_body_stressed' WHEN tense THEN 'words_stressed_body_steady' WHEN strained THEN 'words_fine_body_stressed' END, CASE WHEN top > 0.3 THEN 'feels_' || feel END, CASE WHEN hrv > 0 AND hrv < 25 THEN 'hrv_low' END) AS codes FROM f""",
    "maturity_levels": _CK + """, c AS (SELECT *, conv_id + turn AS n FROM e), g AS (SELECT who, count(*) AS n, count(*) FILTER (n % 2 = 0) AS vc, count(*) FILTER (n % 4 = 0) / CAST(nullif(count(*) FILTER (n % 2 = 0), 0) AS DOUBLE) AS fr, count(*) FILTER (n % 3 <> 0) AS told, count(*) FILTER (n % 3 = 2) / CAST(nullif(count(*) FILTER (n % 3 <> 0), 0) AS DOUBLE) AS lr,
  (""" + " + ".join(f"max(CASE WHEN {e} > 0.3 THEN 1 ELSE 0 END)" for e in T.EMOTIONS) + """) / 8.0 AS br, count(*) FILTER (n % 9 = 0) AS al, count(*) FILTER (n % 2 = 0) / CAST(count(*) AS DOUBLE) AS fo, avg(CASE WHEN n % 5 = 0 THEN n * 40.0 END) AS la, ceil((1720000000000 - min(1700000000000 + n * 86400000)) / 86400000.0) AS days FROM c GROUP BY 1),
l AS (SELECT who, n, """ + ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in _LV.items()) + " FROM g), s AS (SELECT *, (" + " + ".join(_LV) + ") / 7.0 AS mean FROM l) SELECT who, n, " + ", ".join(_LV) + ", CAST(floor(round(mean / 4 * 100, 9) + 0.5) AS BIGINT) AS score, CAST(least(4, floor(mean)) AS INTEGER) AS tier FROM s",
    "nearest_purchase_day": _E + ", p AS (SELECT a.event_id, b.event_id AS purchase, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ms, b.event_id) AS o FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(a.ms - b.ms) < 86400000 WHERE a.event_type = 'signup') SELECT a.event_id, p.purchase FROM ev a LEFT JOIN p ON a.event_id = p.event_id AND o = 1 WHERE a.event_type = 'signup'",
    "week_labels": "WITH c AS (SELECT l_orderkey, CAST((l_linenumber - 1) // 3 * 3 AS BIGINT) AS start, l_returnflag, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, start ORDER BY n DESC, l_returnflag) AS o FROM c) SELECT l_orderkey, start, l_returnflag FROM o WHERE o = 1 AND n >= 0.8 * 3",
    "index_lookup": _E + ", f AS (SELECT user_id, min(ms) AS t0 FROM ev GROUP BY 1), s AS (SELECT ev.user_id, (ms - t0) // 86400000 AS i, max(value) AS load FROM ev JOIN f ON ev.user_id = f.user_id GROUP BY 1, 2) SELECT ev.event_id, round(s.load, 6) AS load FROM ev JOIN f ON ev.user_id = f.user_id LEFT JOIN s ON s.user_id = ev.user_id AND s.i = (ms + 86400000 - t0) // 86400000 WHERE event_type = 'click'",
    "filled_gaps": _E + """, g AS (SELECT user_id, ms, max(CASE WHEN event_type <> 'purchase' THEN value END) AS v FROM ev GROUP BY 1, 2), w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN ms END IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN ms END IGNORE NULLS) OVER a AS t1 FROM g
  WINDOW b AS (PARTITION BY user_id ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, ms, round(coalesce(v, v0 + (v1 - v0) * (CAST(ms - t0 AS DOUBLE) / nullif(t1 - t0, 0)), v0, v1), 6) AS filled FROM w""",
    "quiet_runs": _E + f", i AS (SELECT user_id, value, row_number() OVER ({_O}) AS i FROM ev), g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM i WHERE value < 20) SELECT user_id, CAST(min(i) AS INTEGER) AS start, count(*) AS frames, CAST(count(*) * 0.5 AS DOUBLE) AS seconds FROM g GROUP BY user_id, g HAVING count(*) * 0.5 >= 1.5",
    "flat_users": _E + ", l AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) < 1e-6 AS f FROM ev), g AS (SELECT user_id, stddev_pop(value) AS std, count(*) FILTER (f) / CAST(count(*) AS DOUBLE) AS flat_share FROM l GROUP BY 1) SELECT user_id, round(std, 6) AS std, round(flat_share, 6) AS flat_share, std >= 20.0 AND flat_share < 0.3 AS valid FROM g",
    "epoch_motion": "WITH " + _EV + ", l AS (SELECT user_id, week, value, abs(value - lag(value) OVER (PARTITION BY user_id, week ORDER BY event_id)) AS d FROM ev) SELECT user_id, week, round(coalesce(sum(d), 0.0), 6) AS act_count, round(coalesce(max(d), 0.0), 6) AS act_max, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0.0 END, 6) AS act_std, round(coalesce(avg(CASE WHEN d < 0.02 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 0.0), 6) AS immobility FROM l GROUP BY 1, 2",
    "side_features": "WITH " + _EV + ", l AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, week ORDER BY event_id) - 1 AS DOUBLE) AS i FROM ev) SELECT user_id, week, round(coalesce(avg(value), 0.0), 6) AS hr_mean, round(coalesce(stddev_pop(value), 0.0), 6) AS hr_std, round(coalesce(avg(k), 0.0), 6) AS acc_mean, round(coalesce(stddev_pop(k), 0.0), 6) AS acc_std, round(coalesce(avg(value), 0.0), 6) AS temp_mean, round(coalesce(covar_pop(value, i) / nullif(var_pop(i), 0), 0.0), 6) AS temp_slope FROM l GROUP BY 1, 2",
    "stage_class_metrics": """WITH d AS (SELECT user_id, event_type AS y, CASE WHEN value < 10 THEN 'view' WHEN value < 20 THEN 'click' WHEN value < 40 THEN 'purchase' ELSE 'signup' END AS z FROM events), c AS (SELECT user_id, y AS c FROM d UNION SELECT user_id, z FROM d),
k AS (SELECT c.user_id, c.c, count(*) FILTER (d.y = c.c) AS a, count(*) FILTER (d.z = c.c) AS p, count(*) FILTER (d.y = c.c AND d.z = c.c) AS t FROM c JOIN d ON c.user_id = d.user_id GROUP BY 1, 2), g AS (SELECT user_id, sum(a) AS n, sum(t) / CAST(sum(a) AS DOUBLE) AS acc, avg(2.0 * t / (a + p)) AS mf, sum(2.0 * t / (a + p) * a) / sum(a) AS wf, sum(CAST(a AS DOUBLE) * p) AS e FROM k GROUP BY 1)
SELECT user_id, round(acc, 6) AS accuracy, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1, round(coalesce((acc - e / (CAST(n AS DOUBLE) * n)) / nullif(1 - e / (CAST(n AS DOUBLE) * n), 0), 0), 6) AS kappa FROM g""",
    "supplier_means": f"WITH {_SCORE} SELECT l_suppkey, CAST(arg_min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_orderkey * 10 + l_linenumber) AS INTEGER) AS y, round(avg(prob), 6) AS prob, count(*) AS n FROM sc GROUP BY 1",
    "median_labels": "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT event_id, CAST(CASE WHEN value > m THEN 1 ELSE 0 END AS INTEGER) AS label FROM events JOIN m USING (user_id)",
    "best_threshold": """WITH d AS (SELECT l_returnflag = 'R' AS y, round(l_quantity / 50, 6) AS p FROM lineitem), g AS (SELECT DISTINCT unnest(quantile_cont(p, [""" + ", ".join(str(i / 100) for i in range(101)) + """])) AS t FROM d), c AS (SELECT t, count(*) FILTER (p >= t) AS h, count(*) FILTER (p >= t AND y) AS tp, count(*) AS n, count(*) FILTER (y) AS np FROM g CROSS JOIN d GROUP BY 1),
s AS (SELECT t, 2.0 * tp / (h + np) AS f1, tp / CAST(np AS DOUBLE) - (h - tp) / CAST(n - np AS DOUBLE) AS yd FROM c) SELECT round(t, 6) AS threshold, round(f1, 6) AS f1, round(yd, 6) AS youden, round((yd + 1) / 2, 6) AS balanced FROM s ORDER BY f1 DESC, t LIMIT 1""",
    "base_rate": "SELECT l_suppkey, round(quantile_cont(l_quantity / 50, 0.75), 6) AS threshold FROM lineitem GROUP BY 1",
    "model_gate": """WITH c AS (SELECT s_suppkey AS model, s_suppkey % 3 AS e, s_acctbal AS v, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE 1 END AS sg, s_nationkey AS sec FROM supplier WHERE s_suppkey % 2 = 0), h AS (SELECT s_suppkey AS model, s_suppkey % 2 AS e, s_acctbal - s_suppkey AS v FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT c.model, CASE WHEN h.v IS NULL THEN 'new' WHEN c.e <> h.e THEN 'not_comparable' WHEN sg * c.v < sg * h.v + 10 THEN 'worse' WHEN sg * sec < sg * 12.0 THEN 'secondary_regressed' ELSE 'pass' END AS status FROM c LEFT JOIN h ON c.model = h.model""",
    "recent_rows": _E + ", r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS o FROM ev WHERE ts > TIMESTAMP '2024-01-06' AND ts <= TIMESTAMP '2024-01-20') SELECT event_id FROM r WHERE o <= 5",
    "questionnaires": "WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, CAST(" + " + ".join(f"(user_id * {i}) % 4" for i in range(1, 10)) + " AS INTEGER) AS phq9, CAST(" + " + ".join(f"(user_id * {i}) % 4" for i in range(1, 8)) + """ AS INTEGER) AS gad7 FROM u)
SELECT user_id, phq9, CASE WHEN phq9 <= 4 THEN 'minimal' WHEN phq9 <= 9 THEN 'mild' WHEN phq9 <= 14 THEN 'moderate' WHEN phq9 <= 19 THEN 'moderately_severe' ELSE 'severe' END AS phq9_severity, gad7, CASE WHEN gad7 <= 4 THEN 'minimal' WHEN gad7 <= 9 THEN 'mild' WHEN gad7 <= 14 THEN 'moderate' ELSE 'severe' END AS gad7_severity,
  round(round((user_id % 61) / 60.0 * 100, 2), 6) AS stai, round(round((user_id % 64) / 63.0 * 100, 2), 6) AS bai FROM s""",
}
