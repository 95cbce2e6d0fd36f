"""Sequence, join and aggregate queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.operators import joins, windows
from pulselake.plans.views import EVENTS, events, rounded, table

HOUR = 3_600_000
ORDER = ["ms", "event_id"]


def zscore_by_supplier(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return rounded(windows.zscores(li, ["l_suppkey"], ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity_z", "l_extendedprice_z"))


def robust_by_supplier(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    out = windows.robust_z(li, ["l_suppkey"], ["l_quantity", "l_extendedprice"], ("l_quantity",))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_rz", "l_extendedprice_rz", "l_quantity_iz"))


def value_trend(spark, d):
    return rounded(windows.half_trend(events(spark, d), ["user_id"], ORDER, "value", 5.0, 4, ("improving", "declining", "stable")))


def score_smoothing(spark, d):
    e = windows.moving_average(events(spark, d).select("event_id", "user_id", "ms", "value"), ["user_id"], ORDER, "value", 24, "avg24")
    return rounded(e.select("event_id", S.half_up(F.round("avg24", 6)).alias("smoothed"), "avg24"))


def drift(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "value", F.col("k").cast("long").alias("conf"))
    return rounded(windows.model_health(e, ["user_id"], ORDER, "value", "conf", unit=100.0).select("event_id", "samples", "mean_confidence", "low_rate", "degenerate", "drift"), 10)


def type_spans(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return windows.spans(e, ["user_id"], "ms", "event_type", "event_id").select("user_id", "event_type", "span_start", "span_end", "n")


def night_position(spark, d):
    return rounded(windows.place_in_night(events(spark, d), ["user_id"], ORDER).select("event_id", "time_of_night"))


def weekly_windows(spark, d):
    """Sliding windows of two days, one day apart, from each user's first event."""
    w = windows.anchored_windows(events(spark, d).select("user_id", "ms", "value"), ["user_id"], "ms", 48 * HOUR, 24 * HOUR)
    return rounded(w.groupBy("user_id", "win", "win_start").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")))


def majority_type(spark, d):
    e = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(windows.majority(e, ["user_id", "day"], "event_type", 0.5))


def _ranges(spark, d):
    return events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("range_id"), F.col("ms").alias("lo"), (F.col("ms") + 6 * HOUR).alias("hi"))


def events_in_ranges(spark, d):
    p = events(spark, d).select("user_id", "event_id", "ms")
    return joins.range_join(p, _ranges(spark, d), ["user_id"], "ms", "lo", "hi", 6 * HOUR).select("event_id", "range_id")


def span_overlap(spark, d):
    e = events(spark, d)
    a = e.where("event_type = 'view'").select("user_id", F.col("ms").alias("a_start"), (F.col("ms") + 12 * HOUR).alias("a_end")).distinct()
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ms").alias("b_start"), (F.col("ms") + 8 * HOUR).alias("b_end")).distinct()
    return joins.overlaps(a, b, ["user_id"], 12 * HOUR).select("user_id", "a_start", "a_end", F.col("overlap").cast("long").alias("overlap"))


def last_purchase(spark, d):
    e = events(spark, d)
    left = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ms")
    right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms", "value")
    return rounded(joins.as_of(left, right, ["user_id"], "ms", "value", "event_id", "last_value").select("event_id", "last_value"))


def around_purchases(spark, d):
    e = events(spark, d)
    epochs = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ms").alias("centre"))
    return rounded(joins.around(epochs, e.select("user_id", "ms", "value"), ["user_id"], "centre", "ms", "value", 24 * HOUR, 24 * HOUR).select("event_id", "s_mean", "s_std", "s_min", "s_max", "s_n"))


def latest_event(spark, d):
    """The latest row of each user, without a sort: the maximum of a struct."""
    e = events(spark, d)
    g = e.groupBy("user_id").agg(F.max(F.struct("ms", "event_id", "event_type", "value")).alias("m"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("user_id", "m.event_id", "m.event_type", "m.value", "n"))


def range_scan(spark, d):
    return rounded(table(spark, d, "events").where(F.col("ts").between("2024-01-05", "2024-01-20")).select("event_id", "user_id", "value"))


def trigger_and_cooldown(spark, d):
    """Per user: how many values are at least 7 from the last that triggered, and how many times come half a day apart."""
    e = events(spark, d).select("user_id", "event_id", "ms", "value")
    hits = windows.triggered(e, ["user_id"], ORDER, "value", 7.0).groupBy("user_id").agg(F.count_if("hit").alias("n_triggered"))
    cool = windows.cooled_down(e, ["user_id"], ORDER, "ms", 12 * HOUR).groupBy("user_id").agg(F.count_if("let_through").alias("n_cooled"))
    return hits.join(cool, "user_id")


def stage_softmax(spark, d):
    """Class and confidence of each vector. A staging model has four logits: the vector's first four components stand in for them."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10).alias("l"))
    e = e.withColumn("p", S.softmax(F.col("l")))
    return rounded(e.select("vec_id", S.argmax(F.col("l")).alias("stage"), F.array_max("p").alias("conf")))


def smoothed_stages(spark, d):
    """Stages in nights of 41 vectors with low-confidence islands flipped, left to right."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10).alias("l"))
    e = e.select("vec_id", F.floor(F.col("vec_id") / 41).alias("night"), S.argmax(F.col("l")).alias("stage"), F.array_max(S.softmax(F.col("l"))).alias("conf"))
    e = e.withColumn("epoch", F.pmod("vec_id", F.lit(41)).cast("int"))
    return windows.smoothed(e.select("night", "epoch", "stage", "conf"), ["night"], ["epoch"], "stage", "conf").select("night", "epoch", F.col("smoothed").alias("stage"))


def daily_counts(spark, d):
    """Daily sums, then their mean by user; weekday means."""
    e = events(spark, d).withColumns({"day": F.to_date("ts"), "wd": F.weekday("ts")})
    daily = e.groupBy("user_id", "day", "wd").agg(F.sum("value").alias("s"))
    return rounded(daily.groupBy("user_id").agg(F.avg("s").alias("mean_daily"), F.avg(F.when(F.col("wd") < 5, F.col("s"))).alias("mean_weekday"), F.count(F.lit(1)).alias("days")))


def user_regression(spark, d):
    e = events(spark, d)
    corr = F.try_divide(F.covar_pop("value", "k"), F.nullif(F.stddev_pop("value") * F.stddev_pop("k"), F.lit(0.0)))
    return rounded(e.groupBy("user_id").agg(F.regr_slope("value", "k").alias("slope"), F.regr_intercept("value", "k").alias("intercept"), corr.alias("r"), F.percentile("value", 0.9).alias("p90"), F.median("value").alias("median")))


QUERIES = {f.__name__: f for f in (zscore_by_supplier, robust_by_supplier, value_trend, score_smoothing, drift, type_spans, night_position, weekly_windows, majority_type, events_in_ranges, span_overlap, last_purchase, around_purchases, latest_event, range_scan, trigger_and_cooldown, stage_softmax, smoothed_stages, daily_counts, user_regression)}
_Z = "round(coalesce(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0), 0), 6) AS {c}_z"
_E = "WITH " + EVENTS
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)"
_SM = "list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 10)"
ORACLES = {
    "zscore_by_supplier": f"SELECT l_orderkey, l_linenumber, {_Z.format(c='l_quantity')}, {_Z.format(c='l_extendedprice')} FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)",
    "robust_by_supplier": """WITH m AS (SELECT l_suppkey, median(l_quantity) AS mq, median(l_extendedprice) AS mp, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iq FROM lineitem GROUP BY 1),
j AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity - mq AS dq, l_extendedprice - mp AS dp, iq FROM lineitem JOIN m USING (l_suppkey)),
a AS (SELECT l_suppkey, median(abs(dq)) AS aq, median(abs(dp)) AS ap FROM j GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(dq / CASE WHEN aq <= 1e-8 THEN 1 ELSE 1.4826 * aq END, 6) AS l_quantity_rz, round(dp / CASE WHEN ap <= 1e-8 THEN 1 ELSE 1.4826 * ap END, 6) AS l_extendedprice_rz, round(dq / CASE WHEN iq = 0 THEN 1 ELSE iq END, 6) AS l_quantity_iz FROM j JOIN a USING (l_suppkey)""",
    "value_trend": _E + """, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
g AS (SELECT user_id, count(*) AS n, avg(CASE WHEN i <= c // 2 THEN value END) AS first_avg, avg(CASE WHEN i > c // 2 THEN value END) AS second_avg FROM w GROUP BY 1)
SELECT user_id, n, round(first_avg, 6) AS first_avg, round(second_avg, 6) AS second_avg, CASE WHEN n < 4 THEN 'stable' WHEN second_avg - first_avg > 5 THEN 'improving' WHEN second_avg - first_avg < -5 THEN 'declining' ELSE 'stable' END AS trend FROM g""",
    "score_smoothing": _E + ", w AS (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS a FROM ev) SELECT event_id, CAST(floor(round(a, 6) + 0.5) AS BIGINT) AS smoothed, round(a, 6) AS avg24 FROM w",
    "drift": _E + """, h AS (SELECT event_id, count(*) OVER w AS samples, sum(CAST(k AS BIGINT)) OVER w / CAST(count(k) OVER w AS DOUBLE) / 100 AS c, avg(CASE WHEN k < 50 THEN 1.0 ELSE 0.0 END) OVER w AS l, var_pop(value) OVER w AS v FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT event_id, samples, round(CASE WHEN samples >= 20 THEN c ELSE 1.0 END, 10) AS mean_confidence, round(CASE WHEN samples >= 20 THEN l ELSE 0.0 END, 10) AS low_rate, samples >= 20 AND v < 1 AS degenerate, samples >= 20 AND (v < 1 OR l > 0.5) AS drift FROM h""",
    "type_spans": _E + """, a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS isl FROM a), g AS (SELECT user_id, isl, min(event_type) AS event_type, min(ms) AS s, max(ms) AS e, count(*) AS n FROM b GROUP BY 1, 2)
SELECT user_id, event_type, s AS span_start, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY isl), e) AS span_end, n FROM g""",
    "night_position": _E + f", w0 AS (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev {_W}) SELECT event_id, round(CASE WHEN n = 1 THEN 0.0 ELSE -1.0 + 2.0 * i / (n - 1) END, 6) AS time_of_night FROM w0",
    "weekly_windows": _E + f""", f AS (SELECT user_id, min(ms) AS t0, max(ms) AS t1 FROM ev GROUP BY 1),
w AS (SELECT user_id, win, t0 + win * {24 * HOUR} AS win_start FROM f, range(0, 400) AS r(win) WHERE t0 + win * {24 * HOUR} + {48 * HOUR} <= t1)
SELECT w.user_id, CAST(win AS BIGINT) AS win, CAST(win_start AS BIGINT) AS win_start, count(*) AS n, round(avg(value), 6) AS avg_value FROM w JOIN ev ON ev.user_id = w.user_id AND ms >= win_start AND ms < win_start + {48 * HOUR} GROUP BY 1, 2, 3""",
    "majority_type": _E + """, c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, day) AS share, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, day, event_type, round(share, 6) AS share FROM r WHERE r = 1 AND share >= 0.5""",
    "events_in_ranges": _E + f" SELECT a.event_id, b.event_id AS range_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.ms >= b.ms AND a.ms < b.ms + {6 * HOUR}",
    "span_overlap": _E + f""", a AS (SELECT DISTINCT user_id, ms AS a_start, ms + {12 * HOUR} AS a_end FROM ev WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, ms AS b_start, ms + {8 * HOUR} AS b_end FROM ev WHERE event_type = 'purchase')
SELECT a.user_id, a_start, a_end, CAST(sum(CASE WHEN b_start IS NULL THEN 0 ELSE least(a_end, b_end) - greatest(a_start, b_start) END) AS BIGINT) AS overlap FROM a LEFT JOIN b ON a.user_id = b.user_id AND b_start < a_end AND b_end > a_start GROUP BY 1, 2, 3""",
    "last_purchase": _E + """, p AS (SELECT user_id, ms, last(value ORDER BY event_id) AS value FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2), l AS (SELECT * FROM ev WHERE event_type <> 'purchase')
SELECT l.event_id, round(p.value, 6) AS last_value FROM l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.ms >= p.ms""",
    "around_purchases": _E + f" SELECT a.event_id, round(avg(b.value), 6) AS s_mean, round(stddev_pop(b.value), 6) AS s_std, round(min(b.value), 6) AS s_min, round(max(b.value), 6) AS s_max, count(b.value) AS s_n FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ms >= a.ms - {24 * HOUR} AND b.ms < a.ms + {24 * HOUR} WHERE a.event_type = 'purchase' GROUP BY 1",
    "latest_event": _E + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, event_id, event_type, round(value, 6) AS value, n FROM r WHERE r = 1",
    "range_scan": "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "stage_softmax": f"WITH l AS (SELECT vec_id, {_SM} AS l FROM embeddings), e AS (SELECT vec_id, l, list_max(l) AS t FROM l) SELECT vec_id, CAST(list_position(l, t) - 1 AS INTEGER) AS stage, round(1.0 / list_sum(list_transform(l, lambda x: exp(x - t))), 6) AS conf FROM e",
    "trigger_and_cooldown": "WITH RECURSIVE " + EVENTS + f""", o AS (SELECT user_id, ms, value, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM ev),
f AS (SELECT user_id, i, value AS last_v, ms AS last_t, 1 AS hit, 1 AS ok FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN abs(o.value - f.last_v) >= 7 THEN o.value ELSE f.last_v END, CASE WHEN o.ms - f.last_t >= {12 * HOUR} THEN o.ms ELSE f.last_t END, CASE WHEN abs(o.value - f.last_v) >= 7 THEN 1 ELSE 0 END, CASE WHEN o.ms - f.last_t >= {12 * HOUR} THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, CAST(sum(hit) AS BIGINT) AS n_triggered, CAST(sum(ok) AS BIGINT) AS n_cooled FROM f GROUP BY 1""",
    "smoothed_stages": f"""WITH RECURSIVE l AS (SELECT vec_id, {_SM} AS l FROM embeddings), e AS (SELECT CAST(vec_id // 41 AS BIGINT) AS night, CAST(vec_id % 41 AS INTEGER) AS epoch, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS stage, 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS conf FROM l),
s AS (SELECT night, epoch, stage AS own, conf, row_number() OVER w AS i, lead(stage) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY night ORDER BY epoch)),
f AS (SELECT night, epoch, i, own AS stage FROM s WHERE i = 1 UNION ALL SELECT s.night, s.epoch, s.i, CASE WHEN s.nxt = f.stage AND s.own <> f.stage AND s.conf < 0.6 THEN f.stage ELSE s.own END FROM f JOIN s ON s.night = f.night AND s.i = f.i + 1)
SELECT night, epoch, stage FROM f""",
    "daily_counts": "WITH dd AS (SELECT user_id, CAST(ts AS DATE) AS day, isodow(ts) - 1 AS wd, sum(value) AS s FROM events GROUP BY ALL) SELECT user_id, round(avg(s), 6) AS mean_daily, round(avg(CASE WHEN wd < 5 THEN s END), 6) AS mean_weekday, count(*) AS days FROM dd GROUP BY 1",
    "user_regression": _E + " SELECT user_id, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept, round(covar_pop(value, k) / nullif(stddev_pop(value) * stddev_pop(k), 0), 6) AS r, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS median FROM ev GROUP BY 1",
}
