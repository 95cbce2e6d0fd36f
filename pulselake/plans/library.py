"""Stored tables, epochs and streams, records, batches of wearables, gates, lookups and explanations over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions import scalar as S
from pulselake.operators import charts, checkins, explain, features, joins, models, night, places, recommend, segments, signal, training
from pulselake.plans.models import _MASTER, STRESS, WIN, _master
from pulselake.sources.scratch import scratch
from pulselake.plans import sequences
from pulselake.plans.sequences import HOUR, ORDER
from pulselake.plans.views import EVENTS, STAGES, events, rounded, stages, table
from pulselake.plans.wellness import _SCORE, _scored
from pulselake.sources import binary, records, tables
from pulselake.streaming import epochs, stateful

DAY = tables.DAY_MS
_E = "WITH " + EVENTS
SAMPLES = "user_id long, ms long, kind string, value double"

# ---------------------------------------------------------------- stored tables


def upserted_settings(spark, d):
    """Events as settings that users change: three upserts, of which the last comes first; each setting keeps its latest value."""
    e = events(spark, d).groupBy("user_id", F.col("event_type").alias("name"), F.col("ms").alias("ts_ms")).agg(F.max("value").cast("string").alias("value"), F.max("event_id").alias("_i"))
    store = tables.Store(spark, scratch(spark, "settings"))
    for part in (2, 0, 1, 2):  # the first batch once more, as after a failure
        store.upsert("settings", e.where(F.pmod("_i", F.lit(3)) == part).drop("_i"))
    return store.read("settings").select("user_id", "name", "ts_ms", "value")


def retained_light(spark, d):
    """Light samples of all events, stored by day; those older than 30 days on the 10th of February go."""
    store = tables.Store(spark, scratch(spark, "light"))
    store.append("light", events(spark, d).select("user_id", F.col("ms").alias("ts_ms"), F.col("value").alias("lux")))
    store.retain(1_707_523_200_000)
    return store.read("light").select("user_id", "ts_ms", "lux")


def rederived_diversity(spark, d):
    """Daily scores of all users; those from the 5th to the 9th are derived again, twice, with one user left out and deleted."""
    e = events(spark, d).groupBy("user_id", (F.floor(F.col("ms") / DAY) * DAY).alias("ts_ms")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    store = tables.Store(spark, scratch(spark, "diversity"))
    store.append("diversity", e)
    start, end = 1_704_412_800_000, 1_704_758_400_000 + DAY - 1
    again = e.where(F.col("ts_ms").between(start, end)).withColumn("score", -F.col("score"))
    store.rederive("diversity", again, start, end)
    store.rederive("diversity", again, start, end)
    store.delete_all(1)
    return store.read("diversity").select("user_id", "ts_ms", "score")


# ---------------------------------------------------------------- epochs, in batch and as a stream


def _samples(spark, d):
    """Heart samples of all events, motion samples half a second to two seconds later, and an end marker for each user."""
    e = events(spark, d)
    heart = e.select("user_id", "ms", F.lit(epochs.HEART).alias("kind"), (40 + F.col("value")).alias("value"))
    motion = e.select("user_id", F.explode(F.array(F.col("ms") + 500, F.col("ms") + 2000)).alias("ms"), F.lit(epochs.MOTION).alias("kind"), F.col("k").alias("value")).withColumn("value", F.col("value") + F.pmod("ms", F.lit(7)))
    ends = e.groupBy("user_id").agg((F.max("ms") + 60_000).alias("ms")).select("user_id", "ms", F.lit(epochs.END).alias("kind"), F.lit(None).cast("double").alias("value"))
    return heart.unionByName(motion).unionByName(ends)


def night_epochs(spark, d):
    """Thirty-second epochs of every user's samples: heart figures around each, motion in it, and the change from the one before."""
    return rounded(epochs.stored_night_epochs(_samples(spark, d), ["user_id"]))


def night_epochs_stream(spark, d):
    """The same from a stream in event time, by timers; a late record of nobody moves the watermark past all end markers."""
    at, key = scratch(spark, "epochs"), "spark.sql.streaming.stateStore.providerClass"
    samples = _samples(spark, d)
    push = spark.createDataFrame([(None, 4_000_000_000_000, epochs.MOTION, 0.0)], SAMPLES)
    samples.select("user_id", F.col("ms").cast("long").alias("ms"), "kind", "value").unionByName(push).write.parquet(f"{at}/in")
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = epochs.night_epochs(spark.readStream.schema(SAMPLES).parquet(f"{at}/in"), ["user_id"])
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return rounded(spark.read.schema(out.schema).parquet(f"{at}/out"))


def _streamed(stream: DataFrame, at: str, schema) -> DataFrame:
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/out")


def stream_deltas(spark, d):
    """Change of each event's value from the user's event before, as a stream of one micro-batch; 0 unless it was within the hour."""
    at = scratch(spark, "deltas")
    e = events(spark, d).select("user_id", (F.floor(F.col("ms") / 3_600_000) * 3_600_000).alias("ms"), "value", "event_id").groupBy("user_id", "ms").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    e.write.parquet(f"{at}/in")
    out = stateful.deltas(spark.readStream.schema(e.schema).parquet(f"{at}/in"), "user_id", "ms", "value", "event_id", 3_600_000)
    return rounded(_streamed(out, at, out.schema))


def stream_days(spark, d):
    """One event of each user and day from a stream: how many, and that none stands twice."""
    at = scratch(spark, "days")
    e = events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{at}/in")
    kept = _streamed(stateful.once_a_day(spark.readStream.schema(e.schema).parquet(f"{at}/in"), ["user_id"], "ts"), at, e.schema)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))


def stream_upserts(spark, d):
    """Each user's latest event from a stream, kept in partitions by day, on whatever day it comes."""
    at = scratch(spark, "latest")
    e = events(spark, d).select("user_id", "event_id", "value", F.floor(F.col("ms") / DAY).alias("day"))
    e.write.parquet(f"{at}/in")
    stateful.upsert_latest(spark.readStream.schema(e.schema).parquet(f"{at}/in"), f"{at}/out", ["user_id"], "event_id", "day", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{at}/out").select("user_id", "event_id", "value", "day")


# ---------------------------------------------------------------- records and batches


def nested_heart(spark, d):
    """Heart records of a user's day, with samples nested in them, read back for two weeks as flat samples."""
    e = events(spark, d).withColumn("day", F.floor(F.col("ms") / DAY))
    r = e.groupBy("user_id", "day").agg(F.min("ms").alias("start_ms"), F.collect_list(F.struct(F.col("ms").alias("time_ms"), (40 + F.col("value")).alias("bpm"))).alias("samples"))
    r = r.withColumn("source", F.when(F.pmod("user_id", F.lit(3)) != 0, F.concat(F.lit("watch"), F.col("user_id"))))
    return rounded(records.heart_rate(r, "user_id", 1_704_240_000_000, 1_705_449_600_000))


def nested_sleep(spark, d):
    """Sleep records with numbered stages, read back as named ones, a row each; a third of the records have no stages."""
    e = events(spark, d).withColumn("day", F.floor(F.col("ms") / DAY))
    r = e.groupBy("user_id", "day").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.collect_list(F.struct(F.col("ms").alias("start_ms"), (F.col("ms") + 60_000).alias("end_ms"), F.pmod("event_id", F.lit(9)).cast("int").alias("stage"))).alias("stages"))
    r = r.withColumns({"source": F.lit(None).cast("string"), "stages": F.when(F.pmod(F.col("user_id") + F.col("day"), F.lit(3)) != 0, F.col("stages"))})
    return records.stage_rows(records.sleep_records(r, "user_id", 1_704_240_000_000, 1_705_449_600_000), "user_id")


def readings(spark, d):
    """Single readings of two weeks, missing ones 0; steps of the same range; the last of each user."""
    e = events(spark, d).select("event_id", "user_id", F.col("ms").alias("ts_ms"), F.col("ms").alias("start_ms"), (F.col("ms") + 60_000).alias("end_ms"), F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("value")).alias("celsius"), F.col("k").alias("count"))
    low, high = 1_704_240_000_000, 1_705_449_600_000
    temp = records.point_records(e, "user_id", "celsius", low, high, 0.0).groupBy("user_id").agg(F.sum("celsius").alias("celsius"), F.count(F.lit(1)).alias("n"))
    steps = records.step_records(e, "user_id", low, high).groupBy("user_id").agg(F.sum("count").alias("steps"))
    last = records.latest_value(e, ["user_id"], "ts_ms", "count", "event_id").withColumnRenamed("count", "last_count")
    return rounded(temp.join(steps, "user_id", "full").join(last, "user_id", "full"))


def _packed(kind: str, cols: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            samples, counts = b["samples"].flatten(), b["samples"].value_lengths().to_numpy(zero_copy_only=False)
            of = lambda c: samples.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            rows = np.empty(len(samples), binary.RECORDS[kind])
            rows["ts_ms"] = of("ms")
            for field, c in zip(rows.dtype.names[1:], cols, strict=True):
                rows[field] = of(c)[:, None] if rows[field].ndim > 1 else of(c)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(binary.encode_all(kind, rows, counts), pa.binary())], names=["path", "content"])

    return run


def wearable_batches(spark, d):
    """All events as light, location and sleep batches of ten days of a user each, through base64 text, and decoded again."""
    e = events(spark, d).withColumns({"path": F.concat_ws("-", "user_id", F.floor(F.col("ms") / (10 * DAY))), "lat": 30 + F.col("value") / 1000, "k0": F.coalesce("k", F.lit(0.0))})
    # One list of samples for each user and ten days serves all kinds, and many go to Python in one batch.
    held = e.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ms", "event_id", "value", "lat", "k0"))).alias("samples"))
    out = None
    for kind, cols in (("light", ["value"]), ("location", ["lat", "k0", "value"]), ("sleep", ["value"])):
        raw = held.mapInArrow(_packed(kind, cols), "path string, content binary").select("path", F.base64("content").alias("payload"))
        got = binary.from_base64(raw, kind)
        value = {"light": [F.col("lux").cast("double"), F.col("is_outdoors").cast("double"), F.lit(None)], "location": [F.col("latitude"), F.col("longitude"), F.col("accuracy").cast("double")], "sleep": [F.get("f", F.lit(0)).cast("double"), F.get("f", F.lit(9)).cast("double"), F.size("f").cast("double")]}[kind]
        part = got.select(F.lit(kind).alias("kind"), "path", "ts_ms", *[v.cast("double").alias(n) for v, n in zip(value, "abc", strict=True)])
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


# ---------------------------------------------------------------- gates, lookups, joins


def _damaged(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type", F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("a"), F.when(F.col("k") % 7 == 0, F.lit(float("inf"))).when(F.col("k") % 7 == 1, F.lit(float("-inf"))).otherwise(F.col("k")).alias("b"))


def repaired_values(spark, d):
    return rounded(features.repaired(_damaged(spark, d), ["a", "b"]).select("event_id", "a", "b", "n_repaired"))


def valid_events(spark, d):
    """Events of three types whose values are finite."""
    return features.valid_rows(_damaged(spark, d), "event_type", ["view", "click", "error"], ["a", "b"]).select("event_id")


def split_triggers(spark, d):
    """Triggers and cooldowns as trigger_and_cooldown counts them, with each user's rows in as many tasks as they need."""
    e = events(spark, d)
    hits = segments.triggered(e, ["user_id"], ORDER, "value", 7.0).groupBy("user_id").agg(F.count_if("hit").alias("n_triggered"))
    cool = segments.cooled_down(e, ["user_id"], ORDER, "ms", 12 * HOUR).groupBy("user_id").agg(F.count_if("let_through").alias("n_cooled"))
    return hits.join(cool, "user_id")


def covered_days(spark, d):
    """Events of the days on which a user has three fifths of four at least."""
    e = events(spark, d).withColumn("day", F.floor(F.col("ms") / DAY))
    return features.covered(e, ["user_id", "day"], 4, 0.6, 2).select("event_id")


def sampling_rates(spark, d):
    return rounded(features.sampling_rate(events(spark, d).withColumn("t", F.col("ms") / 1000), ["user_id"], "t"))


def priced_orders(spark, d):
    """Orders with the template of their priority: its number and how long it may take."""
    o = table(spark, d, "orders")
    t = o.select("o_orderpriority").distinct().withColumns({"grade": F.substring("o_orderpriority", 1, 1).cast("int"), "days": F.length("o_orderpriority") * 2})
    return joins.looked_up(o, t, "o_orderpriority").select("o_orderkey", "grade", "days")


def aligned_channels(spark, d):
    """Each user's events as a signal of 4 Hz and every other one as one of 2 Hz, cut into whole windows of 2 s."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    e = events(spark, d).withColumn("i", F.row_number().over(w))
    s = F.struct("i", "value")
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["value"]).alias("base"), F.transform(F.array_sort(F.collect_list(F.when(F.col("i") % 2 == 0, s))), lambda x: x["value"]).alias("half"))
    m = signal.multi_rate(g, "base", 4, {"half": 2}, 2, ["user_id"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(m.select("user_id", "win", total("base").alias("base"), total("half").alias("half"), F.size("half").alias("n")))


def novel_points(spark, d):
    """Points of the second half of the month that are nowhere near a point of the first half of the same user."""
    p = events(spark, d).select("event_id", "user_id", "ms", (59.9 + F.col("value") / 2000).alias("lat"), (179.99 + F.coalesce("k", F.lit(0.0)) / 5000).alias("lon"))
    p = p.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    late, early = p.where(F.col("ms") >= 1_705_363_200_000), p.where(F.col("ms") < 1_705_363_200_000)
    return joins.unknown_places(late, early.select("user_id", "lat", "lon"), ["user_id"]).select("event_id")


def zipped_days(spark, d):
    """Each user's values and counts by weekday as arrays, side by side."""
    e = events(spark, d).groupBy("user_id", F.dayofweek("ts").alias("w")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("vs"), F.transform(F.array_sort(F.collect_list(F.when(F.col("w") > 2, F.struct("w", "n")))), lambda x: x["n"]).alias("ns"))
    return rounded(joins.zipped(g, {"value": "vs", "n": "ns"}))


def stays(spark, d):
    """Runs of each user's points near a running centroid, and the place that each belongs to."""
    p = events(spark, d).select("user_id", "event_id", F.col("ms").alias("ts_ms"), (30 + F.floor(F.coalesce("k", F.lit(0.0)) / 34) * 0.01 + F.col("value") / 1e6).alias("lat"), (31 + F.pmod("user_id", F.lit(7)) * 0.01).alias("lon"))
    return rounded(places.stays(p))


def legs(spark, d):
    """Metres from each event's place to the user's next one."""
    p = events(spark, d).select("event_id", "user_id", "ms", (F.col("value") / 10 - 30).alias("lat"), (F.coalesce("k", F.lit(0.0)) * 3 - 150).alias("lon"))
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    return rounded(p.select("event_id", S.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)).alias("metres")), 3)


def watch_scores(spark, d):
    """Stress from the heart rate alone, and how well a step worked that each event stands for."""
    e = events(spark, d)
    return rounded(e.select("event_id", S.watch_stress(40 + F.col("value"), F.lit(60.0)).alias("stress"), S.effectiveness(F.col("value"), F.col("k"), F.col("k") + 5, F.col("value") + 3).alias("effect")), 9)


def checkin_texts(spark, d):
    """Tips out of what was said, context lines and alerts."""
    c = table(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    context = checkins.context_lines(F.when(n % 2 == 0, n), F.lit(None), n % 100, F.lit(None), F.when(n % 3 == 0, n % 50), F.when(n % 4 == 1, n / 7.0), F.when(n % 5 == 0, "").otherwise("calm"))
    alert = checkins.alert_text(F.when(n % 4 == 0, "hrv_low").when(n % 4 == 1, "hr_elevated").when(n % 4 == 2, "temp_drop").otherwise("other"), F.when(n % 3 != 0, -n / 7.0))
    return c.select("conv_id", "turn", "role", checkins.cleaned_tip(F.col("text")).alias("tip"), context.alias("context"), alert.alias("alert"))


def stage_recordings(spark, d):
    """Nights of each user as recordings of four classes: epochs a night and shares."""
    e = events(spark, d).select("user_id", F.floor(F.col("ms") / DAY).alias("night"), F.pmod("event_id", F.lit(4)).cast("int").alias("class"))
    return rounded(night.recording_summary(e, ["user_id"], "night", "class"))


def fewest_features(spark, d):
    """The least number of features whose mean score is within a hundredth of the best."""
    s = events(spark, d).where("k IS NOT NULL").groupBy((F.col("k") % 20).cast("int").alias("n_features")).agg((F.avg("value") / 500).alias("score"))
    return rounded(training.smallest_within(s, "n_features", "score"))


def example_items(spark, d):
    """The most confident right and wrong line item of each supplier."""
    s = _scored(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", "prob", (F.col("l_returnflag") == "R").cast("int").alias("y")).withColumns({"z": (F.col("prob") >= 0.5).cast("int"), "conf": F.round(F.abs(F.col("prob") - 0.5), 9), "tie": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    return rounded(models.best_examples(s, ["l_suppkey"], "y", "z", "conf", ["tie"], "tie"))


def united_features(spark, d):
    """Feature sets of two tables, one below the other; what one lacks is null."""
    a = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
    return rounded(features.union_all([a, b]))


def windows_of_29(spark, d):
    """All 29 features of each user's week in one plan, spectrum, entropy and scaling exponent among them (no SQL; the tests have a twin)."""
    from pulselake.operators import hrv
    from pulselake.plans.hrv import _rr

    rr = _rr(spark, d).withColumn("week", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604_800)).select(*WIN, "ts", "event_id", "rr")
    return rounded(features.complete(_master(spark, d), hrv.series_features(rr, WIN, ["ts", "event_id"]), WIN))


def tree_attributions(spark, d):
    """What each feature adds to the trees' sum for every feature window, exactly; and the expectation."""
    m = _master(spark, d).select(*WIN, *STRESS["features"])
    out, base = explain.attributed(m, STRESS, explain.covers(m, STRESS))
    return rounded(out.select(*WIN, *[F.get("attributions", F.lit(i)).alias(f) for i, f in enumerate(STRESS["features"])], F.lit(base).alias("expected")))


# ---------------------------------------------------------------- charts


def hypnograms(spark, d):
    """Where each sleep stage of every user's day is drawn."""
    h = charts.hypnogram(stages(spark, d).select("user_id", "day", "event_id", "start_ms", "end_ms", "stage"), ["user_id", "day"])
    return rounded(h.select("event_id", "row", "x0", "x1", "y"))


def drawn_lines(spark, d):
    """Each user's events as points of a line."""
    return rounded(charts.line_points(events(spark, d), ["user_id"], ["ms", "event_id"], "value", 320.0, 100.0, 500.0).select("event_id", "x", "y"))


def days_in_words(spark, d):
    """Mood, anxiety and heart rate that each user's day stands for."""
    g = events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("stress"))
    return g.select("user_id", "day", charts.day_in_words(F.col("stress")).alias("_w")).select("user_id", "day", "_w.*")


def weekday_values(spark, d):
    """Means by weekday over the week before the 20th, of all users but three."""
    e = charts.without_subjects(events(spark, d).withColumn("who", F.concat(F.lit("S"), F.col("user_id"))), "who", ("S2", "S3", "S14"))
    return charts.weekday_means(e, ["user_id"], "ts", "value", F.lit("2024-01-20").cast("timestamp"))


# ---------------------------------------------------------------- recommendations with every input


def _every_input(spark, d):
    n = F.col("user_id")
    e = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("v"), F.avg("k").alias("k"))
    of = lambda m, p: F.pmod(n * p, F.lit(m)).cast("double")
    return e.select(
        "user_id", F.least(F.lit(100.0), F.round(F.col("v") * 1.2, 6)).alias("stress"), of(101, 17).alias("anxiety"), (n % 2 == 0).alias("anxiety_sustained"), of(100, 13).alias("sleep_quality"), (of(50, 7) / 50 + 0.3).alias("sleep_efficiency"), F.when(n % 5 != 0, of(100, 11)).alias("sleep_consistency"), (n % 3 == 0).alias("has_baseline"),
        (of(200, 19) / 100 - 1).alias("sentiment"), (of(10, 3) / 10).alias("fatigue"), (of(10, 7) / 10).alias("sadness"), F.pmod(n * 5, F.lit(24)).cast("int").alias("hour"), (n % 7 == 0).alias("monotonous"), of(100, 23).alias("diversity"), (of(10, 9) / 10).alias("sun_progress"), of(40, 29).alias("sun_minutes"))


def recommendations_in_full(spark, d):
    """The best three of all 22 rules, without what each user got within the last four hours of the month."""
    last = events(spark, d).where(F.col("ms") > 1_706_659_200_000 - 4 * 3_600_000)
    recent = last.select("user_id", F.when(F.pmod("event_id", F.lit(2)) == 0, "explore_nature").otherwise("outdoor_sunlight").alias("intervention")).distinct()
    return rounded(recommend.recommend(_every_input(spark, d), ["user_id"], recent))


_ALL = (
    upserted_settings, retained_light, rederived_diversity, night_epochs, night_epochs_stream, stream_deltas, stream_days, stream_upserts, nested_heart, nested_sleep, readings, wearable_batches, repaired_values, valid_events, split_triggers, covered_days, sampling_rates,
    priced_orders, aligned_channels, novel_points, stays, zipped_days, legs, watch_scores, checkin_texts, stage_recordings, fewest_features, example_items, united_features, windows_of_29, tree_attributions, hypnograms, drawn_lines, days_in_words, weekday_values, recommendations_in_full)
QUERIES = {f.__name__: f for f in _ALL}

# ---------------------------------------------------------------- the same in SQL

_EPOCHS = _E + """, h AS (SELECT user_id, ms, 40 + value AS v FROM ev), a AS (SELECT user_id, ms + o AS ms, k + (ms + o) % 7 AS v FROM ev, (VALUES (500), (2000)) w(o) WHERE k IS NOT NULL),
z AS (SELECT user_id, max(ms) + 60000 AS fin FROM ev GROUP BY 1), f AS (SELECT x.user_id, min(ms) // 30000 AS e0 FROM (SELECT user_id, ms FROM h UNION ALL SELECT user_id, ms FROM a) x JOIN z ON x.user_id = z.user_id AND x.ms < fin GROUP BY 1),
p AS (SELECT h.user_id, h.ms, h.v, (h.ms // 30000) + g AS e FROM h JOIN z ON z.user_id = h.user_id AND h.ms < fin, range(-5, 6) r(g) WHERE h.ms >= ((h.ms // 30000) + g) * 30000 - 105000 AND h.ms < ((h.ms // 30000) + g) * 30000 + 135000),
q AS (SELECT p.*, v - lag(v) OVER (PARTITION BY p.user_id, e ORDER BY ms, v) AS dd FROM p JOIN f ON f.user_id = p.user_id JOIN z ON z.user_id = p.user_id WHERE e >= e0 AND e * 30000 < fin),
s AS (SELECT user_id, e, count(*) AS n, avg(v) AS hr_mean, stddev_pop(v) AS hr_std, min(v) AS hr_min, max(v) AS hr_max, CASE WHEN count(*) > 2 THEN stddev_pop(dd) ELSE 0.0 END AS hr_sdsd FROM q GROUP BY 1, 2),
b AS (SELECT user_id, ms // 30000 AS e, v, abs(v - lag(v) OVER (PARTITION BY user_id, ms // 30000 ORDER BY ms, v)) AS dd FROM a),
c AS (SELECT user_id, e, coalesce(sum(dd), 0.0) AS act_count, coalesce(max(dd), 0.0) AS act_max, CASE WHEN count(*) > 1 THEN stddev_pop(v) ELSE 0.0 END AS act_std FROM b GROUP BY 1, 2)
SELECT s.user_id, s.e * 30000 AS epoch, n, round(hr_mean, 6) AS hr_mean, round(hr_std, 6) AS hr_std, round(hr_min, 6) AS hr_min, round(hr_max, 6) AS hr_max, round(hr_max - hr_min, 6) AS hr_range, round(hr_sdsd, 6) AS hr_sdsd,
  round(CASE WHEN lag(s.e) OVER w = s.e - 1 THEN hr_mean - lag(hr_mean) OVER w ELSE 0.0 END, 6) AS hr_delta_prev, round(coalesce(act_count, 0.0), 6) AS act_count, round(coalesce(act_max, 0.0), 6) AS act_max, round(coalesce(act_std, 0.0), 6) AS act_std
FROM s LEFT JOIN c ON c.user_id = s.user_id AND c.e = s.e WINDOW w AS (PARTITION BY s.user_id ORDER BY s.e)"""

_STAGE = "CASE stage " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in records.STAGE_NAMES.items()) + " ELSE 'unknown' END"
_BAD = _E + ", b AS (SELECT event_id, event_type, CASE WHEN k % 5 = 0 THEN 'nan'::DOUBLE ELSE value END AS a, CASE WHEN k % 7 = 0 THEN 'inf'::DOUBLE WHEN k % 7 = 1 THEN '-inf'::DOUBLE ELSE k END AS b FROM ev)"
_HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - ({a})))"


def _metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return _HAV.format(a=a)


def _leaf(f: str) -> str:
    """The leaf of the tree of one split on f; what f adds is that less the mean leaf over all windows."""
    t = next(t for t in STRESS["trees"] if t["split"] == f)
    yes, no = (next(c["leaf"] for c in t["children"] if c["nodeid"] == t[k]) for k in ("yes", "no"))
    return f"CASE WHEN {f} IS NULL OR {f} < {t['split_condition']} THEN {yes} ELSE {no} END"


_LEAVES = {f: _leaf(f) for f in ("hr_mean", "rmssd", "temp_mean")}
_RULES = """(1, 'breathing_box', 'biometric', 0.95, stress >= 70), (2, 'meditation_grounding', 'biometric', 0.85, stress >= 70), (3, 'breathing_coherent', 'biometric', 0.7, stress >= 50 AND stress < 70), (4, 'physical_walk', 'biometric', 0.6, stress >= 50 AND stress < 70),
(5, 'meditation_grounding', 'biometric', 0.9, anxiety >= 70), (6, 'breathing_478', 'biometric', 0.85, anxiety >= 70), (7, 'social_reach_out', 'pattern', 0.8, anxiety >= 70 AND sustained), (8, 'journaling_expressive', 'biometric', 0.6, anxiety >= 50 AND anxiety < 70), (9, 'sleep_wind_down', 'pattern', 0.7, quality < 50),
(10, 'sleep_consistent', 'pattern', 0.65, efficiency < 0.75), (11, 'sleep_consistent', 'pattern', 0.6, regular < 50 AND has_baseline), (12, 'journaling_expressive', 'checkin', 0.75, sentiment < -0.5), (13, 'physical_stretch', 'checkin', 0.5, fatigue > 0.5), (14, 'social_reach_out', 'checkin', 0.7, sadness > 0.5),
(15, 'sleep_wind_down', 'schedule', 0.55, hour BETWEEN 20 AND 23 AND stress > 40), (16, 'journaling_gratitude', 'schedule', 0.3, hour BETWEEN 6 AND 9), (17, 'explore_new_place', 'pattern', 0.7, monotonous), (18, 'explore_nature', 'pattern', 0.6, diversity < 20), (19, 'explore_nature', 'pattern', 0.8, monotonous AND stress >= 50),
(20, 'outdoor_sunlight', 'pattern', 0.8, progress < 0.5 AND hour BETWEEN 10 AND 14), (21, 'outdoor_walk_sunshine', 'schedule', 0.6, progress < 0.5 AND hour NOT BETWEEN 10 AND 14 AND hour < 15), (22, 'outdoor_sunlight', 'pattern', 0.75, sun_minutes < 10 AND hour >= 14)"""
_RECOMMEND = _E + f""", i AS (SELECT user_id, least(100.0, round(avg(value) * 1.2, 6)) AS stress, CAST(user_id * 17 % 101 AS DOUBLE) AS anxiety, user_id % 2 = 0 AS sustained, CAST(user_id * 13 % 100 AS DOUBLE) AS quality, user_id * 7 % 50 / 50.0 + 0.3 AS efficiency, CASE WHEN user_id % 5 <> 0 THEN user_id * 11 % 100 END AS regular, user_id % 3 = 0 AS has_baseline,
  user_id * 19 % 200 / 100.0 - 1 AS sentiment, user_id * 3 % 10 / 10.0 AS fatigue, user_id * 7 % 10 / 10.0 AS sadness, user_id * 5 % 24 AS hour, user_id % 7 = 0 AS monotonous, user_id * 23 % 100 AS diversity, user_id * 9 % 10 / 10.0 AS progress, user_id * 29 % 40 AS sun_minutes FROM ev GROUP BY 1),
c AS (SELECT i.user_id, n, intervention, trigger, priority FROM i, LATERAL (VALUES {_RULES}) r(n, intervention, trigger, priority, fires) WHERE fires),
l AS (SELECT DISTINCT user_id, CASE WHEN event_id % 2 = 0 THEN 'explore_nature' ELSE 'outdoor_sunlight' END AS intervention FROM ev WHERE ms > 1706659200000 - 14400000),
b AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.intervention ORDER BY priority DESC, n) AS o FROM c ANTI JOIN l ON l.user_id = c.user_id AND l.intervention = c.intervention),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, n) AS rank FROM b WHERE o = 1) SELECT user_id, CAST(rank AS INTEGER) AS rank, intervention, trigger, CAST(priority AS DOUBLE) AS priority FROM k WHERE rank <= 3"""

_STAYS = "WITH RECURSIVE " + EVENTS + """, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i, ms, 30 + floor(coalesce(k, 0.0) / 34) * 0.01 + value / 1e6 AS lat, 31 + user_id % 7 * 0.01 AS lon FROM ev),
r AS (SELECT user_id, i, lat AS rlat, lon AS rlon, CAST(1 AS BIGINT) AS rn, ms AS arr, ms AS dep, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, n BIGINT)[]) AS known, CAST(NULL AS STRUCT(arr BIGINT, dep BIGINT, lat DOUBLE, lon DOUBLE, place BIGINT)) AS gone FROM p WHERE i = 1
UNION ALL SELECT user_id, i + 1, CASE WHEN stay THEN (rlat * rn + lat) / (rn + 1) ELSE lat END, CASE WHEN stay THEN (rlon * rn + lon) / (rn + 1) ELSE lon END, CASE WHEN stay THEN rn + 1 ELSE 1 END, CASE WHEN stay THEN arr ELSE ms END, ms,
  CASE WHEN stay THEN known WHEN near > 0 THEN known[1:near - 1] || [{'a': (known[near].a * known[near].n + rlat) / (known[near].n + 1), 'b': (known[near].b * known[near].n + rlon) / (known[near].n + 1), 'n': known[near].n + 1}] || known[near + 1:] ELSE known || [{'a': rlat, 'b': rlon, 'n': CAST(1 AS BIGINT)}] END,
  CASE WHEN stay THEN NULL ELSE {'arr': arr, 'dep': dep, 'lat': rlat, 'lon': rlon, 'place': CASE WHEN near > 0 THEN near - 1 ELSE len(known) END} END
FROM (SELECT r.*, p.ms, p.lat, p.lon, coalesce(""" + _metres("p.lat", "p.lon", "rlat", "rlon") + """ < 100, false) AS stay, coalesce(list_position(list_transform(known, lambda q: """ + _metres("rlat", "rlon", "q.a", "q.b") + """ < 100), true), 0) AS near
  FROM r LEFT JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1 WHERE rlat IS NOT NULL))
SELECT user_id, gone.arr AS arrival, gone.dep AS departure, round(gone.lat, 6) AS lat, round(gone.lon, 6) AS lon, CAST(gone.place AS INTEGER) AS place FROM r WHERE gone IS NOT NULL"""

ORACLES = {
    "stays": _STAYS,
    "upserted_settings": _E + " SELECT user_id, event_type AS name, max(ms) AS ts_ms, CAST(arg_max(value, ms * 1000000 + CAST(value * 100 AS BIGINT)) AS VARCHAR) AS value FROM ev GROUP BY 1, 2",
    "retained_light": _E + f" SELECT user_id, ms AS ts_ms, value AS lux FROM ev WHERE ms >= 1707523200000 - CAST(30 AS BIGINT) * {DAY}",
    "rederived_diversity": _E + f" SELECT user_id, ms // {DAY} * {DAY} AS ts_ms, CAST(count(*) AS DOUBLE) * CASE WHEN ms // {DAY} * {DAY} BETWEEN 1704412800000 AND 1704758400000 THEN -1 ELSE 1 END AS score FROM ev WHERE user_id <> 1 GROUP BY user_id, ms // {DAY}",
    "night_epochs": _EPOCHS,
    "night_epochs_stream": _EPOCHS,
    "stream_deltas": _E + ", g AS (SELECT user_id, ms // 3600000 * 3600000 AS ms, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM ev GROUP BY 1, 2) SELECT *, round(CASE WHEN ms - lag(ms) OVER w = 3600000 THEN value - lag(value) OVER w ELSE 0.0 END, 6) AS delta FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ms)",
    "stream_days": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1",
    "stream_upserts": _E + f" SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(ms // {DAY}, event_id) AS day FROM ev GROUP BY 1",
    "nested_heart": _E + f", r AS (SELECT *, min(ms) OVER (PARTITION BY user_id, ms // {DAY}) AS s FROM ev) SELECT user_id, ms AS ts_ms, round(40 + value, 6) AS bpm, CASE WHEN user_id % 3 <> 0 THEN 'watch' || user_id ELSE 'unknown' END AS source FROM r WHERE s BETWEEN 1704240000000 AND 1705449600000",
    "nested_sleep": _E + f", r AS (SELECT *, min(ms) OVER (PARTITION BY user_id, ms // {DAY}) AS s, event_id % 9 AS stage FROM ev WHERE (user_id + ms // {DAY}) % 3 <> 0) SELECT user_id, s AS session_start, ms AS start_ms, ms + 60000 AS end_ms, {_STAGE} AS stage FROM r WHERE s BETWEEN 1704240000000 AND 1705449600000",
    "readings": _E + ", i AS (SELECT * FROM ev WHERE ms BETWEEN 1704240000000 AND 1705449600000), t AS (SELECT user_id, round(sum(CASE WHEN event_id % 4 <> 0 THEN value ELSE 0.0 END), 6) AS celsius, count(*) AS n, round(sum(k), 6) AS steps FROM i GROUP BY 1), l AS (SELECT user_id, arg_max(k, ms * 1000000 + event_id) AS last_count FROM ev GROUP BY 1) SELECT coalesce(t.user_id, l.user_id) AS user_id, celsius, n, steps, last_count FROM t FULL JOIN l ON t.user_id = l.user_id",
    "wearable_batches": _E + f""", e AS (SELECT user_id || '-' || ms // {10 * DAY} AS path, ms AS ts_ms, value, CAST(CAST(value AS FLOAT) AS DOUBLE) AS f, coalesce(k, 0.0) AS k FROM ev)
SELECT 'light' AS kind, path, ts_ms, round(f, 3) AS a, CASE WHEN f >= 1000 THEN 1.0 ELSE 0.0 END AS b, CAST(NULL AS DOUBLE) AS c FROM e UNION ALL SELECT 'location', path, ts_ms, round(30 + value / 1000, 3), round(k, 3), round(f, 3) FROM e UNION ALL SELECT 'sleep', path, ts_ms, round(f, 3), round(f, 3), 10.0 FROM e""",
    "repaired_values": _BAD + " SELECT event_id, round(CASE WHEN isfinite(a) OR a IS NULL THEN a ELSE 0.0 END, 6) AS a, round(CASE WHEN isfinite(b) OR b IS NULL THEN b ELSE 0.0 END, 6) AS b, CAST(NOT isfinite(coalesce(a, 0)) AS INT) + CAST(NOT isfinite(coalesce(b, 0)) AS INT) AS n_repaired FROM b",
    "valid_events": _BAD + " SELECT event_id FROM b WHERE event_type IN ('view', 'click', 'error') AND isfinite(a) AND isfinite(b)",
    "split_triggers": sequences.ORACLES["trigger_and_cooldown"],
    "covered_days": _E + f", c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, ms // {DAY}) AS n FROM ev) SELECT event_id FROM c WHERE n >= 2.4",
    "sampling_rates": _E + " SELECT user_id, count(*) AS n, round(count(*) / nullif(max(ms) / 1000.0 - min(ms) / 1000.0, 0), 6) AS rate FROM ev GROUP BY 1",
    "priced_orders": "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS grade, CAST(length(o_orderpriority) * 2 AS INTEGER) AS days FROM orders",
    "aligned_channels": _E + ", i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM ev), n AS (SELECT user_id, least(count(*) // 8, (count(*) // 2) // 4) AS n FROM i GROUP BY 1), b AS (SELECT user_id, (i - 1) // 8 AS win, sum(value) AS base FROM i GROUP BY 1, 2), h AS (SELECT user_id, (i // 2 - 1) // 4 AS win, sum(value) AS half, count(*) AS c FROM i WHERE i % 2 = 0 GROUP BY 1, 2) SELECT b.user_id, CAST(b.win AS INTEGER) AS win, round(base, 6) AS base, round(half, 6) AS half, CAST(c AS INTEGER) AS n FROM b JOIN h ON b.user_id = h.user_id AND b.win = h.win JOIN n ON n.user_id = b.user_id WHERE b.win < n.n",
    "novel_points": _E + ", p AS (SELECT event_id, user_id, ms, 59.9 + value / 2000 AS lat, CASE WHEN 179.99 + coalesce(k, 0.0) / 5000 > 180 THEN 179.99 + coalesce(k, 0.0) / 5000 - 360 ELSE 179.99 + coalesce(k, 0.0) / 5000 END AS lon FROM ev) SELECT a.event_id FROM p a WHERE ms >= 1705363200000 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.user_id = a.user_id AND b.ms < 1705363200000 AND " + _metres("a.lat", "a.lon", "b.lat", "b.lon") + " < 100)",
    "zipped_days": _E + ", g AS (SELECT user_id, dayofweek(ts) AS w, sum(value) AS v, count(*) AS n FROM ev GROUP BY 1, 2), a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w) - 1 AS i, v FROM g), b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w) - 1 AS i, n FROM g WHERE w > 1) SELECT a.user_id, CAST(a.i AS INTEGER) AS i, round(v, 6) AS value, n FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.i = b.i",
    "legs": _E + ", p AS (SELECT event_id, user_id, ms, value / 10 - 30 AS lat, coalesce(k, 0.0) * 3 - 150 AS lon FROM ev), q AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) SELECT event_id, round(" + _metres("lat", "lon", "lat2", "lon2") + ", 3) AS metres FROM q",
    "watch_scores": _E + " SELECT event_id, round(greatest(0.0, least(100.0, (40 + value - 60.0) / 60.0 * 100)), 9) AS stress, round(greatest(0.0, least(1.0, 0.5 + greatest(-0.25, least(0.25, coalesce((value - k) / nullif(value, 0), 0.0) * 0.5)) + greatest(-0.25, least(0.25, coalesce((value + 3 - (k + 5)) / nullif(k + 5, 0), 0.0) * 0.3)))), 9) AS effect FROM ev",
    "checkin_texts": r"""WITH c AS (SELECT *, conv_id + turn AS n FROM conversations), t AS (SELECT *, trim(regexp_replace(split_part(text, chr(10), 1), '^[|\-*\d.\s]+', '')) AS x FROM c)
SELECT conv_id, turn, role, CASE WHEN length(x) >= 8 THEN x ELSE 'Take one slow breath before you begin.' END AS tip,
  concat_ws(chr(10), CASE WHEN n % 2 = 0 THEN 'heart rate: ' || n END, 'stress: ' || n % 100, CASE WHEN n % 3 = 0 THEN 'sleep quality: ' || n % 50 END, CASE WHEN n % 4 = 1 THEN 'hours slept: ' || printf('%.1f', n / 7.0) END, CASE WHEN n % 5 <> 0 THEN 'mood: calm' END) AS context,
  CASE n % 4 WHEN 0 THEN 'Low variability' WHEN 1 THEN 'Elevated heart rate' WHEN 2 THEN 'Unusual temperature' ELSE 'Wellness alert' END || CASE WHEN n % 3 <> 0 THEN ' (' || printf('%.1f', n / 7.0) || ' deviations)' ELSE '' END AS alert FROM t""",
    "stage_recordings": _E + f", n AS (SELECT user_id, ms // {DAY} AS night, count(*) AS n, " + ", ".join(f"count(*) FILTER (event_id % 4 = {i}) AS c{i}" for i in range(4)) + " FROM ev GROUP BY 1, 2) SELECT user_id, count(*) AS nights, min(n) AS least, CAST(median(n) AS DOUBLE) AS median, max(n) AS most, " + ", ".join(f"round(sum(c{i}) / CAST(sum(n) AS DOUBLE), 6) AS share_{s}" for i, s in enumerate(night.STAGES)) + " FROM n GROUP BY 1",
    "fewest_features": _E + ", s AS (SELECT CAST(k % 20 AS INTEGER) AS n_features, avg(value) / 500 AS score FROM ev WHERE k IS NOT NULL GROUP BY 1) SELECT n_features, round(score, 6) AS score FROM s WHERE score >= (SELECT max(score) FROM s) - 0.01 ORDER BY n_features LIMIT 1",
    "example_items": "WITH " + _SCORE + """, s AS (SELECT l_suppkey, CAST(l_returnflag = 'R' AS INT) AS y, CAST(prob >= 0.5 AS INT) AS z, round(abs(prob - 0.5), 9) AS conf, l_orderkey * 10 + l_linenumber AS tie FROM sc), o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, y = z ORDER BY conf DESC, tie) AS o FROM s) SELECT l_suppkey, y = z AS right, tie, round(conf, 6) AS conf FROM o WHERE o = 1""",
    "united_features": _E + " SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n, CAST(NULL AS DOUBLE) AS high FROM ev GROUP BY 1 UNION ALL SELECT o_custkey, NULL, count(*), round(max(o_totalprice), 6) FROM orders GROUP BY 1",
    "tree_attributions": _MASTER + ", l AS (SELECT user_id, week, " + ", ".join(f"{x} AS {f}" for f, x in _LEAVES.items()) + " FROM m), b AS (SELECT " + ", ".join(f"avg({f}) AS {f}" for f in _LEAVES) + " FROM l) SELECT l.user_id, l.week, " + ", ".join(f"round(CAST(l.{f} - b.{f} AS DOUBLE), 6) AS {f}" for f in _LEAVES) + ", 0.0::DOUBLE AS step_count, round(CAST(" + " + ".join(f"b.{f}" for f in _LEAVES) + " AS DOUBLE), 6) AS expected FROM l, b",
    "hypnograms": "WITH " + STAGES + """, w AS (SELECT *, min(start_ms) OVER (PARTITION BY user_id, day) AS t0, max(end_ms) OVER (PARTITION BY user_id, day) AS t1, CASE WHEN stage IN ('awake', 'out_of_bed') THEN 0 WHEN stage = 'rem' THEN 1 WHEN stage = 'deep' THEN 3 ELSE 2 END AS r FROM st)
SELECT event_id, ['awake', 'rem', 'light', 'deep'][r + 1] AS row, round((start_ms - t0) / CAST(greatest(1, t1 - t0) AS DOUBLE) * 300, 6) AS x0, round((end_ms - t0) / CAST(greatest(1, t1 - t0) AS DOUBLE) * 300, 6) AS x1, CAST(6 + r * 27 + 13.5 AS DOUBLE) AS y FROM w""",
    "drawn_lines": _E + " SELECT event_id, round(coalesce(CAST(row_number() OVER w - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0), 0.0) * 320, 6) AS x, round(100 - value / 500 * 100, 6) AS y FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)",
    "days_in_words": "WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS s FROM events GROUP BY 1, 2) SELECT user_id, day, CASE WHEN s > 60 THEN 'Stressed' WHEN s > 40 THEN 'Okay' ELSE 'Good' END AS mood, CAST(floor(round(s * 0.8, 9) + 0.5) AS BIGINT) AS anxiety, CAST(60 + floor(round(s * 0.2, 9) + 0.5) AS BIGINT) AS heart_rate FROM g",
    "weekday_values": "WITH e AS (SELECT * FROM events WHERE user_id NOT IN (2, 3, 14)), i AS (SELECT user_id, isodow(ts) - 1 AS weekday, value FROM e WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-13'), s AS (SELECT DISTINCT user_id, w AS weekday FROM e, range(0, 7) r(w)), m AS (SELECT user_id, weekday, avg(value) AS m, count(*) AS n FROM i GROUP BY 1, 2) SELECT s.user_id, CAST(s.weekday AS INTEGER) AS weekday, CAST(coalesce(floor(round(m, 9) + 0.5), 0) AS BIGINT) AS value, coalesce(n, 0) AS n FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.weekday = s.weekday",
    "recommendations_in_full": _RECOMMEND,
}
