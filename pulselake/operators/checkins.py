"""Check-ins: totals and trends of feelings, texts of insight, parsed assistant replies, maturity of the practice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.functions.scalar import clamp, half_up, sentiment_label
from pulselake.functions.text import EMOTIONS, strings

# Words of the plain fallback scorer, and the words that raise an emotion by 0.4 each.
PLAIN_POSITIVE = ("good", "great", "happy", "calm", "relaxed", "grateful", "better", "amazing", "wonderful", "love", "excited", "proud")
PLAIN_NEGATIVE = ("bad", "stressed", "anxious", "worried", "sad", "depressed", "tired", "overwhelmed", "scared", "frustrated", "lonely", "hopeless", "exhausted", "angry")
PLAIN_EMOTIONS = {
    "joy": ("happy", "great", "amazing", "excited"), "sadness": ("sad", "depressed", "lonely", "hopeless"), "anxiety": ("anxious", "worried", "stressed", "overwhelmed"), "anger": ("angry", "frustrated"),
    "calm": ("calm", "relaxed", "peaceful"), "fear": ("scared", "afraid"), "gratitude": ("grateful", "thankful"), "fatigue": ("tired", "exhausted"),
}
# Themes a reply may name, and its sentiments.
THEMES = ("work", "relationships", "health", "sleep", "finances", "family", "social", "academic", "self_image", "existential", "general")
SENTIMENTS = ("positive", "neutral", "concerned", "distressed")
ALIGNMENT = ("both your words and body signals", "your body metrics look steady", "your body may be carrying")
LEVELS = ("capture", "understanding", "vocabulary", "cross_reference", "responsiveness", "latency", "stability")


# ---------------------------------------------------------------- feelings of many check-ins


def emotion_totals(checkins: DataFrame, by: list[str], scores: str = "emotions") -> DataFrame:
    """(by, emotion, total): scores (a map) summed over check-ins."""
    return checkins.select(*by, F.explode(scores).alias("emotion", "_x")).groupBy(*by, "emotion").agg(F.sum("_x").alias("total"))


def dominant_emotion(totals: DataFrame, by: list[str]) -> DataFrame:
    """(by, dominant): the emotion of the greatest total; of equals the one that stands first in the fixed order."""
    order = F.array_position(strings(EMOTIONS), F.col("emotion"))
    return totals.groupBy(*by).agg(F.max(F.struct("total", (-order).alias("_o"), "emotion")).alias("_m")).select(*by, F.col("_m.emotion").alias("dominant"))


def emotion_breadth(checkins: DataFrame, by: list[str], scores: str = "emotions", above: float = 0.3) -> DataFrame:
    """(by, n_emotions): how many emotions scored above the bound in some check-in."""
    one = lambda e: F.max((F.element_at(scores, F.lit(e)) > above).cast("int"))
    return checkins.groupBy(*by).agg(sum((F.coalesce(one(e), F.lit(0)) for e in EMOTIONS), F.lit(0)).alias("n_emotions"))


def rated(rate: Column, cuts: tuple[float, ...], none: Column, some: Column | None = None) -> Column:
    """A level from 4 down by the first of three cuts that rate reaches (the last may be exclusive by `some`), else 1; 0 where none."""
    last = some if some is not None else rate >= cuts[2]
    return F.when(none, 0).when(rate >= cuts[0], 4).when(rate >= cuts[1], 3).when(last, 2).otherwise(1)


def maturity(checkins: DataFrame, by: list[str], as_of_ms: Column, llm_configured: bool = False, asr_configured: bool = False, first_asr: str = "nemotron") -> DataFrame:
    """(by, n, seven levels from 0 to 4, score, tier). checkins: ts_ms, emotions (map), insights (array), follow_up,
    input_mode, asr, llm, latency_ms. Rates are over the check-ins that state the matter; the span of days goes back to
    the oldest check-in. One aggregation."""
    c = F.col
    voice = (c("input_mode") == "voice") & c("asr").isNotNull()
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), b)
    aligned = F.exists("insights", lambda s: F.exists(strings(ALIGNMENT), lambda p: F.contains(F.lower(s), p)))
    seen = sum((F.coalesce(F.max((F.element_at("emotions", F.lit(e)) > 0.3).cast("int")), F.lit(0)) for e in EMOTIONS), F.lit(0))
    g = checkins.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(voice).alias("_voice"), share(voice & (c("asr") == first_asr), F.count_if(voice)).alias("_first"), F.count("llm").alias("_told"), share(c("llm") != "local", F.count("llm")).alias("_llm"),
        (seen / float(len(EMOTIONS))).alias("_breadth"), F.count_if(F.coalesce(aligned, F.lit(False))).alias("_aligned"), share(F.coalesce(c("follow_up"), F.lit("")) != "", F.count(F.lit(1))).alias("_follow"),
        F.avg("latency_ms").alias("_late"), F.ceil((F.first(as_of_ms) - F.min("ts_ms")) / 86_400_000.0).alias("_days"))
    n, days, late = c("n"), c("_days"), c("_late")
    levels = {
        "capture": F.when(c("_voice") == 0, int(asr_configured)).otherwise(rated(c("_first"), (0.75, 0.4, 0.0), F.lit(False), c("_voice") >= 3)),
        "understanding": F.when(c("_told") == 0, int(llm_configured)).otherwise(rated(c("_llm"), (0.9, 0.6, 0.0), F.lit(False), c("_llm") > 0)),
        "vocabulary": rated(c("_breadth"), (0.75, 0.5, 0.25), F.lit(False)),
        "cross_reference": F.when(c("_aligned") > 0, 1).otherwise(0),
        "responsiveness": rated(c("_follow"), (0.6, 0.3, 0.0), F.lit(False), c("_follow") > 0),
        "latency": F.when(late.isNull(), 0).when(late <= 2500, 4).when(late <= 4500, 3).when(late <= 7000, 2).otherwise(1),
        "stability": F.when((n >= 14) & (days >= 14), 4).when((n >= 7) & (days >= 7), 3).when(n >= 3, 2).otherwise(1),
    }
    g = g.withColumns(levels)
    mean = sum((c(x) for x in LEVELS), F.lit(0)) / 7.0
    return g.select(*by, "n", *LEVELS, half_up(F.round(mean / 4 * 100, 9)).cast("long").alias("score"), F.least(F.lit(4), F.floor(mean)).cast("int").alias("tier"))


def condition_rates(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """(by, a share of rows for each named condition); a null condition counts as no."""
    return df.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(name) for name, c in conditions.items()])


# ---------------------------------------------------------------- one text


def plain_sentiment(words: Column) -> Column:
    """(positive - negative words) over their number; 0 without any. Every occurrence counts."""
    n = lambda ws: F.size(F.filter(words, lambda w: F.array_contains(strings(ws), w)))
    pos, neg = n(PLAIN_POSITIVE), n(PLAIN_NEGATIVE)
    return (pos - neg) / F.greatest(pos + neg, F.lit(1)).cast("double")


def plain_emotions(words: Column) -> Column:
    """map<string, double>: 0.4 for each occurrence of an emotion's words, 1 at most."""
    one = lambda ws: F.least(F.lit(1.0), F.size(F.filter(words, lambda w: F.array_contains(strings(ws), w))) * 0.4)
    return F.create_map(*[x for e, ws in PLAIN_EMOTIONS.items() for x in (F.lit(e), one(ws))])


REPLY = T.StructType([
    T.StructField("sentiment", T.StringType()), T.StructField("sentimentScore", T.StringType()), T.StructField("themes", T.ArrayType(T.StringType())),
    T.StructField("emotions", T.MapType(T.StringType(), T.StringType())), T.StructField("emotionalIntensity", T.StringType()), T.StructField("suggestedFollowUp", T.StringType()),
])


def parsed_reply(reply: Column) -> Column:
    """struct(empathy, sentiment, sentiment_score, themes, intensity, emotions, follow_up) of an assistant's reply: text
    and then a fenced JSON block. What is missing, unknown or broken gets a default; numbers are clamped."""
    block = F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1)
    has = F.regexp_like(reply, F.lit(r"(?s)```json\s*.*?\s*```"))
    j = F.from_json(block, REPLY)
    number = lambda c, default: F.coalesce(F.when(c.try_cast("double") != 0, c.try_cast("double")), F.lit(default))
    score = clamp(number(j["sentimentScore"], 0.0), -1, 1)
    themes = F.array_distinct(F.filter(j["themes"], lambda t: F.array_contains(strings(THEMES), t)))
    emotions = F.create_map(*[x for e in EMOTIONS for x in (F.lit(e), clamp(number(F.try_element_at(j["emotions"], F.lit(e)), 0.0), 0, 1))])
    return F.struct(
        F.trim(F.when(has, F.substring_index(reply, "```json", 1)).otherwise(reply)).alias("empathy"),
        F.when(F.array_contains(strings(SENTIMENTS), j["sentiment"]), j["sentiment"]).otherwise(sentiment_label(score)).alias("sentiment"), score.alias("sentiment_score"),
        F.when(F.size(themes) > 0, themes).otherwise(strings(["general"])).alias("themes"), clamp(number(j["emotionalIntensity"], 0.5), 0, 1).alias("intensity"),
        emotions.alias("emotions"), F.nullif(j["suggestedFollowUp"], F.lit("")).alias("follow_up"))


def known_themes(themes: Column) -> Column:
    return F.array_intersect(themes, strings(THEMES))


def insight_codes(score: Column, emotions: Column, stress: Column, hrv: Column) -> Column:
    """array<string>, three at most: how words and body agree, the strongest emotion above 0.3, low variability."""
    tense, strained = score < -0.3, stress > 60
    agree = F.when(tense & strained, "words_and_body_stressed").when(tense, "words_stressed_body_steady").when(strained, "words_fine_body_stressed")
    order = strings(EMOTIONS)
    ranked = F.array_sort(F.transform(F.map_entries(F.map_filter(emotions, lambda _, v: v > 0.3)), lambda e: F.struct((-e["value"]).alias("v"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("e"))))
    top = F.get(ranked, F.lit(0))["e"]
    return F.slice(F.array_compact(F.array(agree, F.when(top.isNotNull(), F.concat(F.lit("feels_"), top)), F.when((hrv > 0) & (hrv < 25), "hrv_low"))), 1, 3)


def risk_codes(stress: Column, anxiety: Column, hrv: Column, sleep_hours: Column, sleep_quality: Column, score: Column, themes: Column) -> Column:
    """array<string>, four at most: agreement of words and body, sleep, themes, and factors that add up."""
    tense, strained = score < -0.3, stress > 60
    agree = F.when(tense & strained, "words_and_body_stressed").when(tense, "words_stressed_body_steady").when(strained, "words_fine_body_stressed")
    short = sleep_hours < 6
    slept = F.when(sleep_quality < 50, "poor_sleep").when(short, F.format_string("slept_%.1f", sleep_hours))
    named = F.filter(themes, lambda t: t != "general")
    low = (hrv > 0) & (hrv < 25)
    risks = F.array_compact(F.array(F.when(low, "low_hrv"), F.when(stress > 70, "high_stress"), F.when(anxiety > 50, "anxiety"), F.when(short, "short_sleep")))
    adds = F.when(F.size(risks) >= 2, F.concat(F.lit("compound:"), F.array_join(risks, "+"))).when(low, "hrv_low")
    return F.slice(F.array_compact(F.array(agree, slept, F.when(F.size(named) > 0, F.concat(F.lit("themes:"), F.array_join(named, "+"))), adds)), 1, 4)


def cleaned_tip(raw: Column, fallback: str = "Take one slow breath before you begin.") -> Column:
    """The first line without list marks; the fallback if under 8 characters are left."""
    tip = F.trim(F.regexp_replace(F.get(F.split(raw, "\n"), F.lit(0)), r"^[|\-*\d.\s]+", ""))
    return F.when(F.length(tip) >= 8, tip).otherwise(fallback)


def context_lines(hr: Column, hrv: Column, stress: Column, anxiety: Column, sleep_quality: Column, sleep_hours: Column, mood: Column) -> Column:
    """Readings as lines of text; those that are null are left out."""
    line = lambda text, c: F.when(c.isNotNull(), F.concat(F.lit(text), c))
    return F.concat_ws("\n", line("heart rate: ", hr.cast("string")), line("variability: ", hrv.cast("string")), line("stress: ", stress.cast("string")), line("anxiety: ", anxiety.cast("string")),
                       line("sleep quality: ", sleep_quality.cast("string")), line("hours slept: ", F.when(sleep_hours.isNotNull(), F.format_string("%.1f", sleep_hours))), line("mood: ", F.nullif(mood, F.lit(""))))


def alert_text(kind: Column, z: Column) -> Column:
    """Title and size of an anomaly as one line."""
    title = F.when(kind == "hrv_low", "Low variability").when(kind == "hr_elevated", "Elevated heart rate").when(kind == "temp_drop", "Unusual temperature").otherwise("Wellness alert")
    return F.concat(title, F.when(z.isNotNull(), F.format_string(" (%.1f deviations)", F.abs(z))).otherwise(""))
