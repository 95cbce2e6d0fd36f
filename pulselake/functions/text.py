"""Text functions: tokens, lexicon sentiment, emotions, removal of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word valences, amplifiers, negators and emotion words, as the scoring rules define them.
VALENCE = {
    "good": 1.9, "great": 3.1, "amazing": 3.5, "wonderful": 3.2, "happy": 2.7, "calm": 2.0, "relaxed": 2.1, "peaceful": 2.5,
    "grateful": 2.8, "thankful": 2.5, "energetic": 2.0, "motivated": 2.3, "confident": 2.5, "hopeful": 2.3, "better": 1.5,
    "fine": 0.8, "okay": 0.5, "love": 3.0, "excited": 2.8, "proud": 2.3, "joyful": 3.0, "content": 2.0, "refreshed": 2.0,
    "rested": 1.5, "strong": 1.8, "bad": -2.5, "terrible": -3.4, "awful": -3.3, "stressed": -2.5, "anxious": -2.7,
    "worried": -2.3, "sad": -2.5, "depressed": -3.0, "tired": -1.8, "exhausted": -2.5, "angry": -2.8, "frustrated": -2.4,
    "overwhelmed": -2.7, "scared": -2.8, "afraid": -2.6, "nervous": -2.1, "upset": -2.2, "miserable": -3.3, "lonely": -2.8,
    "hopeless": -3.4, "worthless": -3.5, "numb": -2.0, "irritable": -2.2, "restless": -1.8, "panicking": -3.2, "panic": -3.0,
    "crying": -2.5, "cry": -2.0, "hurt": -2.4, "pain": -2.3, "struggling": -2.3, "suffering": -3.0, "insomnia": -2.2,
    "nightmare": -2.5,
}
AMPLIFIERS = {"very": 1.3, "really": 1.3, "so": 1.2, "extremely": 1.5, "quite": 1.1, "absolutely": 1.4, "incredibly": 1.4, "super": 1.3, "totally": 1.2}
NEGATORS = ("not", "never", "no", "don't", "can't", "couldn't", "won't", "wouldn't", "shouldn't", "isn't", "aren't", "wasn't", "weren't", "neither", "nor", "hardly", "barely")
EMOTIONS = {
    "joy": ("happy", "great", "amazing", "wonderful", "joyful", "excited", "love", "grateful", "thankful", "proud"),
    "sadness": ("sad", "depressed", "lonely", "hopeless", "crying", "miserable", "hurt", "worthless", "numb", "lost"),
    "anxiety": ("anxious", "worried", "nervous", "scared", "panicking", "panic", "afraid", "restless", "overwhelmed", "stressed"),
    "anger": ("angry", "frustrated", "irritable", "furious", "upset", "annoyed", "mad", "rage"),
    "calm": ("calm", "relaxed", "peaceful", "content", "serene", "tranquil", "rested", "refreshed"),
    "fear": ("afraid", "scared", "terrified", "frightened", "panicking", "panic", "fearful"),
    "gratitude": ("grateful", "thankful", "blessed", "appreciate", "appreciated"),
    "fatigue": ("tired", "exhausted", "sleepy", "drained", "fatigued", "weary", "worn"),
}
# The patterns for personal data, in the order in which they apply.
PERSONAL = (
    (r"[\w.-]+@[\w.-]+\.\w+", "[email]"),
    (r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[phone]"),
    (r"\d{3}-\d{2}-\d{4}", "[ssn]"),
    (r"https?://\S+", "[url]"),
    (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", "[card]"),
)


def tokens(text: Column) -> Column:
    """Lower-cased words of a-z, apostrophes and hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z'\s-]", " "), r"\s+"), lambda w: w != "")


def strings(words) -> Column:
    return F.array(*map(F.lit, words))


def _value(word: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), word)


def sentiment(words: Column) -> Column:
    """Score from -1 to 1 of an array of words: valences, turned by a negator and scaled by an amplifier just before."""
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.array_contains(strings(VALENCE), F.get(words, i)))

    def one(i: Column) -> Column:
        before = F.get(words, i - 1)
        sign = F.when(F.array_contains(strings(NEGATORS), before), -0.75).otherwise(1.0)
        return _value(F.get(words, i), VALENCE) * sign * F.coalesce(_value(before, AMPLIFIERS), F.lit(1.0))

    total = F.aggregate(hits, F.lit(0.0), lambda acc, i: acc + one(i))
    return F.when(F.size(words) == 0, 0.0).otherwise(total / F.sqrt(total * total + 15))


def emotion_scores(words: Column) -> Column:
    """map<string, double>: half the number of an emotion's words that occur, 1 at most; a mild calm if there are none."""
    scores = {e: F.least(F.lit(1.0), F.size(F.array_intersect(words, strings(ws))) / 2.0) for e, ws in EMOTIONS.items()}
    nothing = F.greatest(*scores.values()) == 0
    scores["calm"] = F.when(nothing, 0.3).otherwise(scores["calm"])
    return F.create_map(*[c for e, s in scores.items() for c in (F.lit(e), s)])


def scrub(text: Column) -> Column:
    """text with personal data replaced; a number that looks like a phone's is taken as one first."""
    for pattern, name in PERSONAL:
        text = F.regexp_replace(text, pattern, name)
    return text
