"""Health records: range scans over nested records, generators of samples, and readers of study files.

Every reader takes folders or globs of any number of files; Spark lists and splits them. File names carry the subject, and are
read by expressions on the path, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Numeric sleep stages of the health store.
STAGE_NAMES = {0: "unknown", 1: "awake", 2: "sleeping", 3: "out_of_bed", 4: "awake", 5: "light", 6: "deep", 7: "rem"}


def stage_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_NAMES.items() for x in kv]), code), F.lit("unknown"))


# ---------------------------------------------------------------- range scans over records


def heart_rate(records: DataFrame, user: str, start_ms: int, end_ms: int) -> DataFrame:
    """(user, ts_ms, bpm, source): samples (array of struct<time_ms, bpm>) of the records that begin in [start_ms, end_ms];
    a record without a source is 'unknown', one without samples gives no rows."""
    r = records.where(F.col("start_ms").between(start_ms, end_ms)).select(user, F.coalesce("source", F.lit("unknown")).alias("source"), F.explode("samples").alias("_s"))
    return r.select(user, F.col("_s.time_ms").alias("ts_ms"), F.col("_s.bpm").cast("double").alias("bpm"), "source")


def point_records(records: DataFrame, user: str, value: str, start_ms: int, end_ms: int, default: float | None = None) -> DataFrame:
    """(user, ts_ms, value) of single readings (variability, temperature, oxygen, breathing) in [start_ms, end_ms]; nulls take the default."""
    v = F.col(value).cast("double")
    return records.where(F.col("ts_ms").between(start_ms, end_ms)).select(user, "ts_ms", (v if default is None else F.coalesce(v, F.lit(float(default)))).alias(value))


def step_records(records: DataFrame, user: str, start_ms: int, end_ms: int) -> DataFrame:
    return records.where(F.col("start_ms").between(start_ms, end_ms)).select(user, "start_ms", "end_ms", F.col("count").cast("double").alias("count"))


def sleep_records(records: DataFrame, user: str, start_ms: int, end_ms: int) -> DataFrame:
    """(user, start_ms, end_ms, source, stages): stage numbers become names; null stages an empty array."""
    named = F.transform(F.coalesce("stages", F.array().cast(records.schema["stages"].dataType)), lambda s: F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), stage_name(s["stage"]).alias("stage")))
    return records.where(F.col("start_ms").between(start_ms, end_ms)).select(user, "start_ms", "end_ms", F.coalesce("source", F.lit("unknown")).alias("source"), named.alias("stages"))


def stage_rows(sessions: DataFrame, user: str) -> DataFrame:
    """(user, session_start, start_ms, end_ms, stage): one row for each stage of each session."""
    return sessions.select(user, F.col("start_ms").alias("session_start"), F.explode("stages").alias("_s")).select(user, "session_start", "_s.*")


def latest_value(samples: DataFrame, by: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """(by, value): the last reported value, as passive counters are read."""
    return samples.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


# ---------------------------------------------------------------- generators


def mock_samples(spark: SparkSession, users: int, start_ms: int, end_ms: int, step_ms: int, low: float, high: float, value: str, seed: int = 7) -> DataFrame:
    """(user_id, ts_ms, value): an even series for each user, uniform in [low, high), the same in every run."""
    n = max(0, -(-(end_ms - start_ms) // step_ms))
    i = F.col("id")
    u = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(users * n).select(F.floor(i / max(1, n)).cast("long").alias("user_id"), (F.lit(start_ms) + F.pmod(i, F.lit(max(1, n))) * step_ms).alias("ts_ms"), (low + u * (high - low)).alias(value))


# Ranges of heart rate, variability and temperature on a tense and on a calm day, and seconds between their readings.
TENSE_DAY, CALM_DAY = ((95, 115), (20, 40), (34.5, 36.0)), ((65, 85), (35, 75), (33.0, 35.0))
HR_STEP_MS, HRV_STEP_MS, TEMP_STEP_MS = 5_000, 300_000, 60_000
# Deviations by which a subject and a window vary, and the share of stressed windows.
SUBJECT_SPREAD, WINDOW_SPREAD, STRESSED_SHARE = 0.3, 0.4, 0.35


def mock_day(spark: SparkSession, users: int, start_ms: int, end_ms: int, tense: bool = True, seed: int = 7) -> dict[str, DataFrame]:
    """Heart rate every 5 s, variability every 5 minutes and temperature every minute, for a tense or a calm day."""
    hr, hrv, temp = TENSE_DAY if tense else CALM_DAY
    return {
        "hr": mock_samples(spark, users, start_ms, end_ms, HR_STEP_MS, *hr, "bpm", seed), "hrv": mock_samples(spark, users, start_ms, end_ms, HRV_STEP_MS, *hrv, "rmssd", seed + 1),
        "temp": mock_samples(spark, users, start_ms, end_ms, TEMP_STEP_MS, *temp, "temperature_c", seed + 2),
    }


def labelled_features(spark: SparkSession, subjects: int, windows: int, base: dict[str, tuple[float, float]], shifts: dict[str, float], limits: dict[str, tuple[float, float]], share: float = STRESSED_SHARE, seed: int = 42) -> DataFrame:
    """(subject, window, stress_binary, label, features): each subject has a shift of its own (0.3 deviations), stressed
    windows are shifted further, noise is 0.4 deviations, and values are clamped. Draws come from hashes, so that a value
    doesn't depend on partitioning."""

    def normal(*key) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *key), F.lit(1 << 40)) + 1) / float((1 << 40) + 1) for i in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])

    i = F.col("id")
    w = spark.range(subjects * windows).select(F.floor(i / windows).cast("long").alias("_s"), F.pmod(i, F.lit(windows)).alias("window"), i)
    rank = F.pmod(F.xxhash64(F.lit(seed), F.lit("order"), "_s"), F.lit(windows))
    stressed = (F.pmod(F.col("window") + rank, F.lit(windows)) < int(windows * share)).cast("int")
    w = w.withColumn("stress_binary", stressed)
    cols = {}
    for f, (mean, std) in base.items():
        v = F.lit(mean) + normal(F.lit(f), F.col("_s")) * (SUBJECT_SPREAD * std) + F.col("stress_binary") * float(shifts.get(f, 0.0)) + normal(F.lit(f), i) * (WINDOW_SPREAD * std)
        low, high = limits.get(f, (float("-inf"), float("inf")))
        cols[f] = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))
    return w.withColumns(cols).select(F.format_string("S%d", F.col("_s") + 2).alias("subject"), "window", "stress_binary", (F.col("stress_binary") + 1).alias("label"), *base)


# ---------------------------------------------------------------- study files


def _file(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_rated_csv(spark: SparkSession, path: str, condition: str = "condition") -> DataFrame:
    """CSV feature rows with a numeric condition: stress_binary is whether it is above 0."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn("stress_binary", (F.col(condition).cast("double") > 0).cast("int"))


def read_e4(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(subject, signal, i, t, columns): wrist files whose first row is the start (a unix time or a date and time) and whose second
    is the rate in Hz. The subject is the folder, the signal the file's name. One file is one task, streamed in lines."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, text in zip(pdf["path"], pdf["value"], strict=True):
                lines = [x for x in text.splitlines() if x.strip()]
                if len(lines) < 3:
                    continue
                head, rate = lines[0].split(",")[0].strip(), float(lines[1].split(",")[0])
                try:
                    start = float(head)
                except ValueError:
                    start = pd.Timestamp(head, tz="UTC").timestamp()
                x = np.array([[float(v) for v in line.split(",")[: len(columns)]] for line in lines[2:]])
                parts = p.rstrip("/").split("/")
                out = pd.DataFrame(x, columns=columns)
                out.insert(0, "t", start + np.arange(len(x)) / rate)
                out.insert(0, "i", np.arange(len(x)))
                out.insert(0, "signal", parts[-1].rsplit(".", 1)[0])
                out.insert(0, "subject", parts[-2])
                yield out

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "subject string, signal string, i long, t double, " + ", ".join(f"{c} double" for c in columns))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(subject, t): event marks, a time in each row."""
    t = F.split("value", ",")[0]
    seconds = F.coalesce(t.try_cast("double"), F.unix_micros(F.try_to_timestamp(t)) / 1e6)
    return spark.read.text(path).select(_file(r"([^/]+)/[^/]+$").alias("subject"), seconds.alias("t")).where("t is not null")


def read_timed_text(spark: SparkSession, path: str, names: list[str], sep: str = r"[,\s]+") -> DataFrame:
    """(subject, names): lines of numbers, with or without a header line; the subject is the part of the file's name before the first _ or dot."""
    parts = F.split(F.trim("value"), sep)
    df = spark.read.text(path).select(_file(r"([^/_.]+)[^/]*$").alias("subject"), *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    return df.where(F.col(names[0]).isNotNull())


def seconds(t: Column) -> Column:
    """Times in milliseconds (above 1e12) as seconds."""
    return F.when(t > 1e12, t / 1000.0).otherwise(t)


def snapped_start(first: Column, recorded: Column, step: float = 900.0) -> Column:
    """The recording's start on the clock of the samples: off by a multiple of step."""
    return recorded + F.rint((first - recorded) / step) * step


def read_trials(spark: SparkSession, path: str, labels: dict[str, int], value: str = "ibi") -> DataFrame:
    """(subject, trial, label, i, value): one interval in each line; the trial is named in the file, and names its label. Trials
    without a label are left out."""
    trial = _file(r"([^/_]+)\.[^/.]*$")
    named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    v = F.element_at(F.split("value", ","), -1).try_cast("double")
    df = spark.read.text(path).select(_file(r"([^/]+)/[^/]+$").alias("subject"), trial.alias("trial"), F.try_element_at(named, trial).alias("label"), v.alias(value))
    return df.where(F.col("label").isNotNull() & F.col(value).isNotNull())


def read_renamed(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """CSV features under our names, as numbers; what isn't a number is null. Columns that aren't there are null too."""
    df = spark.read.csv(path, header=True)
    return df.select(*[(F.col(f"`{old}`").try_cast("double") if old in df.columns else F.lit(None).cast("double")).alias(new) for old, new in names.items()])


def read_actigraphy(spark: SparkSession, path: str) -> DataFrame:
    """(subject, date, ts, activity) from a CSV file for each subject with timestamp, date and activity."""
    df = spark.read.csv(path, header=True, schema="timestamp string, date string, activity double")
    return df.select(_file(r"([^/]+)\.csv$").alias("subject"), F.to_date("date").alias("date"), F.to_timestamp("timestamp").alias("ts"), "activity")


def read_subject_signals(spark: SparkSession, path: str) -> DataFrame:
    """(subject, *columns): CSV signals of one schema, one folder for each subject."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumn("subject", _file(r"([^/]+)/[^/]+$"))


def read_stage_labels(spark: SparkSession, path: str) -> DataFrame:
    """(subject, label): the column stage, else label, else the last."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    col = next((c for c in ("stage", "label") if c in df.columns), df.columns[-1])
    return df.select(_file(r"([^/]+)/[^/]+$").alias("subject"), F.col(f"`{col}`").cast("long").alias("label"))


def read_wav(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, rate, x array<float>): 8, 16 or 32 bit PCM files as one channel at rate, by linear interpolation. A file is one row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        for pdf in frames:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    data = w.readframes(w.getnframes())
                x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
                x = x.reshape(-1, channels).mean(axis=1)
                if own != rate and len(x):
                    n = int(round(len(x) * rate / own))
                    x = np.interp(np.arange(n) / rate, np.arange(len(x)) / own, x)
                rows.append((p, rate, x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "rate", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, x array<float>")


def features_or(spark: SparkSession, tried: list, fallback) -> DataFrame:
    """The first of the readers tried whose path exists, else fallback(). tried: (path, reader(spark, path))."""
    for path, reader in tried:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
            return reader(spark, path)
    return fallback()
