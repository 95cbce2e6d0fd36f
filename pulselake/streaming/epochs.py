"""Night epochs from heart and motion samples by event-time timers, and the same over stored samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulselake.operators.night import EPOCH_SECONDS, HEART_WINDOW_MS, epoch_heart, epoch_motion, previous_delta

STEP_MS = EPOCH_SECONDS * 1000
#: From an epoch's start to when the last heart sample that counts in it is due.
READY_MS = STEP_MS // 2 + HEART_WINDOW_MS
HEART, MOTION, END = "heart", "motion", "end"
FIGURES = ("hr_mean", "hr_std", "hr_min", "hr_max", "hr_range", "hr_sdsd", "hr_delta_prev", "act_count", "act_max", "act_std")


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from low to before high, range after range, and the range that each is of."""
    n = np.maximum(high - low, 0)
    at = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[at] + low[at], at


def _deviation(values: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deviation of each run of n values, one at least, from begins on."""
    mean = np.add.reduceat(values, begins) / n
    return np.sqrt(np.add.reduceat((values - np.repeat(mean, n)) ** 2, begins) / n)


def heart_figures(values: np.ndarray, begins: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Mean, deviation, extremes, range, and deviation of successive differences of each epoch's heart samples, in order: n of them
    from begins on."""
    low, high = np.minimum.reduceat(values, begins), np.maximum.reduceat(values, begins)
    sdsd, many = np.zeros(len(n)), n > 2
    if many.any():
        inner = np.ones(len(values), bool)
        inner[begins] = False
        d = np.diff(values, prepend=0.0)[inner & np.repeat(many, n)]
        k = n[many] - 1
        sdsd[many] = _deviation(d, np.cumsum(k) - k, k)
    return [np.add.reduceat(values, begins) / n, _deviation(values, begins, n), low, high, high - low, sdsd]


def motion_figures(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sum and maximum of successive differences, and deviation, of each epoch's magnitudes; zeros for one sample or none."""
    out = [np.zeros(len(begins)) for _ in range(3)]
    many = np.flatnonzero(ends - begins > 1)
    if len(many):
        n = (ends - begins)[many]
        at, _ = _spread(begins[many], ends[many])
        out[2][many] = _deviation(values[at], np.cumsum(n) - n, n)
        at, _ = _spread(begins[many] + 1, ends[many])
        d, from_ = np.abs(values[at] - values[at - 1]), np.cumsum(n - 1) - (n - 1)
        out[0][many], out[1][many] = np.add.reduceat(d, from_), np.maximum.reduceat(d, from_)
    return out


class NightEpochs(StatefulProcessor):
    """One key's open epochs. Samples wait in list states until the watermark has passed the time at which their last epoch is
    ready; then the epochs due are worked out over sorted samples, so that the order of arrival doesn't matter, and samples that
    no open epoch reaches are dropped. An end marker waits for its time in the same way and then closes all epochs that
    begin before it. A timer stands at the next time at which something is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = {k: handle.getListState(k, "ms long, value double") for k in (HEART, MOTION)}
        self.ends = handle.getListState("ends", "ms long")
        # The next epoch to close, whether one has been closed in this session, and the mean of the one before, if it had any.
        self.at = handle.getValueState("at", "epoch long, begun boolean, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        for kind, state in self.samples.items():
            own = arrived[arrived["kind"] == kind]
            if len(own):
                state.appendList([(int(m), float(v)) for m, v in zip(own["ms"], own["value"], strict=True)])
        ends = arrived.loc[arrived["kind"] == END, "ms"]
        if len(ends):
            self.ends.appendList([(int(m),) for m in ends])
        seen = arrived.loc[arrived["kind"] != END, "ms"]
        if len(seen):
            first = int(seen.min()) // STEP_MS
            epoch, begun, mean = self.at.get() if self.at.exists() else (first, False, None)
            self.at.update((epoch if begun else min(epoch, first), begun, mean))
        self._wake()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {k: np.array(sorted(map(tuple, s.get())), float).reshape(-1, 2) for k, s in self.samples.items()}
        ends = sorted({int(r[0]) for r in self.ends.get()})
        out: list[list[np.ndarray]] = []
        if self.at.exists():
            epoch, begun, mean = self.at.get()
            while ends and ends[0] <= now:  # whole sessions
                before = {k: v[v[:, 0] < ends[0]] for k, v in held.items()}
                out.append(self._closed(before, epoch, -(-ends[0] // STEP_MS), mean)[0])
                held = {k: v[v[:, 0] >= ends[0]] for k, v in held.items()}
                rest = np.concatenate([v[:, 0] for v in held.values()])
                epoch, begun, mean = (int(rest.min()) // STEP_MS if len(rest) else None), False, None
                ends = ends[1:]
                if epoch is None:
                    break
            if epoch is not None:
                due = (now - READY_MS) // STEP_MS + 1  # the first epoch that isn't ready
                due = min(due, -(-ends[0] // STEP_MS)) if ends else due
                if due > epoch:
                    before = {k: v[v[:, 0] < ends[0]] for k, v in held.items()} if ends else held
                    new, mean = self._closed(before, epoch, due, mean)
                    out.append(new)
                    epoch, begun = due, True
                keep = {HEART: epoch * STEP_MS + STEP_MS // 2 - HEART_WINDOW_MS, MOTION: epoch * STEP_MS}
                held = {k: v[v[:, 0] >= keep[k]] for k, v in held.items()}
            ends = [e for e in ends if e > now]
            if epoch is None or not (len(held[HEART]) or len(held[MOTION])) and not ends:
                self.at.clear()
            else:
                self.at.update((epoch, begun, mean))
        for k, state in self.samples.items():
            state.put([(int(m), float(v)) for m, v in held[k]]) if len(held[k]) else state.clear()
        ends = [e for e in ends if e > now]
        self.ends.put([(e,) for e in ends]) if ends else self.ends.clear()
        self._wake()
        for columns in out:
            if columns:
                yield pd.DataFrame({"_key": key[0], **dict(zip(("epoch", "n", *FIGURES), columns, strict=True))})

    @staticmethod
    def _closed(held: dict, first: int, to: int, mean: float | None) -> tuple[list[np.ndarray], float | None]:
        """The epochs from first to before to that have heart samples, as columns; and the mean of the last one, None if it had none."""
        heart, motion = held[HEART], held[MOTION]
        # Long gaps have nothing in them: only epochs that some heart sample reaches are worked out.
        low = np.maximum(-((READY_MS - 1 - heart[:, 0]) // STEP_MS), first).astype(np.int64)
        high = np.minimum((heart[:, 0] + HEART_WINDOW_MS - STEP_MS // 2) // STEP_MS, to - 1).astype(np.int64)
        epoch, at = _spread(low, high + 1)
        if not len(epoch):
            return [], None
        by_epoch = np.argsort(epoch, kind="stable")  # samples stay in order of time
        epoch, values = epoch[by_epoch], heart[at[by_epoch], 1]
        begins = np.flatnonzero(np.diff(epoch, prepend=epoch[0] - 1))
        epochs, n = epoch[begins], np.diff(begins, append=len(epoch))
        figures = heart_figures(values, begins, n)
        delta = np.where(np.diff(epochs, prepend=first - 1) == 1, np.diff(figures[0], prepend=figures[0][0] if mean is None else mean), 0.0)
        moves = np.searchsorted(motion[:, 0], [epochs * STEP_MS, (epochs + 1) * STEP_MS])
        out = [epochs * STEP_MS, n, *figures, delta, *motion_figures(motion[:, 1], *moves)]
        return out, float(figures[0][-1]) if epochs[-1] == to - 1 else None

    def _wake(self) -> None:
        """One timer, at the next time at which an epoch or a session is due."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [int(r[0]) for r in self.ends.get()]
        if self.at.exists():
            due.append(int(self.at.get()[0]) * STEP_MS + READY_MS)
        if due:
            self.handle.registerTimer(min(due))

    def close(self) -> None:
        pass


def _prepared(samples: DataFrame, keys: list[str], ms: str, kind: str, value: str) -> DataFrame:
    known = F.col(ms).isNotNull() & (((F.col(kind).isin(HEART, MOTION)) & F.col(value).isNotNull() & ~F.isnan(value)) | (F.col(kind) == END))
    return samples.where(known).select(*keys, F.col(ms).cast("long").alias("ms"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"))


def night_epochs(stream: DataFrame, keys: list[str], ms: str = "ms", kind: str = "kind", value: str = "value", late: str = "0 seconds") -> DataFrame:
    """(keys, epoch, n, FIGURES) of each key's 30-second epochs from a stream of heart and motion samples (kind) and end markers.

    epoch is its start in ms; heart figures are over the samples within two minutes of its centre, motion figures over those in
    it. An epoch comes out when the watermark, which stays late behind the latest sample, reaches 135 s after its start, and
    holds every sample that came before that, in order of time. Epochs without heart samples don't come out, and the next
    one's delta is 0. An end marker closes all epochs that begin before it once the watermark reaches it; samples from its
    time on begin another session. State holds the samples that open epochs reach, so it grows with keys and lateness alone.
    The session has to use the RocksDB state store. Nulls in time or value are left out; null keys are a
    key. Keys are numbers, strings, booleans or dates.
    """
    rows = _prepared(stream, keys, ms, kind, value).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    of = T.StructType([rows.schema[k] for k in keys])
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FIGURES]])
    # Keys travel as JSON: as columns of pandas, long ones would be rounded next to null ones.
    keyed = rows.select(F.to_json(F.struct(*keys)).alias("_key"), "ms", "kind", "value", "ts")
    out = keyed.groupBy("_key").transformWithStateInPandas(statefulProcessor=NightEpochs(), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return out.select(F.from_json("_key", of).alias("_k"), "epoch", "n", *FIGURES).select("_k.*", "epoch", "n", *FIGURES)


def stored_night_epochs(samples: DataFrame, keys: list[str], ms: str = "ms", kind: str = "kind", value: str = "value") -> DataFrame:
    """What night_epochs gives in the end, from stored samples: the sessions that an end marker closes. Samples after a key's last
    marker are an open session and give nothing."""
    rows = _prepared(samples, keys, ms, kind, value)
    ends = rows.where(F.col("kind") == END).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("ms").alias("_end")).distinct()
    per_key = ends.groupBy(*[f"_k_{k}" for k in keys]).agg(F.sort_array(F.collect_list("_end")).alias("_ends"))  # a marker for each session
    on = [rows[k].eqNullSafe(per_key[f"_k_{k}"]) for k in keys]
    dealt = rows.where(F.col("kind") != END).join(per_key, on).withColumn("_session", F.array_min(F.transform("_ends", lambda e: F.when(e > F.col("ms"), e))))
    by = [*keys, "_session"]  # null: after the last marker; goes with the epochs' end below
    dealt = dealt.select(*by, "ms", "kind", "value")
    start = dealt.groupBy(*by).agg(F.floor(F.min("ms") / STEP_MS).alias("_first"))
    heart = dealt.where(F.col("kind") == HEART)
    figures = epoch_heart(heart, by, F.lit(0), "ms", "value")
    reach = heart.withColumn("epoch", F.explode(F.sequence(F.ceil((F.col("ms") - READY_MS + 1) / STEP_MS).cast("long"), F.floor((F.col("ms") + HEART_WINDOW_MS - STEP_MS // 2) / STEP_MS).cast("long"))))
    counts = reach.groupBy(*by, "epoch").agg(F.count(F.lit(1)).alias("n"))
    moved = epoch_motion(dealt.where(F.col("kind") == MOTION).withColumn("epoch", F.floor(F.col("ms") / STEP_MS)), by, "epoch", "ms", "value")
    joined = _null_safe(_null_safe(figures, counts, [*by, "epoch"], "inner"), moved, [*by, "epoch"], "left").na.fill(0.0, ["act_count", "act_max", "act_std"])
    inside = _null_safe(joined, start, by, "inner").where((F.col("epoch") >= F.col("_first")) & (F.col("epoch") * STEP_MS < F.col("_session")))
    return previous_delta(inside, by, "epoch", "hr_mean").select(*keys, (F.col("epoch") * STEP_MS).alias("epoch"), "n", *FIGURES)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = a[k].eqNullSafe(right[f"_r_{k}"])
        on = same if on is None else on & same
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
