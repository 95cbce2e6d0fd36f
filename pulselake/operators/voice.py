"""Voice of a recording: a probabilistic pitch track, onset strength, loudness, pauses and two composite scores.

A recording is one row with its samples in an array; Spark spreads the rows. Frames of a recording are worked out in blocks; what
grows with it is a two-byte pointer for each frame and state of the pitch path, about 27 KB a second of sound. Null or not finite
samples are filled by interpolation; an empty or null recording has the figures of silence of no length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.scalar import clamp
from pulselake.operators.signal import gaps_filled, peaks

FRAME, HOP = 2048, 512
LOWEST_HZ, HIGHEST_HZ = 50.0, 600.0
#: Steps of the pitch path in an octave (20 cents each), and octaves that pitch may move in a second.
STEPS, OCTAVES_A_SECOND = 60, 35.92
SWITCH = 0.01  # chance that a frame begins or ends voice
UNSURE = 0.01  # weight of the deepest trough where no threshold takes one
SILENT_DB = -40.0
BLOCK = 256
BANDS = 40
FIGURES = ("pitch_mean", "pitch_std", "pitch_min", "pitch_max", "pitch_range", "voiced_fraction", "rms_mean", "rms_std", "rms_max", "loudness", "silence_fraction", "dynamic_range",
           "syllable_rate", "pause_mean", "pause_ratio", "speaking_seconds", "seconds")


def framed(x: np.ndarray, lead: int = FRAME // 2, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """A view of the frames that begin lead samples before every hop-th sample; silence lies beyond both ends."""
    padded = np.concatenate([np.zeros(lead), x, np.zeros(frame - lead)])
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop] if len(x) else np.zeros((0, frame))


def _cumulative_beta(x: np.ndarray) -> np.ndarray:
    """Share of a Beta(2, 18) law up to x: how likely a threshold is to lie there."""
    return np.maximum(1 - (1 - x) ** 19 - 19 * x * (1 - x) ** 18, 0.0)  # not below 0 by rounding, next to x = 0


def normalised_difference(frames: np.ndarray, longest: int) -> np.ndarray:
    """For each frame and lag, the squared difference of the frame to itself later, over its mean at all shorter lags."""
    n = frames.shape[1]
    half = n // 2
    squares = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    size = 2 * n
    product = np.fft.irfft(np.conj(np.fft.rfft(frames[:, :half], size)) * np.fft.rfft(frames, size), size)[:, : longest + 1]
    lags = np.arange(longest + 1)
    gap = np.maximum(squares[:, [half]] + squares[:, half + lags] - squares[:, lags] - 2 * product, 0)
    gap[:, 0] = 0
    so_far = np.cumsum(gap, axis=1)
    out = np.ones_like(gap)
    heard = squares[:, [half]] > 1e-9
    np.divide(gap * lags, so_far, out=out, where=heard & (so_far > 0))
    return out


def pitch_chances(x: np.ndarray, rate: int) -> np.ndarray:
    """For each frame and step of pitch, how likely the frame has that pitch (a row's sum: how likely it is voiced).

    A threshold, whose law is known, takes the first trough of the normalised difference below it. So a trough gets the
    share of thresholds between its depth and that of the deepest trough before it; what is left goes, by UNSURE, to the
    deepest of all.
    """
    steps = int(STEPS * np.log2(HIGHEST_HZ / LOWEST_HZ)) + 1
    shortest, longest = int(rate / HIGHEST_HZ), int(np.ceil(rate / LOWEST_HZ))
    frames = framed(x, FRAME // 4)  # the stretch that is compared with later ones has the frame's sample in its middle
    out = np.zeros((len(frames), steps))
    for begin in range(0, len(frames), BLOCK):
        d = normalised_difference(frames[begin : begin + BLOCK], longest + 1)
        inner = d[:, 1:-1]
        trough = (inner < d[:, :-2]) & (inner <= d[:, 2:])
        trough[:, : max(shortest - 1, 0)] = False
        depth = np.where(trough, np.minimum(inner, 1.0), 1.0)
        before = np.minimum.accumulate(np.concatenate([np.ones((len(d), 1)), depth[:, :-1]], axis=1), axis=1)
        share = np.maximum(_cumulative_beta(before) - _cumulative_beta(np.minimum(depth, before)), 0.0)
        deepest = depth.argmin(axis=1)
        rows = np.flatnonzero(trough.any(axis=1))
        share[rows, deepest[rows]] += UNSURE * _cumulative_beta(depth[rows, deepest[rows]])
        row, at = np.nonzero(share)
        a, b, c = d[row, at], d[row, at + 1], d[row, at + 2]
        bend = a - 2 * b + c
        lag = at + 1 + np.where(bend > 0, (a - c) / (2 * np.where(bend > 0, bend, 1)), 0.0)
        step = np.clip(np.rint(STEPS * np.log2(rate / lag / LOWEST_HZ)), 0, steps - 1).astype(int)
        np.add.at(out, (begin + row, step), share[row, at])
    return out


def likeliest_path(chances: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, voiced) of each frame: the likeliest sequence of states, by dynamic programming. A state is a step of pitch, voiced or
    not; from frame to frame pitch moves by at most reach steps, small moves likelier."""
    n, m = chances.shape
    if n == 0:
        return np.zeros(0, int), np.zeros(0, bool)
    near = np.log(reach + 1.0 - np.abs(np.arange(-reach, reach + 1))) - 2 * np.log(reach + 1.0)
    stay, change = np.log(1 - SWITCH), np.log(SWITCH)
    voiced = np.clip(chances.sum(axis=1), 0, 1)
    tiny = 1e-300

    def seen(t: int) -> np.ndarray:
        return np.log(np.stack([chances[t], np.full(m, (1 - voiced[t]) / m)]) + tiny)

    best, came = seen(0) - np.log(2 * m), np.zeros((n, 2, m), np.int16)
    # What each step is reached from, and the sums, stay in place from frame to frame: new ones of this size cost more than the sums.
    padded = np.full((2, m + 2 * reach), -np.inf)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=1)
    sums, places = np.empty((2 * m, 2 * reach + 1)), np.arange(2 * m)
    for t in range(1, n):
        padded[:, reach : reach + m] = best
        np.add(windows, near, out=sums.reshape(2, m, -1))
        move = sums.argmax(axis=1)
        moved = sums[places, move].reshape(2, m)
        source = np.clip(move.reshape(2, m) + np.arange(m) - reach, 0, m - 1)
        other = moved[::-1] + change
        keep = moved + stay
        origin = np.array([other[0] > keep[0], keep[1] > other[1]])  # of two equal ones voiced comes first
        came[t] = np.take_along_axis(source, origin.astype(int), 0) + origin * m
        best = np.maximum(keep, other) + seen(t)
    state = np.zeros(n, int)
    state[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        state[t - 1] = came[t].ravel()[state[t]]
    return state % m, state < m


def pitch(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(hz, chance) of each frame: the pitch on the likeliest path, NaN where it is unvoiced, and how likely the frame alone is voiced."""
    chances = pitch_chances(x, rate)
    step, voiced = likeliest_path(chances, max(1, round(OCTAVES_A_SECOND * STEPS * HOP / rate)))
    return np.where(voiced, LOWEST_HZ * 2.0 ** (step / STEPS), np.nan), chances.sum(axis=1)


def onset_strength(x: np.ndarray, rate: int) -> np.ndarray:
    """For each frame, the mean rise in decibels of the loudness of BANDS bands, spaced as the ear hears; falls count nothing."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weight = np.maximum(0, np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid))) * 2 / (high - low)
    frames, window = framed(x), np.hanning(FRAME + 1)[:-1]
    power = [np.abs(np.fft.rfft(frames[i : i + BLOCK] * window)) ** 2 @ weight.T for i in range(0, len(frames), BLOCK)]
    if not power:
        return np.zeros(0)
    level = 10 * np.log10(np.maximum(np.concatenate(power), 1e-10))
    level = np.maximum(level, level.max() - 80)
    return np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).mean(axis=1)])


def voice(x: np.ndarray, rate: int, least_pause: float = 0.15) -> dict:
    """All figures of one recording, and pauses, their number."""
    x = np.nan_to_num(gaps_filled(x))
    out = dict.fromkeys(FIGURES, 0.0) | {"loudness": -70.0, "pauses": 0}
    if not len(x):
        return out
    seconds = len(x) / rate
    hz, _ = pitch(x, rate)
    said = hz[np.isfinite(hz)]
    out["voiced_fraction"] = len(said) / len(hz)
    if len(said):
        out |= {"pitch_mean": said.mean(), "pitch_std": said.std(), "pitch_min": said.min(), "pitch_max": said.max(), "pitch_range": said.max() - said.min()}
    frames = framed(x)
    rms = np.sqrt(np.concatenate([(frames[i : i + BLOCK] ** 2).mean(axis=1) for i in range(0, len(frames), BLOCK)]))
    db = 20 * np.log10(np.maximum(rms, 1e-10))
    silent = db < SILENT_DB
    loud = db[~silent]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], silent, [False]]).astype(int)))
    runs = edges[1::2] - edges[::2]
    pauses = runs[runs >= max(1, int(least_pause * rate / HOP))] * HOP / rate
    onset = onset_strength(x, rate)
    top = onset.max()
    beats = len(peaks(onset / top, max(1, int(0.08 * rate / HOP)), 0.2)) if top > 0 else 0
    out |= {
        "rms_mean": rms.mean(), "rms_std": rms.std(), "rms_max": rms.max(), "loudness": loud.mean() if len(loud) else -70.0, "silence_fraction": silent.mean(),
        "dynamic_range": max(0.0, np.percentile(db, 95) - np.percentile(db, 5)), "syllable_rate": round(beats / seconds, 3), "pauses": len(pauses), "pause_mean": pauses.mean() if len(pauses) else 0.0,
        "pause_ratio": pauses.sum() / seconds, "speaking_seconds": max(0.0, seconds - pauses.sum()), "seconds": seconds,
    }
    return {k: v if k == "pauses" else float(v) for k, v in out.items()}


# ---------------------------------------------------------------- tables of recordings


def _schema(df: DataFrame, keep: list[str], fields: dict[str, str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + [f"{k} {t}" for k, t in fields.items()])


def voices_in_full(df: DataFrame, keep: list[str], col: str = "x", rate: int = 16_000) -> DataFrame:
    """keep, the figures of each recording, arousal and valence. Narrow; a null recording has the figures of an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [voice(np.asarray([] if x is None else x, float), rate) for x in pdf[col]]
            out = pdf[keep].reset_index(drop=True)
            for f in (*FIGURES, "pauses"):
                out[f] = [g[f] for g in got]
            yield out

    return composites(df.select(*keep, col).mapInPandas(run, _schema(df, keep, dict.fromkeys(FIGURES, "double") | {"pauses": "long"})))


def pitch_track(df: DataFrame, keep: list[str], col: str = "x", rate: int = 16_000) -> DataFrame:
    """(keep, frame, seconds, hz, chance): a row for each frame of each recording, hz null where it is unvoiced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at, x in enumerate(pdf[col]):
                hz, chance = pitch(np.nan_to_num(gaps_filled(np.asarray([] if x is None else x, float))), rate)
                out = pdf[keep].iloc[np.full(len(hz), at)].reset_index(drop=True)
                number = np.arange(len(hz))
                yield out.assign(frame=number, seconds=number * HOP / rate, hz=pd.array([None if np.isnan(h) else h for h in hz], "Float64"), chance=chance)

    return df.select(*keep, col).mapInPandas(run, _schema(df, keep, {"frame": "long", "seconds": "double", "hz": "double", "chance": "double"}))


def arousal(rms_mean: Column, syllable_rate: Column, pause_ratio: Column) -> Column:
    """0 to 1: loud, fast and unbroken speech scores high."""
    loud, fast = F.least(F.lit(1.0), rms_mean / 0.15), F.least(F.lit(1.0), syllable_rate / 6.0)
    return F.round(clamp(0.4 * loud + 0.4 * fast + 0.2 * (1.0 - pause_ratio), 0.0, 1.0), 4)


def valence(pitch_std: Column, voiced_fraction: Column) -> Column:
    """0 to 1: lively pitch scores high; 0.5 where less than a tenth is voiced."""
    return F.round(F.when(voiced_fraction < 0.1, 0.5).otherwise(clamp(pitch_std / 60.0, 0.0, 1.0)), 4)


def composites(figures: DataFrame) -> DataFrame:
    """Adds arousal and valence; a null figure makes its score null."""
    c = F.col
    return figures.withColumns({"arousal": F.when(c("rms_mean").isNotNull() & c("syllable_rate").isNotNull(), arousal(c("rms_mean"), c("syllable_rate"), c("pause_ratio"))),
                                "valence": F.when(c("voiced_fraction").isNotNull(), valence(c("pitch_std"), c("voiced_fraction")))})
