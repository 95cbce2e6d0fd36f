"""Signals of a window: filters, peaks, beat intervals, shapes of pulses, movement and voice.

A window (a user's minutes) is one row with its samples in an array, or one small group; Spark spreads the windows. The numeric
helpers work on one window's array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- one window's array


def butterworth(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital band-pass filter; low and high as shares of half the sampling rate."""
    warped = 4.0 * np.tan(np.pi * np.array([low, high]) / 2.0)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2 + 0j)
    poles = np.concatenate([poles + root, poles - root])
    digital = (4.0 + poles) / (4.0 - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    mid = np.exp(1j * 2 * np.arctan(centre / 4.0))  # the gain there is 1
    return b * np.abs(np.polyval(a, mid) / np.polyval(b, mid)), a


def impulse(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's answer to a single 1, until it has died away."""
    n = int(np.ceil(np.log(1e-12) / np.log(np.abs(np.roots(a)).max())))
    h, back = [], a[1:][::-1].tolist()
    for i in range(n):
        y = float(b[i]) if i < len(b) else 0.0
        past = h[-len(back) :]
        h.append(y - sum(c * v for c, v in zip(back[len(back) - len(past) :], past, strict=True)))
    return np.array(h)


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A band-pass filter forwards and backwards, with oddly mirrored ends. It starts as if its first value had lasted for
    ever, to which a band-pass answers with 0; so that value is taken off, and the rest is a convolution."""
    pad = min(3 * len(a), len(x) - 1)
    if pad < 1:
        return np.zeros(len(x))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    h = impulse(b, a)
    n = 1 << (len(wide) + len(h)).bit_length()
    gain = np.fft.rfft(h, n)
    once = lambda v: np.fft.irfft(np.fft.rfft(v - v[0], n) * gain, n)[: len(v)]
    return once(once(wide)[::-1])[::-1][pad : pad + len(x)]


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 3) -> np.ndarray:
    return zero_phase(*butterworth(order, low / (fs / 2), min(high / (fs / 2), 0.99)), np.asarray(x, float))


def peaks(x: np.ndarray, distance: int, height: float) -> np.ndarray:
    """Places of local maxima (the middle of flat ones) of at least height; of two nearer than distance the higher stays."""
    step = np.flatnonzero(np.diff(x) != 0)
    if len(step) < 2:
        return np.zeros(0, np.int64)
    rising = x[step + 1] > x[step]
    top = np.flatnonzero(rising[:-1] & ~rising[1:])
    at = (step[top] + 1 + step[top + 1]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]


def gaps_filled(x: np.ndarray) -> np.ndarray:
    """NaN by linear interpolation, at the ends by the nearest value; a series of nothing but NaN stays."""
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if ok.any() else x


def plausible(rr: np.ndarray, own_median: str = "all") -> np.ndarray:
    """Intervals from 300 to 2,000 ms, and within 30 % of the median if there are more than five."""
    ok = (rr >= 300) & (rr <= 2000)
    base = rr if own_median == "all" else rr[ok]
    if len(base) > 5:
        m = np.median(base)
        ok &= np.abs(rr - m) / m < 0.30
    return rr[ok]


def pulse_rr(x: np.ndarray, fs: float = 64.0) -> np.ndarray:
    """Beat intervals (ms) of a blood-volume pulse: 0.5 to 8 Hz, peaks 0.3 s apart above the 60th percentile."""
    if len(x) < fs:
        return np.zeros(0)
    y = bandpass(x, fs, 0.5, 8.0)
    at = peaks(y, int(0.3 * fs), np.percentile(y, 60))
    return plausible(np.diff(at) / fs * 1000) if len(at) > 1 else np.zeros(0)


def _cubic(x: np.ndarray, factor: int) -> np.ndarray:
    """Natural cubic interpolation on an even grid, factor times as dense."""
    n = len(x)
    if n < 3:
        return x
    d = np.zeros(n)
    c, r = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):  # Thomas' algorithm for m[i-1] + 4 m[i] + m[i+1] = 6 x''
        w = 4.0 - c[i - 1]
        c[i], r[i] = 1.0 / w, (6 * (x[i + 1] - 2 * x[i] + x[i - 1]) - r[i - 1]) / w
    for i in range(n - 2, 0, -1):
        d[i] = r[i] - c[i] * d[i + 1]
    at = np.arange((n - 1) * factor + 1) / factor
    k = np.minimum(at.astype(int), n - 2)
    u = at - k
    v = 1 - u
    return v * x[k] + u * x[k + 1] + ((v**3 - v) * d[k] + (u**3 - u) * d[k + 1]) / 6


def fine_pulse_rr(x: np.ndarray, fs: float = 64.0) -> np.ndarray:
    """Beat intervals from a narrower band (0.5 to 4 Hz), twice as dense, with the 55th percentile."""
    if len(x) < fs:
        return np.zeros(0)
    y = _cubic(bandpass(x, fs, 0.5, 4.0), 2)
    at = peaks(y, int(0.3 * fs * 2), np.percentile(y, 55))
    return plausible(np.diff(at) / (fs * 2) * 1000) if len(at) > 1 else np.zeros(0)


def ecg_rr(x: np.ndarray, fs: float, percentile: float = 75.0) -> np.ndarray:
    """Beat intervals of an electrocardiogram: gaps filled, every other sample from 500 Hz on, 5 to 20 Hz, squared."""
    if fs >= 500:
        x, fs = x[::2], fs / 2
    x = gaps_filled(x)
    if fs < 50 or len(x) < fs or not np.isfinite(x).all():
        return np.zeros(0)
    y = bandpass(x, fs, 5.0, 20.0) ** 2
    at = peaks(y, int(0.33 * fs), np.percentile(y, percentile))
    return plausible(np.diff(at) / fs * 1000, "plausible") if len(at) > 2 else np.zeros(0)


def step_count(g: np.ndarray, fs: float = 32.0) -> int:
    """Peaks of magnitude, 0.3 g above its mean and 0.3 s apart."""
    return len(peaks(g - g.mean(), int(0.3 * fs), 0.3)) if len(g) > 1 else 0


MORPHOLOGY = ("amplitude_mean", "amplitude_std", "rise_mean", "width_mean", "area_mean", "slope_max", "skew", "kurtosis")


def pulse_shape(x: np.ndarray, fs: float = 64.0) -> dict[str, float]:
    """Eight figures of the pulses' shape: heights above the troughs before, time from trough to peak, width at half height,
    area, steepest rise, and the skewness and kurtosis of the filtered signal. Zeros for under three pulses."""
    zero = dict.fromkeys(MORPHOLOGY, 0.0)
    if len(x) < fs:
        return zero
    y = bandpass(x, fs, 0.5, 8.0)
    at = peaks(y, int(0.3 * fs), np.percentile(y, 60))
    if len(at) < 3 or y.std() == 0:
        return zero
    rows = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        low = a + int(y[a:b].argmin())
        height = y[b] - y[low]
        above = y[low : b + 1] >= y[low] + height / 2
        rows.append((height, (b - low) / fs, above.sum() / fs, (y[low : b + 1] - y[low]).sum() / fs))
    r, z = np.array(rows), (y - y.mean()) / y.std()
    return dict(zip(MORPHOLOGY, map(float, (r[:, 0].mean(), r[:, 0].std(), r[:, 1].mean(), r[:, 2].mean(), r[:, 3].mean(), np.diff(y).max() * fs, (z**3).mean(), (z**4).mean() - 3)), strict=True))


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """n samples over the same time, by the Fourier series of x."""
    if not len(x) or n < 1:
        return np.zeros(max(n, 0))
    f = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(f), len(out))
    out[:k] = f[:k]
    return np.fft.irfft(out, n) * n / len(x)


VOICE = ("energy_mean", "energy_std", "loud_share", "pauses", "pause_mean", "pause_share", "rate", "pitch_mean", "pitch_std")


def voice_figures(x: np.ndarray, rate: int = 16_000, least_pause: float = 0.15) -> dict[str, float]:
    """Energy of 25 ms frames every 10 ms, silent runs of at least least_pause seconds, energy peaks a second, and the pitch (75 to 400 Hz)
    of loud frames by autocorrelation."""
    zero = dict.fromkeys(VOICE, 0.0)
    size, hop = int(0.025 * rate), int(0.010 * rate)
    if len(x) < size:
        return zero
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[::hop]
    rms = np.sqrt((frames**2).mean(axis=1))
    if rms.max() == 0:
        return zero
    loud = rms > 0.1 * rms.max()
    edge = np.flatnonzero(np.diff(np.concatenate([[True], loud, [True]]).astype(int)))
    runs = (edge[1::2] - edge[::2]) * hop / rate if len(edge) else np.zeros(0)
    pauses = runs[runs >= least_pause]
    lags = np.arange(int(rate / 400), int(rate / 75) + 1)
    pitch = []
    wide = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), 2 * int(rate / 75) + 1)[:: 4 * hop] if len(x) > 2 * rate / 75 else np.zeros((0, 1))
    for w in wide:
        w = w - w.mean()
        energy = (w * w).sum()
        if energy <= 0 or np.sqrt(energy / len(w)) <= 0.1 * rms.max():
            continue
        r = np.array([(w[:-lag] * w[lag:]).sum() for lag in lags]) / energy
        if r.max() > 0.3:
            pitch.append(rate / lags[r.argmax()])
    seconds = len(x) / rate
    p = np.array(pitch) if pitch else np.zeros(1)
    return dict(zip(VOICE, map(float, (rms.mean(), rms.std(), loud.mean(), len(pauses), pauses.mean() if len(pauses) else 0.0, pauses.sum() / seconds, len(peaks(rms, 10, 0.3 * rms.max())) / seconds, p.mean(), p.std())), strict=True))


# ---------------------------------------------------------------- tables of windows


def _rowwise(df: DataFrame, keep: list[str], col: str, fields: dict[str, str], one) -> DataFrame:
    """keep and what one(array) gives for each row, in batches inside tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [one(np.asarray(x, float)) if x is not None else {} for x in pdf[col]]  # null samples are NaN
            out = pdf[keep].reset_index(drop=True)
            for f in fields:
                out[f] = [g.get(f) for g in got]
            yield out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + [f"{k} {t}" for k, t in fields.items()])
    return df.select(*keep, col).mapInPandas(run, schema)


def beats(df: DataFrame, keep: list[str], col: str, kind: str, fs: float, percentile: float = 75.0) -> DataFrame:
    """(keep, rr array<double>) of windows of a signal: kind is pulse, fine_pulse or ecg."""
    of = {"pulse": lambda x: pulse_rr(gaps_filled(x), fs), "fine_pulse": lambda x: fine_pulse_rr(gaps_filled(x), fs), "ecg": lambda x: ecg_rr(x, fs, percentile)}[kind]
    return _rowwise(df, keep, col, {"rr": "array<double>"}, lambda x: {"rr": of(x).tolist()})


def shapes(df: DataFrame, keep: list[str], col: str, fs: float = 64.0) -> DataFrame:
    return _rowwise(df, keep, col, dict.fromkeys(MORPHOLOGY, "double"), lambda x: pulse_shape(gaps_filled(x), fs))


def steps(df: DataFrame, keep: list[str], col: str, fs: float = 32.0) -> DataFrame:
    return _rowwise(df, keep, col, {"step_count": "long"}, lambda x: {"step_count": step_count(x, fs)})


def voices(df: DataFrame, keep: list[str], col: str = "x", rate: int = 16_000) -> DataFrame:
    return _rowwise(df, keep, col, dict.fromkeys(VOICE, "double"), lambda x: voice_figures(x, rate))


def at_rate(df: DataFrame, keep: list[str], col: str, from_hz: float, to_hz: float) -> DataFrame:
    """(keep, col): windows at another rate."""
    return _rowwise(df, keep, col, {col: "array<double>"}, lambda x: {col: resampled(gaps_filled(x), int(round(len(x) * to_hz / from_hz))).tolist()})


def interpolated(df: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Adds out: value, or where it is null the point on the line between its neighbours by at; at the ends the nearest."""
    w = Window.partitionBy(*by).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(at))
    v0, t0 = F.last(v, True).over(back), F.last(t, True).over(back)
    v1, t1 = F.first(v, True).over(ahead), F.first(t, True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide((F.col(at) - t0).cast("double"), (t1 - t0).cast("double"))
    return df.withColumn(out, F.coalesce(v, line, v0, v1))


def silences(frames: DataFrame, by: list[str], at: str, silent: str, frame_seconds: float, least: float = 0.15) -> DataFrame:
    """(by, start, frames, seconds): runs of silent frames of at least so many seconds. at numbers frames."""
    w = Window.partitionBy(*by).orderBy(at)
    s = frames.where(F.col(silent)).withColumn("_g", F.col(at) - F.row_number().over(w))
    g = s.groupBy(*by, "_g").agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("frames")).withColumn("seconds", F.col("frames") * frame_seconds)
    return g.where(F.col("seconds") >= least).drop("_g")


def multi_rate(df: DataFrame, base: str, base_hz: int, others: dict[str, int], window_seconds: int, keep: list[str]) -> DataFrame:
    """(keep, win, base, others): whole windows of all channels at their own rates; window k begins at the same time in each.
    A window that runs over the end of any channel is left out. Arrays of a recording are sliced in place."""
    whole = [F.floor(F.size(base) / (window_seconds * base_hz))] + [F.floor((F.size(c)) / (window_seconds * hz)) for c, hz in others.items()]
    n = F.least(*whole).cast("int")
    d = df.where(n > 0).withColumn("win", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = lambda c, hz: F.slice(c, F.col("win") * (window_seconds * hz) + 1, window_seconds * hz).alias(c)
    return d.select(*keep, "win", cut(base, base_hz), *[cut(c, hz) for c, hz in others.items()])


def labels_at_rate(labels: DataFrame, by: list[str], i: str, label: str, from_hz: int, to_hz: int) -> DataFrame:
    """(by, i, label): the commonest label of each sample's stretch, the least of equals."""
    n = labels.withColumn("_i", F.floor(F.col(i) * to_hz / from_hz).cast("long")).groupBy(*by, "_i", label).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by, "_i").agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias(label)).withColumnRenamed("_i", i)
