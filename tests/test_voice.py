"""Pitch, onsets and scores of voice against plain twins and made signals."""

import numpy as np
import pytest

from pulselake.operators import voice

RATE = 16_000


def glide(seconds, a, b, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    hz = a + (b - a) * t / seconds
    return 0.4 * np.sin(2 * np.pi * np.cumsum(hz) / rate) + 0.1 * np.sin(4 * np.pi * np.cumsum(hz) / rate), hz


def test_normalised_difference_equals_a_plain_loop():
    frames = np.random.default_rng(1).normal(size=(3, 64))
    got = voice.normalised_difference(frames, 20)
    for x, row in zip(frames, got, strict=True):
        d = [sum((x[j] - x[j + lag]) ** 2 for j in range(32)) for lag in range(21)]
        want = [1.0] + [d[lag] * lag / sum(d[1 : lag + 1]) for lag in range(1, 21)]
        assert row == pytest.approx(want, abs=1e-9)


def test_path_equals_all_sequences():
    rng = np.random.default_rng(3)
    chances = rng.random((5, 3)) / 4
    reach = 1
    near = {k: np.log(reach + 1 - abs(k)) - 2 * np.log(reach + 1) for k in (-1, 0, 1)}
    best = (-np.inf, None)
    seen = lambda t, s: np.log(chances[t, s % 3] if s < 3 else (1 - chances[t].sum()) / 3)
    for code in range(6**5):
        states = [code // 6**t % 6 for t in range(5)]
        total = seen(0, states[0])
        for t in range(1, 5):
            k = states[t] % 3 - states[t - 1] % 3
            if k not in near:
                total = -np.inf
                break
            total += near[k] + np.log(1 - voice.SWITCH if (states[t] < 3) == (states[t - 1] < 3) else voice.SWITCH) + seen(t, states[t])
        best = max(best, (total, states), key=lambda b: b[0])
    step, voiced = voice.likeliest_path(chances, reach)
    assert [int(s) + (0 if v else 3) for s, v in zip(step, voiced, strict=True)] == best[1]


def test_gliding_tone_and_gap():
    x, hz = glide(2.0, 120, 320)
    x[12_000:20_000] = 0
    got, chance = voice.pitch(x, RATE)
    at = np.arange(len(got)) * voice.HOP
    inside = (at > 1500) & (at < 10_500) | (at > 21_500) & (at < 30_500)
    assert np.isfinite(got[inside]).all() and np.abs(got[inside] / hz[at[inside]] - 1).max() < 0.02
    gap = (at > 13_500) & (at < 18_500)
    assert np.isnan(got[gap]).all() and (chance[gap] < 0.1).all()


def test_noise_is_unvoiced():
    got, _ = voice.pitch(np.random.default_rng(5).normal(size=RATE) * 0.2, RATE)
    assert np.isfinite(got).mean() < 0.2


def test_onsets_are_where_sounds_begin():
    x = np.zeros(2 * RATE)
    begins = [4000, 12_000, 20_000, 27_000]
    for b in begins:  # they end softly: a sound cut off is a click in other bands, a rise too
        x[b : b + 3000] = glide(3000 / RATE, 200, 200)[0] * np.minimum(1, np.linspace(1.5, 0, 3000)) ** 2
    onset = voice.onset_strength(x, RATE)
    found = voice.peaks(onset / onset.max(), 2, 0.2) * voice.HOP
    assert len(found) == 4 and all(abs(f - b) <= 2 * voice.HOP for f, b in zip(sorted(found), begins, strict=True))
    assert voice.voice(x, RATE)["syllable_rate"] == 2.0


def test_tables_of_recordings(spark):
    tone = glide(1.0, 200, 200)[0].tolist()
    rows = [(1, "a", tone), (2, "b", []), (3, None, None), (4, "d", [0.0] * 4000), (1, "a", tone), (5, "e", [None, *tone[1:]]), (6, "f", [0.5])]
    df = spark.createDataFrame(rows, "id long, name string, x array<double>")
    got = voice.voices_in_full(df, ["id", "name"]).collect()
    by = {r.id: r for r in got}
    assert len(got) == 7 and by[3].name is None
    assert by[1].pitch_mean == pytest.approx(200, rel=0.01) and by[5].pitch_mean == pytest.approx(200, rel=0.01) and by[1].pitch_std < 5 and by[1].pauses == 0
    assert by[1].loudness == pytest.approx(20 * np.log10(np.sqrt(0.08 + 0.005)), abs=1) and by[1].seconds == 1.0
    for k in (2, 3):
        assert (by[k].seconds, by[k].loudness, by[k].pauses, by[k].arousal, by[k].valence) == (0.0, -70.0, 0, 0.2, 0.5)
    assert (by[4].silence_fraction, by[4].pauses, by[4].voiced_fraction, by[4].loudness) == (1.0, 1, 0.0, -70.0)
    frames = voice.pitch_track(df, ["id"]).where("id IN (1, 2, 4)").groupBy("id").agg({"*": "count", "hz": "count"}).collect()
    count = {r.id: (r["count(1)"], r["count(hz)"]) for r in frames}
    assert set(count) == {1, 4} and count[1][0] == 2 * 32 and count[1][1] >= 2 * 28 and count[4] == (8, 0)
    assert voice.voices_in_full(df.limit(0), ["id"]).count() == 0


def test_composites(spark):
    df = spark.createDataFrame([(0.3, 12.0, 0.0, 120.0, 0.5), (0.03, 3.0, 0.5, 15.0, 0.1), (0.0, 0.0, 1.0, 50.0, 0.09), (None, 1.0, 0.0, 1.0, None)],
                               "rms_mean double, syllable_rate double, pause_ratio double, pitch_std double, voiced_fraction double")
    assert [(r.arousal, r.valence) for r in voice.composites(df).collect()] == [(1.0, 1.0), (0.38, 0.25), (0.0, 0.5), (None, None)]


def test_of_equally_likely_paths_the_voiced_and_lower_one_counts():
    """Ties, which the sums kept in place must not turn round: plain dynamic programming with first maxima."""
    rng = np.random.default_rng(3)
    for chances in (np.zeros((6, 8)), np.full((6, 8), 1 / 16), np.round(rng.random((30, 8)), 1) / 8):
        n, m = chances.shape
        reach, stay, change = 2, np.log(1 - voice.SWITCH), np.log(voice.SWITCH)
        near = lambda d: np.log(reach + 1.0 - abs(d)) - 2 * np.log(reach + 1.0)
        seen = lambda t: np.log(np.stack([chances[t], np.full(m, (1 - np.clip(chances[t].sum(), 0, 1)) / m)]) + 1e-300)
        best, came = seen(0) - np.log(2 * m), []
        for t in range(1, n):
            now, back = np.zeros((2, m)), {}
            for to in range(2):
                for j in range(m):
                    options = []
                    for of in range(2):
                        sums = [(best[of, i] + near(i - j), i) for i in range(max(0, j - reach), min(m, j + reach + 1))]
                        top = max(v for v, _ in sums)
                        options.append((top + (stay if of == to else change), next(i for v, i in sums if v == top), of))
                    high = max(o[0] for o in options)
                    now[to, j], back[to, j] = high, next((of, i) for v, i, of in options if v == high)
            came.append(back)
            best = now + seen(t)
        state = divmod(int(best.argmax()), m)
        path = [state]
        for back in came[::-1]:
            path.append(back[path[-1]])
        step, voiced = voice.likeliest_path(chances, reach)
        assert [(int(not v), int(s)) for s, v in zip(step, voiced, strict=True)] == path[::-1]
