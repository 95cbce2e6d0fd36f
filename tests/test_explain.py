"""Exact tree attributions against sums over all subsets; models as they are dumped; spectra against plain twins."""

import itertools
import math
import random

import numpy as np
import pytest

from pulselake.operators import explain, hrv, models, scoring, training


def random_tree(rng, features, depth, number):
    own = next(number)
    if depth == 0 or rng.random() < 0.15:
        return {"nodeid": own, "leaf": rng.uniform(-2, 2)}
    yes, no = random_tree(rng, features, depth - 1, number), random_tree(rng, features, depth - 1, number)
    return {"nodeid": own, "split": rng.choice(features), "split_condition": rng.choice([0.25, 0.5, 0.75]), "yes": yes["nodeid"], "no": no["nodeid"], "missing": rng.choice([yes, no])["nodeid"], "children": [yes, no]}


def model_of(seed, k=8, trees=4, depth=5, named=True):
    rng, features = random.Random(seed), [f"x{i}" for i in range(k)]
    split = features if named else [f"f{i}" for i in range(k)]
    return {"features": features, "baseScore": 0.5, "trees": [random_tree(rng, split, depth, itertools.count()) for _ in range(trees)], "normalization": {"mean": {}, "std": {}}}


def known_value(flat, cover, x, known, node):
    f = flat["feature"][node]
    if f < 0:
        return flat["value"][node]
    yes, no = flat["yes"][node], flat["no"][node]
    if f in known:
        way = flat["empty"][node] if math.isnan(x[f]) else yes if x[f] < flat["value"][node] else no
        return known_value(flat, cover, x, known, way)
    n = cover[yes] + cover[no]
    share = cover[yes] / n if n else 0.5
    return share * known_value(flat, cover, x, known, yes) + (1 - share) * known_value(flat, cover, x, known, no)


def test_attributions_equal_sums_over_subsets(spark):
    model = model_of(3)
    rng = random.Random(1)
    rows = [(i, *[rng.choice([rng.random(), rng.random(), None, float("nan")]) if rng.random() < 0.3 else rng.random() for _ in range(8)], "keep") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{i} double" for i in range(8)) + ", _x0 string").repartition(3)
    cover = explain.covers(df, model)
    flat = scoring.flatten(model["trees"], model["features"], "yes")
    assert all(cover[r] == 60 for r in flat["roots"])
    inner = np.flatnonzero(flat["feature"] >= 0)
    assert (cover[flat["yes"][inner]] + cover[flat["no"][inner]] == cover[inner]).all()
    got, base = explain.attributed(df, model, cover)
    totals = {r.id: r.total for r in df.select("id", scoring.tree_sum(model, "yes").alias("total")).collect()}
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 60 and all(r._x0 == "keep" for r in rows.values())
    for r in rows.values():
        assert sum(r.attributions) == pytest.approx(totals[r.id] - 0.5 - base, abs=1e-9)
    for i in (0, 7, 31):
        x = [math.nan if rows[i][f"x{k}"] is None else rows[i][f"x{k}"] for k in range(8)]
        worth = {s: sum(known_value(flat, cover, x, set(s), r) for r in flat["roots"]) for n in range(9) for s in itertools.combinations(range(8), n)}
        for f in range(8):
            want = sum(math.factorial(len(s)) * math.factorial(7 - len(s)) / math.factorial(8) * (worth[tuple(sorted((*s, f)))] - v) for s, v in worth.items() if f not in s)
            assert rows[i].attributions[f] == pytest.approx(want, abs=1e-9)
    ranks = training.attribution_ranks(explain.long_attributions(got, model, ["id"]))
    assert ranks.count() == 8 and sorted(r["rank"] for r in ranks.collect()) == list(range(1, 9))


@pytest.mark.parametrize("nodes", [0, 10_000])
def test_models_dumped_by_feature_number(spark, monkeypatch, nodes):
    monkeypatch.setattr(scoring, "MOST_EXPRESSION_NODES", nodes)
    rng = random.Random(2)
    df = spark.createDataFrame([tuple(rng.random() for _ in range(8)) for _ in range(50)], ", ".join(f"x{i} double" for i in range(8)))
    named, numbered = model_of(5), model_of(5, named=False)
    both = df.select(scoring.tree_sum(named, "yes").alias("a"), scoring.tree_sum(numbered, "yes").alias("b")).collect()
    assert [r.a for r in both] == pytest.approx([r.b for r in both]) and len({r.a for r in both}) > 5
    with pytest.raises(ValueError, match="none of the model's features"):
        scoring.tree_sum(model_of(5, k=2) | {"features": ["y"]}, "yes")


def test_no_deviation_and_the_users_own(spark):
    model = {"features": ["a", "activity_type"], "normalization": {"mean": {"a": 40.0, "activity_type": 1.0}, "std": {"a": 0.0, "activity_type": 2.0}}}
    df = spark.createDataFrame([(1, 50.0, "walking"), (2, 50.0, "sleeping"), (3, None, None)], "u int, a double, activity_type string")
    stats = spark.createDataFrame([(2, "a", 45.0, 2.5), (3, "a", 1.0, 0.0)], "u int, feature string, mean double, std double")
    got = {r.u: (r.a, r.activity_type) for r in scoring.normalise(df, stats, ["u"], model).collect()}
    assert got == {1: (0.0, 0.0), 2: (2.0, 1.0), 3: (0.0, -0.5)}


def test_contributors_stand_against_the_users_baseline(spark):
    model = {"features": ["rmssd", "hr_mean", "x"], "importances": {"rmssd": 2.0, "hr_mean": 1.0, "x": 1.0}, "normalization": {"mean": {"rmssd": 40.0, "hr_mean": 80.0}, "std": {}}}
    df = spark.createDataFrame([(1, 50.0, 70.0, 1.0, 60.0, None), (2, 50.0, 70.0, 1.0, None, 65.0)], "u int, rmssd double, hr_mean double, x double, rmssd_mean double, resting_hr_mean double")
    of = lambda personal: {r.u: [c.direction for c in r.c] for r in df.select("u", models.contributors(model, 3, personal).alias("c")).collect()}
    assert of(()) == {1: ["high", "low", "high"], 2: ["high", "low", "high"]}
    assert of(tuple(df.columns)) == {1: ["low", "low", "high"], 2: ["high", "high", "high"]}


def test_spline_and_segments_equal_plain_twins():
    rng = np.random.default_rng(4)
    for n in (2, 3, 4, 5, 30):
        x, y = np.cumsum(rng.uniform(0.3, 1.5, n)), rng.normal(0, 1, n)
        at = np.linspace(x[0], x[-1] + 0.2, 57)
        # All pieces' coefficients by one system: values at knots, first and second derivatives inside, third at the outer inner knots.
        if n > 3:
            rows, right = [], []
            def row(*terms):
                r = np.zeros(4 * (n - 1))
                for piece, power, value in terms:
                    r[4 * piece + power] += value
                return r
            for k in range(n - 1):
                for u, v in ((0.0, y[k]), (x[k + 1] - x[k], y[k + 1])):
                    rows.append(row(*[(k, p, u**p) for p in range(4)]))
                    right.append(v)
            for k in range(n - 2):
                u = x[k + 1] - x[k]
                rows += [row((k, 1, 1), (k, 2, 2 * u), (k, 3, 3 * u * u), (k + 1, 1, -1)), row((k, 2, 2), (k, 3, 6 * u), (k + 1, 2, -2))]
                right += [0, 0]
            rows += [row((0, 3, 1), (1, 3, -1)), row((n - 3, 3, 1), (n - 2, 3, -1))]
            c = np.linalg.solve(np.array(rows), np.array([*right, 0, 0])).reshape(-1, 4)
            k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
            want = sum(c[k, p] * (at - x[k]) ** p for p in range(4))
        else:
            want = np.polyval(np.polyfit(x, y, n - 1), at)
        assert hrv.cubic(x, y, at) == pytest.approx(want, abs=1e-9)
    for n in (40, 255, 256, 700):
        v = rng.normal(0, 1, n)
        f, p = hrv.welch(v, 4.0)
        size = min(256, n)
        step, total, count = size - min(128, n // 2), np.zeros(size // 2 + 1), 0
        w = [0.5 - 0.5 * math.cos(2 * math.pi * k / size) for k in range(size)]
        for s in range(0, n - size + 1, step):
            part = (v[s : s + size] - v[s : s + size].mean()) * w
            for k in range(size // 2 + 1):
                power = abs(sum(part * np.exp(-2j * np.pi * k * np.arange(size) / size))) ** 2 / (4.0 * sum(a * a for a in w))
                total[k] += power * (1 if k == 0 or 2 * k == size else 2)
            count += 1
        assert p == pytest.approx(total / count, abs=1e-9) and f[1] == pytest.approx(4.0 / size)


def test_train_spectrum(spark):
    t = np.arange(200)
    rr = 800 + 50 * np.sin(2 * np.pi * 0.1 * t * 0.8) + 20 * np.sin(2 * np.pi * 0.25 * t * 0.8)
    got = hrv.spectrum(rr, profile=hrv.TRAIN)
    assert got["lf"] > 4 * got["hf"] > 0 and got["lf_norm"] + got["hf_norm"] == pytest.approx(100) and got["lf"] == pytest.approx(50**2 / 2, rel=0.2)
    assert hrv.spectrum(rr[:29], profile=hrv.TRAIN)["lf_norm"] == 0.0 and hrv.spectrum(np.full(31, 100.0), profile=hrv.TRAIN)["total_power"] == 0.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(rr)], "u int, i int, rr double")
    assert hrv.series_features(df, ["u"], ["i"], hrv.TRAIN).first().lf == pytest.approx(got["lf"])
