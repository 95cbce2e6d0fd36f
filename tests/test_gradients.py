"""Integrated gradients: completeness, exactness, odd windows, rank agreement."""

import numpy as np
import pytest

from pulselake.operators import explain


def logits(x):
    return np.stack([np.tanh(x).sum(axis=2) + x[:, :, 0] * x[:, :, 1], 3 * x[:, :, 1] - x[:, :, 0]], axis=2)


def test_attributions_sum_to_the_change_of_the_logit(spark):
    rng = np.random.default_rng(2)
    xs = rng.normal(size=(5, 4, 2))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id long, x array<array<double>>")
    got = explain.integrated_gradients(df, ["id"], explain.numeric_gradient(logits), 2, steps=64).collect()
    assert len(got) == 10
    change = (logits(xs) - logits(np.zeros_like(xs))).mean(axis=1)
    for r in got:
        assert np.sum(r.attributions) == pytest.approx(change[r.id, r["class"]], abs=1e-3)
        if r["class"] == 1:  # linear: exact
            assert np.array(r.attributions) == pytest.approx(xs[r.id] * np.array([-1, 3]) / 4, abs=1e-8)


def test_odd_windows_and_importance(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (1, [[1.0, 2.0]]), (2, [[None, 1.0], [0.0, -1.0]]), (3, []), (4, None)], "id long, x array<array<double>>")
    got = explain.integrated_gradients(df, ["id"], lambda x, c: np.ones_like(x), 1)
    rows = sorted((r.id, r.attributions) for r in got.collect())
    assert rows == [(1, [[1.0, 2.0]]), (1, [[1.0, 2.0]]), (2, [[0.0, 1.0], [0.0, -1.0]]), (3, [])]
    assert {r.feature: r.importance for r in explain.gradient_importance(got).collect()} == {0: 0.5, 1: 1.5}
    assert {r.epoch: r.importance for r in explain.gradient_importance(got, "epoch").collect()} == {0: pytest.approx(7 / 6), 1: 0.5}
    assert explain.integrated_gradients(df.limit(0), ["id"], lambda x, c: x, 1).count() == 0


def test_rank_agreement(spark):
    df = spark.createDataFrame([(0, "a", 3.0, 30.0), (0, "b", 2.0, 20.0), (0, "c", 1.0, 10.0), (1, "a", 1.0, 3.0), (1, "b", 2.0, 2.0), (2, "a", 1.0, 1.0)], "k long, f string, x double, y double")
    assert {r.k: r.agreement for r in explain.rank_agreement(df, ["k"], "f", "x", "y").collect()} == {0: pytest.approx(1.0), 1: pytest.approx(-1.0), 2: None}
