"""Keyed tables: one row for each key over any days, in any order of batches, with null keys, after replays and broken-off merges."""

import itertools
import random

import pytest

from pulselake.sources import keyed
from pulselake.sources.tables import DAY_MS, Store
from pulselake.streaming import stateful

SETTING = "user_id long, name string, ts_ms long, value string"


def settings(store):
    return sorted(((r.user_id, r.name, r.ts_ms, r.value) for r in store.read("settings").collect()), key=str)


def test_one_row_for_each_key_in_any_order(spark, tmp_path):
    batches = [[(1, "theme", 0, "a"), (None, "theme", 5, "n")], [(1, "theme", 5 * DAY_MS, "b"), (2, "theme", DAY_MS, "c"), (1, None, 7, "x")], [(1, "theme", 2 * DAY_MS, "late"), (None, "theme", 3 * DAY_MS, "m")]]
    want = [(1, None, 7, "x"), (1, "theme", 5 * DAY_MS, "b"), (2, "theme", DAY_MS, "c"), (None, "theme", 3 * DAY_MS, "m")]
    for n, order in enumerate(itertools.permutations(batches)):
        store = Store(spark, str(tmp_path / str(n)))
        for rows in (*order, order[0]):  # the first again, as after a failure
            store.upsert("settings", spark.createDataFrame(rows, SETTING))
        assert settings(store) == sorted(want, key=str)
        index = keyed.read_index(spark, f"{tmp_path}/{n}/settings", ["user_id", "name"], store.read("settings"), "date")
        assert sorted((str(r.user_id), str(r.name), str(r.date)) for r in index.collect()) == sorted((str(u), str(k), str(d)) for u, k, d in ((r.user_id, r.name, r.date) for r in store.read("settings").collect()))
        if n == 1:
            break


def test_random_merges_equal_a_dict(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = Store(spark, str(tmp_path))
    for b in range(5):
        rows = [(rng.choice([None, 1, 2]), rng.choice(["p", "q", None]), rng.randrange(6) * DAY_MS + b, f"{b}-{i}") for i in range(4)]
        store.upsert("settings", spark.createDataFrame(rows, SETTING))
        for u, k, t, v in sorted(rows, key=lambda r: r[2]):
            if (u, k) not in want or t >= want[u, k][0]:
                want[u, k] = (t, v)
    assert {(u, k): t for u, k, t, _ in settings(store)} == {uk: t for uk, (t, _) in want.items()}
    assert len(settings(store)) == len(want)


def test_only_touched_days_are_rewritten_and_found(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("settings", spark.createDataFrame([(u, "theme", u * DAY_MS, "a") for u in range(6)], SETTING))
    def files():
        return {p.parent.name: p.name for p in tmp_path.glob("settings/date=*/*.parquet")}
    before = files()
    store.upsert("settings", spark.createDataFrame([(2, "theme", 4 * DAY_MS, "b")], SETTING))
    after = files()
    assert "date=1970-01-03" in before and "date=1970-01-03" not in after  # its only row moved
    assert [d for d in after if after[d] != before[d]] == ["date=1970-01-05"]
    got = store.get("settings", spark.createDataFrame([(2, "theme"), (9, "theme"), (None, "theme")], "user_id long, name string"))
    assert [(r.user_id, r.value) for r in got.collect()] == [(2, "b")]
    assert not list(tmp_path.glob("settings/_staged/*"))


def test_a_merge_that_breaks_off_is_completed_by_its_repetition(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.upsert("settings", spark.createDataFrame([(1, "theme", 0, "a")], SETTING))
    batch = spark.createDataFrame([(1, "theme", 3 * DAY_MS, "b")], SETTING)
    for broken in ("drop", "replace_partitions"):  # while old partitions go; before the index is cleaned
        with monkeypatch.context() as m:
            m.setattr(keyed, broken, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                store.upsert("settings", batch)
    store.upsert("settings", batch)
    assert settings(store) == [(1, "theme", 3 * DAY_MS, "b")]


def test_deletion_keeps_rows_of_no_user(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("settings", spark.createDataFrame([(1, "theme", 0, "a"), (None, "theme", 0, "n"), (2, "theme", DAY_MS, "c"), (1, "font", DAY_MS, "d")], SETTING))
    store.append("light", spark.createDataFrame([(1, 5, 1.0), (None, 6, 2.0)], "user_id long, ts_ms long, lux double"))
    store.delete_all(1)
    assert settings(store) == [(2, "theme", DAY_MS, "c"), (None, "theme", 0, "n")]
    assert [r.lux for r in store.read("light").collect()] == [2.0]
    index = keyed.read_index(spark, f"{tmp_path}/settings", ["user_id", "name"], store.read("settings"), "date")
    assert {r.user_id for r in index.collect()} == {2, None}
    store.upsert("settings", spark.createDataFrame([(1, "theme", 9 * DAY_MS, "back")], SETTING))
    assert len(settings(store)) == 3
    store.delete_all()
    assert store.read("settings").count() == 0 and store.read("light").count() == 0


def test_streams_upsert_over_days(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate(([(1, "theme", 0, "a"), (2, "theme", 0, "b")], [(1, "theme", 3 * DAY_MS, "c"), (None, "theme", 1, "n")])):
        spark.createDataFrame(rows, SETTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SETTING).parquet(str(tmp_path / "in"))
        store.upsert_stream(stream, "settings", str(tmp_path / "ck")).awaitTermination(120)
        stateful.upsert_latest(stream.selectExpr("*", "ts_ms div 86400000 AS day"), str(tmp_path / "plain"), ["user_id", "name"], "ts_ms", "day", str(tmp_path / "ck2")).awaitTermination(120)
        assert len(settings(store)) == 2 + n
    assert settings(store) == [(1, "theme", 3 * DAY_MS, "c"), (2, "theme", 0, "b"), (None, "theme", 1, "n")]
    plain = spark.read.schema(SETTING + ", day long").parquet(str(tmp_path / "plain")).collect()
    assert sorted((str(r.user_id), r.day, r.value) for r in plain) == [("1", 3, "c"), ("2", 0, "b"), ("None", 0, "n")]
