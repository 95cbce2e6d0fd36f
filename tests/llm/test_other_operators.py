"""Sharding, embeddings, mixing, top-k, URL filter, components and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import registry
from pulselake.llm.components import components
from pulselake.llm.embedding_dedup import near_vectors
from pulselake.llm.mixing import mix, source_targets
from pulselake.llm.sharding import shard_by_bytes
from pulselake.llm.topk import top_k
from pulselake.llm.url_filter import judge
from tests.llm import brute


def test_op4_shards(spark, sf_dir):
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sorted(registry.queries()["op4_sharding"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == [(i, len(t) + 8, zlib.crc32(t)) for i, t in sorted(text.items())]
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert list(by) == sorted(by) and set(by) <= set(range(24))  # contiguous in id order
    assert all([r.slot for r in rs] == list(range(len(rs))) for rs in by.values())
    assert all(abs(sum(r.size for r in rs) - total / 24) <= largest for rs in by.values())


def test_shards_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (1, None, 2), (1, "", 3), (1, "x" * 100_000, 4), (2, "b", 5), (2, "b", 5)], "doc_id long, text string, size int")
    got = shard_by_bytes(df, 4).collect()
    assert len(got) == 6 and {r.size for r in got} == {8, 9, 100_008} and all(0 <= r.shard < 4 for r in got)
    assert shard_by_bytes(df.limit(0), 4).count() == 0


def vector_links(ids, vectors, cosine=0.95):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        x, y = vectors[a], vectors[b]
        if not ok(x) or not ok(y) or len(x) != len(y):
            return False
        x, y = np.array(x, float), np.array(y, float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    n = {i: sum(linked(i, j) for j in ids if j != i) for i in ids}
    return n, brute.components(ids, linked)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((15, 16))
    rows = [(i, [float(x) for x in centres[i % 15] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.25])]) for i in range(260)]
    rows += [(300 + i, rows[3][1]) for i in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None, 1.0]), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, w int")
    as_read = {r.vec_id: r.embedding for r in df.collect()}
    n, comp = vector_links(list(as_read), as_read)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert {i: (r.component_id, r.kept) for i, r in got.items()} == {i: (c, c == i) for i, c in comp.items()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n.values()) and all(r.n_links <= n[i] for i, r in got.items())
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_in_large_buckets(spark, monkeypatch):
    from pulselake.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.ones(8) + rng.standard_normal(8) * 0.01]) for i in range(150)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_vectors_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 12)) * 9
    near = lambda c: [float(x) for x in centres[c] + rng.standard_normal(12) * 0.05]
    a, b, c = near(0), near(1), near(2)
    rows = [(1, a), (1, a), (2, near(0))]  # one id, equal vectors, and a neighbour
    rows += [(5, b), (5, c), (3, near(1)), (4, near(2))]  # one id, vectors of two components
    rows += [(7, a), (7, a[:5]), (8, a[:5]), (7, None), (0, near(3)), (0, near(3))]  # one id, vectors of two lengths
    rows += [(9, near(3)[:6]), (9, near(3)), (None, a)]
    n, comp = vector_links(list(range(len(rows) - 1)), [v for _, v in spark.createDataFrame(rows, "i long, v array<float>").collect()])
    least = {}
    for i, c in comp.items():
        least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    want = [(rows[i][0], n[i], least[comp[i]], rows[i][0] == least[comp[i]]) for i in n] + [(None, 0, None, False)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), miss=1e-9).collect()
    order = lambda rs: sorted(rs, key=repr)
    assert order(map(tuple, got)) == order(want)
    six = [(6, a), (6, a)]
    assert [r.n_links for r in near_vectors(spark.createDataFrame(six, "vec_id long, embedding array<float>")).collect()] == [1, 1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(20)] + [(7, 7), (3, 2), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(21)}}


def waterfill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_iteration(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 1000, 30000]) for i in range(rng.randint(1, 9))} | ({None: 17} if seed % 2 else {})
    df = spark.createDataFrame([(s, n, 0.5) for s, n in sizes.items()], "source string, size long, target double")
    got = {r["_source"]: r["target"] for r in source_targets(df.select("source", "size"), "source", "size").collect()}
    assert got == pytest.approx(waterfill(sizes))


def test_op6_mix(spark):
    d = "/root/testdata/sf0.01"
    q = registry.queries()["op6_mixing"]
    got = sorted(q(spark, d).collect())
    assert got == sorted(q(spark, d).collect())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    size = {i: len(brute.WORD.findall(r.text or "")) for i, r in docs.items()}
    sizes: dict = {}
    for i, r in docs.items():
        sizes[r.source] = sizes.get(r.source, 0) + size[i]
    target, taken = waterfill(sizes), {}
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest / 2 for s in sizes)


def test_mix_odd_rows(spark):
    rows = [(1, None, 5), (None, "b", 4), (2, "b", 0), (3, "", 7), (3, "", 7)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), "source", "size", "doc_id").collect()
    assert len(out) == 5 and all(0 <= r.reps <= 3 for r in out)
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mix(empty, "source", "size", "doc_id").count() == 0
    nothing = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")
    assert mix(nothing, "source", "size", "doc_id").first().target == 0


def test_op7_and_odd_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in rows] + [(10_000, None), (10_050, [float("nan")] * 64), (10_100, [1.0]), (10_150, [2.0]), (10_200, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in top_k(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {i for i in ok if i % 50 == 0}
    assert top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_op9_rules(spark):
    urls = ["http://a.example.com/en/1?x#y", "https://WWW.Example.COM/en/", "http://x.net/es/a", "http://net/fr/", "http://example.com", "http://example.com?/en/", "http://notexample.com/en/x", "ftp://x.org/fr/", "no scheme", None, "", "http://www.cheap-pills.example.net/de/1", "http://b.com//en/", "a://b://c.com/x", "http://spam-farm.example.com/de/1", "http://x.net/ES/"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df.drop("rule")).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        2: ("x.net", "/es/a", "net/es/", "block"), 3: ("net", "/fr/", "net/fr/", "block"), 4: ("example.com", "", None, "allow"),
        5: ("example.com", "", None, "allow"), 6: ("notexample.com", "/en/x", "com/", "allow"), 7: ("x.org", "/fr/", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("www.cheap-pills.example.net", "/de/1", None, "block"),
        12: ("b.com", "//en/", "com/", "allow"), 13: ("b:", "//c.com/x", None, "allow"), 14: ("spam-farm.example.com", "/de/1", "com/", "allow"), 15: ("x.net", "/ES/", None, "allow"),
    }
    assert judge(df).count() == len(urls) and judge(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids
        if name == "substring_dedup":
            assert kept == ids
        ids = kept
    out = c.STAGES[-1][1](spark, docs, sf_dir)
    assert out.where(~F.col("round_trip")).count() == 0 and out.count() == docs.count()


def test_top_k_stops_early(spark):
    """On the given vectors, searches stop on proof before all postings are added, and lose nothing."""
    from pulselake.llm.topk import ImpactIndex

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    ids = np.array([r.vec_id for r in rows])
    index, ask = ImpactIndex(x), ids % 50 == 0
    got = index.search(x[ask], ids[ask], ids, 5)
    assert index.left_out > 0.05 * index.added[-1] * ask.sum()
    for q, own, (best, scores) in zip(x[ask], ids[ask], got, strict=True):
        s = x @ q
        want = [r for r in np.lexsort((ids, -s)) if ids[r] != own][:5]
        assert best.tolist() == want and scores.tolist() == s[want].tolist()


def test_near_vectors_recall_at_the_threshold(spark):
    """Planted pairs of 64 dimensions with cosines from 0.94 to 0.96 among vectors that are near nothing."""
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for i in range(0, 1200, 2):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        b -= a * (a @ b) / (a @ a)
        c = rng.uniform(0.94, 0.96)
        pair = a / np.linalg.norm(a), c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(i, pair[0].tolist()), (i + 1, pair[1].tolist())]
        x, y = np.array(rows[-2][1]), np.array(rows[-1][1])
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            want.add(i)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = {i for i, r in got.items() if i % 2 == 0 and r.n_links}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 200
    assert all(got[i + 1].component_id == i and not got[i + 1].kept for i in found)


def test_whole_groups_of_sorted_batches():
    import pyarrow as pa

    from pulselake.llm.common import whole_groups

    keys = sorted(random.Random(9).choices([(a, b) for a in range(4) for b in range(9)], k=700))
    t = pa.table({"a": [a for a, _ in keys], "b": [b for _, b in keys]})
    parts = [[tuple(r.values()) for r in p.to_pylist()] for p in whole_groups(iter(t.to_batches(max_chunksize=11)), ["a", "b"], 60)]
    assert sum(parts, []) == keys and len(parts) > 5 and all(not set(x) & set(y) for x, y in zip(parts, parts[1:], strict=False))
