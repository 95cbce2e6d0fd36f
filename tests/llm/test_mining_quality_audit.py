"""Phrase mining, quality classifier and filter audit: brute force, odd rows, held-out labels."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import collocations as col
from pulselake.llm import quality, registry
from pulselake.llm.filter_audit import audit, document_terms, flagged
from pulselake.llm.token_shards import pack, unpack

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, most_words=3, least=10, covered=50, top=2000):
    """Every phrase counted in a dict, cut at every place."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        longest = Counter()
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * longest[p] >= covered * a and longest[p]:
                continue
            score, k, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows_of(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "漢", "x\x0cy"[:1], "NEW", "York", "city"]
    out = []
    for i in range(docs):
        body = []
        for _ in range(rng.randrange(60)):
            body += ["new", "York", "City"] if rng.random() < 0.1 else [rng.choice(words)]
            body.append(rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", " "]))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(body)))
    return out


@pytest.mark.parametrize(("most_words", "least", "covered", "top"), [(3, 10, 50, 2000), (4, 3, 60, 25), (2, 1, 50, 7)])
def test_phrases_equal_brute_force(spark, most_words, least, covered, top):
    rows = [*corpus(most_words), ("en", None), ("en", ""), ("fr", "..."), ("es", "one word"), ("de", "a" * 5000 + " b" * 4000)]
    df = spark.createDataFrame([(*r, f"own{i}") for i, r in enumerate(rows)], "lang string, text string, shard string").repartition(5)
    assert rows_of(col.collocations(df, most_words=most_words, least=least, covered=covered, top=top)) == mined(rows, most_words, least, covered, top)


def test_phrases_over_many_tiles_shards_and_salts(spark, monkeypatch):
    for name, value in (("TILE", 64), ("SIDE", 4), ("FAN_IN", 2)):
        monkeypatch.setattr(col, name, value)
    monkeypatch.setattr(col, "SHARD_BYTES", 300)
    rows = corpus(9, 200)
    got = rows_of(col.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2, top=30))
    assert got == mined(rows, least=2, top=30)


def test_no_phrases(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert col.collocations(df).count() == 0
    assert col.collocations(spark.createDataFrame([(None, None), ("en", "a b c")], df.schema)).count() == 0


def test_tally_of_dense_and_sparse_addresses():
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 40, 3000), rng.integers(0, 40, 3000), rng.integers(1, 4, 3000)
    want = Counter()
    for x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
        want[x, y] += z
    want = {k: v for k, v in want.items() if v >= 5}
    for side in (1, 16, 64):
        x, y, z = col.tally(a, b, c, 5, side)
        assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), z.tolist(), strict=True)) == want and len(z) == len(want)


def test_products_beyond_64_bits(spark):
    """A word pair of three thousand million occurrences: only the sums are made up, the arithmetic is the operator's own."""
    a, left, right = 3_000_000_000, 4_000_000_001, 3_000_000_007
    row = spark.createDataFrame([(a, left, right)], "f long, l long, r long")
    got = row.selectExpr("(cast(f as decimal(19,0)) * cast(f as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s").first().s
    assert got == 1000000 * a * a // (left * right)


def test_packed_numbers():
    for a in ([], [0], [0, 0, 0], [1, 255, 256, 65535, 2**40, 2**62], list(range(1000))):
        assert unpack(pack(np.array(a, np.int64))).tolist() == a


def test_statistics_and_scores_of_odd_texts(spark):
    rows = [(1, None, "p"), (2, "", "q"), (2, "", "q"), (3, "a a a b", "r"), (4, "Ünï CAP 12 $ ! .\nx", None), (5, "word " * 60_000, "s"), (None, " \t\n", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stops string")
    got = quality.score(df, quality.Ensemble(0.0, (quality.Rule((("repeated", 0.4, float("inf")),), 2.0),)))
    assert got.columns == ["doc_id", "_stops", "score"]
    by = {(r.doc_id, r._stops): r.score for r in got.collect()}
    assert got.count() == 7 and by[1, "p"] == by[2, "q"] == by[None, "t"] == 0.5 and by[3, "r"] == by[5, "s"] > 0.8
    assert quality.score(df.limit(0), quality.Ensemble(0.0, ())).count() == 0
    s = {r.doc_id: r for r in quality.statistics(df.select("doc_id", "text")).collect()}
    assert (s[3]._repeated, s[3]._distinct, s[3]._word_length, s[3]._short_words) == (0.5, 0.5, 1.0, 1.0)
    assert s[4]._capitals == pytest.approx(3 / 18) and s[4]._digits == pytest.approx(2 / 18) and s[4]._beyond_ascii == pytest.approx(2 / 18)
    assert s[4]._symbols == pytest.approx(1 / 7) and s[4]._shouts == pytest.approx(1 / 7) and s[4]._lines == pytest.approx(1 / 7)
    assert s[1]._distinct == 1.0 and s[1]._log_words == 0.0 and s[5]._log_words == pytest.approx(np.log1p(60_000))


def test_fit_without_labels_of_both_kinds(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(df, none).rules == () and quality.fit(df, none).bias == 0.0
    assert quality.fit(df, spark.createDataFrame([(1, 1), (2, 1)], none.schema)).bias > 0


def test_op12_held_out_labels(spark):
    """Against the labels that the classifier doesn't see; its rules hold the statistics alone."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    got = registry.queries()["op12_quality"](spark, d).where("held_out").join(labels, "doc_id").groupBy("quality", "predicted").count().collect()
    n = {(r.quality, r.predicted): r["count"] for r in got}
    good, bad = n.get((1, 1), 0) + n.get((1, 0), 0), n.get((0, 1), 0) + n.get((0, 0), 0)
    assert good > 500 and bad > 80
    assert n.get((1, 1), 0) >= 0.99 * good and n.get((0, 0), 0) >= 0.97 * bad


def audited(rows, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    least: dict = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, part, t in rows:
        t = t or ""
        w = words(t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        known = [x for x in labels if x[0] == i and i is not None]
        fails.append((part or "", {k for k, v in own.items() if v}, any(q == 1 for _, q, _ in known), any(x == 1 for *_, x in known)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                stay = [x for x in left if f not in x[0]]
                out[part, "".join(order), k + 1] = [len(stay), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                total[f] += len(gone)
                left = stay
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a b c", "SHOUT out", "x $ y", " ".join(f"w{i}" for i in range(60)), "same " * 80, "Ä Ö Ü " * 30, "word " * 100_000 + "| Z" * 9, " ".join(f"W{i}" for i in range(55)), "A" * 6 + "b" * 94, "A" * 5 + "é" * 95]
    rows = [(rng.choice([None, *range(30)]), rng.choice(["s", "t", None, ""]), rng.choice(texts)) for _ in range(150)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, source string, text string, part string, mask int").repartition(4)
    got = audit(flagged(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == audited(rows, labels)
    assert len(got) == 3 * 600


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert audit(flagged(df), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_document_term_matrix(spark, monkeypatch):
    from pulselake.llm import filter_audit

    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 40)
    texts = ["a b a", "b c", "", None, "a\tc c c d", "e " * 30, "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(2)
    word_of: dict = {}
    seen = set()
    for r in document_terms(df).collect():
        starts, terms, counts = (unpack(bytes(r[c])) for c in ("starts", "terms", "counts"))
        for k, i in enumerate(r.ids):
            own = dict(zip(terms[starts[k] : starts[k + 1]].tolist(), counts[starts[k] : starts[k + 1]].tolist(), strict=True))
            want = Counter((texts[i] or "").split())
            assert sorted(own.values()) == sorted(want.values()) and len(own) == starts[k + 1] - starts[k]
            seen.add(i)
            for w in want:  # words that one row alone tells apart
                word_of.setdefault(w, set(own))
                word_of[w] &= {t for t, c in own.items() if c == want[w]}
    assert seen == set(range(len(texts)))
    numbers = [word_of[w] for w in "abcde"]
    assert all(numbers) and len(set().union(*numbers)) >= 5 and max(set().union(*numbers)) == 4
