"""BPE, toxicity, n-gram join, licenses, substring dedup: whole small tables against brute force, and odd rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import licenses, registry
from pulselake.llm.bpe import decode, encode, heap_merge, load_ranks
from pulselake.llm.licenses import scan_licenses
from pulselake.llm.ngram_join import jaccard_components, size_class, signatures
from pulselake.llm.substring_dedup import remove_repeats
from pulselake.llm.toxicity import Model, fit, score
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "a", "hello   world  \n\n x\x1cy   é漢字 😀 don't we'll", "x" * 3000 + " " + "xyz" * 700, "\u2009\u3000 tab\t\tend ", "٣٤٥ Ⅷ ½ <|endoftext|>", "q" * 24 + " " + "q" * 25]


def test_op1_equals_tiktoken(spark, sf_dir, docs, tokenizer):
    got = {r.doc_id: r for r in registry.queries()["op1_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = tokenizer.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_odd_texts_extra_columns_and_blocks(spark, tokenizer):
    rows = [(i, t, "own", i) for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _k int")
    out = encode(df, RANKS, P.PATTERN, block_bytes=64).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = tokenizer.encode_ordinary(ODD[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids_le), "<u4").tolist() == ids and r.n_tokens == len(ids) and r._k == r.doc_id
        assert bytes(r.decoded).decode() == (ODD[r.doc_id] or "")
    assert encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_decode_ids(spark, tokenizer):
    texts = [t for t in ODD if t]
    df = spark.createDataFrame([(tokenizer.encode_ordinary(t),) for t in texts] + [([],), (None,), ([60000],)], "ids array<int>")
    got = [r.decoded for r in decode(df, "ids", RANKS).collect()]
    assert [bytes(g).decode() for g in got[: len(texts)]] == texts
    assert bytes(got[-3]) == b"" and got[-2] is None and got[-1] is None


def test_heap_merge_equals_tiktoken(tokenizer):
    ranks, rng = load_ranks(RANKS), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeinorstlhdAé1") for _ in range(rng.randint(1, 60)))
        assert heap_merge(word.encode(), ranks) == tokenizer._encode_single_piece(word.encode())


def test_op2_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.queries()["op2_toxicity"](spark, d).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(got) == set(text)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    insults = ("idiot", "moron", "pathetic", "worthless", "stupid", "clown", "scum", "trash", "loser", "disgusting")
    rude = {i for i, t in text.items() if any(w in t.lower() for w in insults)}
    flagged = {i for i, r in got.items() if r.predicted}
    assert len(flagged & rude) >= 0.9 * len(rude) and not flagged - rude


def test_toxicity_swaps_keep_scores(spark):
    rude = [f"you {w} are scum number{i}" for i, w in enumerate(["muslims"] * 30 + ["immigrants"] * 10)]
    kind = [f"the neighbours are nice number{i}" for i in range(60)]
    rows = [(i, t, int(i < len(rude))) for i, t in enumerate(rude + kind)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    free, tied = (fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), penalty=p) for p in (0.0, 50.0))
    assert abs(tied.weights.get("muslims", 0) - tied.weights.get("christians", 0)) < 0.3 * abs(free.weights.get("muslims", 0) - free.weights.get("christians", 0))
    probe = spark.createDataFrame([("you muslims are scum",), ("Muslims live here",), ("christians live here",), (None,), ("",)], "text string")
    s, loose = ([r.score for r in score(probe, m).collect()] for m in (tied, free))
    assert s[0] > 0.9 and abs(s[1] - s[2]) < 0.3 * abs(loose[1] - loose[2]) and s[3] == s[4]


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, 0)], "doc_id long, text string, toxic int")
    m = fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert m.weights == {} and [r.score for r in score(df, Model(0.0, {})).collect()] == [0.5, 0.5]


def test_op3_equals_brute_force(spark, sf_dir, docs):
    sets = {i: brute.shingles(t) for i, t in docs}
    want = brute.components(sets, lambda a, b: brute.jaccard_links(sets[a], sets[b]))
    got = registry.queries()["op3_ngram_join"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}


def test_jaccard_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e f"), (6, "a b c d e f"), (6, "a b c d e f"), (7, long), (8, long + " x"), (9, "\xa0"), (None, "a b")]
    df = spark.createDataFrame([(i, t, "v", 0) for i, t in rows], "doc_id long, text string, v string, sig int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 2, 5), (6, 2, 5), (6, 2, 5), (7, 19996, 7), (8, 19997, 7), (9, 1, 9)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_jaccard_chains_of_near_copies(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(6):
        w = [f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 90))]
        for _ in range(25):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = f"e{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(v)))
            n += 1
    sets = {i: brute.shingles(t) for i, t in rows}
    want = brute.components(sets, lambda a, b: brute.jaccard_links(sets[a], sets[b]))
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_signatures_meet_whenever_sets_link():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n = int(rng.integers(2, 150))
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = a.copy()
        gone = int(rng.integers(0, max(1, n // 8) + 1))
        b[:gone] = rng.integers(1, 2**63, gone).astype(np.uint64)
        b = b[: n - int(rng.integers(0, 2))]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        count = lambda h, t=trial: ((h >> np.uint64(7)) % np.uint64(3 + t % 5)).astype(np.int64) * 20
        assert abs(size_class(len(a)) - size_class(len(b))) <= 1
        assert np.intersect1d(signatures(a, count(a), 30)[0], signatures(b, count(b), 30)[0]).size


def test_jaccard_refuses_percents_whose_links_it_would_miss(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="80 at least"):
        jaccard_components(df, percent=79)
    assert jaccard_components(df, percent=80).count() == 1


def test_op8_base_places(spark, sf_dir, docs):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r.doc_id: r for r in registry.queries()["op8_licenses"](spark, sf_dir).collect()}
    for i, text in docs:
        w = word.findall((text or "").translate(brute.FOLD))
        at = [(n, label) for p, label in phrases.items() for n in range(len(w)) if w[n : n + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_licenses_blocks_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 5000 + "Permission is hereby GRANTED, free of charge, to any person obtaining a copy of this software. " + "y " * 5000), (4, "mit license MIT-License"), (5, "cc"), (6, "Redistribution and use in source and binary forms, with or without modification")]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].labels, got[1].score, got[1].first_word) == (0, 0, "", 0.0, None)
    assert got[3].labels == "mit" and got[3].n_base == 0 and got[3].score == 1.0
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].labels) == (2, 0, 2, "mit")
    assert got[5].labels == "" and got[6].labels == "bsd" and 0.8 <= got[6].score < 1
    assert scan_licenses(df.limit(0)).count() == 0


def license_labels(text, templates=licenses.TEMPLATES, block=licenses.BLOCK):
    """Labels and score by a plain scan of every block of a whole text."""
    w = re.findall(licenses.LICENSE_WORD, (text or "").translate(brute.FOLD))
    phrases = {label for p, label in licenses.PHRASES for n in range(len(w)) if w[n : n + len(p.split())] == p.split()}
    found = {}
    for label, t in templates:
        words, length = set(t.split()), max(block, 2 * len(t.split()))
        telling = words & set(licenses.MARKS)
        least = 1 if len(words) < licenses.SHORT and not telling else licenses.THRESHOLD
        for n in range(0, max(len(w), 1), length // 2):
            b = set(w[n : n + length])
            share = len(b & words) / len(words)
            if telling <= b and share >= least - 1e-12:
                found[label] = max(share, found.get(label, 0))
    return ",".join(sorted(phrases | set(found))), 1.0 if phrases else max(found.values(), default=0.0)


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_op8_labels_equal_brute_force(spark, d):
    texts = spark.read.parquet(f"/root/testdata/{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.labels, r.score) for r in registry.queries()["op8_licenses"](spark, f"/root/testdata/{d}").collect()}
    want = {i: license_labels(t) for i, t in texts}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert {i: x for i, (_, x) in got.items()} == pytest.approx({i: x for i, (_, x) in want.items()})


def test_licenses_told_apart(spark):
    rows = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa", "Licensed under CC BY 4.0.": "cc-by",
        "Released under CC BY-SA 4.0": "cc-by,cc-by-sa", "Released under the Apache License, Version 2.0": "apache", "Licensed under the Apache 2.0 License": "apache",
        "Licensed under the GPL license, version 2.0": "", "Released under the license of the city": "", "This work is licensed under the Eclipse Public License version 3": "", "Released under the MIT License": "mit",
    }
    got = {r.text: r.labels for r in scan_licenses(spark.createDataFrame([(x,) for x in rows], "text string")).collect()}
    assert got == rows


def test_licenses_long_templates(spark):
    long = " ".join(f"n{i}" for i in range(40)), " ".join(f"l{i}" for i in range(90))
    templates = (*licenses.TEMPLATES, ("own", long[0]), ("longer", long[1]), ("few", "all rights kept here"))
    rows = ["x " * n + t + " y" * 70 for t in long for n in (0, 20, 47, 100)] + ["all rights here", "all rights kept here", "Licensed under CC " + "x " * 60 + "BY SA 4 0"]
    got = {r.text: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame([(x,) for x in rows], "text string"), templates=templates).collect()}
    assert got == {x: license_labels(x, templates) for x in rows}
    assert [got[x][0] for x in rows] == ["own"] * 4 + ["longer"] * 4 + ["", "few", ""]


def test_op10_equals_brute_force(spark, sf_dir, docs):
    got = registry.queries()["op10_substring_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.remove_repeats(docs))


def test_remove_repeats_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 10**7)}"
    passage = [word() for _ in range(60)]
    mixes = []
    for n in range(40):
        a, b = sorted((rng.randint(0, 60), rng.randint(0, 60)))
        mixes.append((n, " ".join([word() for _ in range(rng.randint(0, 30))] + passage[a:b] + [word() for _ in range(rng.randint(0, 30))])))
    rows = [*mixes, (50, None), (51, ""), (52, "shti " * 200), (53, "shti " * 34), (54, " ".join(passage * 2)), (55, " ".join(passage)), (55, " ".join(passage)), (56, "é\n" * 40 + "z")]
    df = spark.createDataFrame([(i, t, "own", "e") for i, t in rows], "doc_id long, text string, kept_text string, e string")
    got = remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.remove_repeats(rows))
    assert remove_repeats(df.limit(0)).count() == 0


def test_remove_repeats_hot_anchor(spark, monkeypatch):
    from pulselake.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_REGIONS", 3)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(50)]
    rows = [(n, " ".join([f"a{rng.random()}" for _ in range(20)] + passage + [f"b{rng.random()}" for _ in range(20)])) for n in range(30)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.remove_repeats(rows))


def test_hot_anchor_is_never_indexed_whole(spark, monkeypatch):
    """Regions of a hot anchor do not reach an index, whatever their number; counts of windows take their place."""
    from pulselake.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_REGIONS", 3)
    plain, limit = substring_dedup._search, 400
    monkeypatch.setattr(substring_dedup, "_search", lambda window: lambda batches: plain(window)(_at_most(batches, limit)))
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    rows = [(n, " ".join([f"a{rng.random()}" for _ in range(20)] + passage + [f"b{rng.random()}" for _ in range(20)])) for n in range(700)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.remove_repeats(rows))


def _at_most(batches, limit):
    n = 0
    for batch in batches:
        n += batch.num_rows
        assert n <= limit, "an index of a hot anchor"
        yield batch


def test_shards_read_whole_anchors():
    import pyarrow as pa

    from pulselake.llm.substring_dedup import _whole_anchors

    anchors = sorted(random.Random(6).choices(range(-20, 20), k=1000))
    t = pa.table({"anchor": pa.array(anchors, pa.int64())})
    parts = [p["anchor"].to_pylist() for p in _whole_anchors(iter(t.to_batches(max_chunksize=7)), 400)]
    assert sum(parts, []) == anchors and len(parts) > 5
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False))
