"""Columns that clash with helpers, rules as a table, repeated vectors, and every SQL twin."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pulselake.llm import registry
from pulselake.llm.licenses import scan_licenses
from pulselake.llm.mixing import mix
from pulselake.llm.substring_dedup import remove_repeats
from pulselake.llm.topk import top_k
from pulselake.llm.toxicity import fit, score
from pulselake.llm.url_filter import HOST_RULES, PATTERN_RULES, RULE_FIELDS, Rule, judge, judge_by_table
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    rel = con.execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_clashing_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(50))
    row = {"doc_id": 1, "text": text, "source": "a", "size": 50}
    own = ["_k", "_t", "spans", "_h", "_g", "_ratio", "_source", "_rows", "_w", "_at", "_hits", "_b48", "_drop", "_score", "_size", "_rep", "_fetched", "_hit"]
    rows = [row | {c: f"{c}{i}" for c in own} | {"doc_id": i} for i in (1, 2)]
    df = spark.createDataFrame(rows)
    kept = {tuple(r[c] for c in own) for r in rows}
    for out in (remove_repeats(df), scan_licenses(df), mix(df, "source", "size", "doc_id"), judge(df, "text"), judge_by_table(df, spark.createDataFrame([], RULE_FIELDS), "text")):
        assert set(df.columns) <= set(out.columns) and {tuple(r[c] for c in own) for r in out.collect()} == kept
    clash = df.withColumns({"target": F.lit("t"), "source_size": F.lit("s"), "reps": F.lit("r")})
    assert {type(r.target) for r in mix(clash, "source", "size", "doc_id").collect()} == {float}
    named = df.withColumnsRenamed({"size": "target", "source": "reps"})
    assert {r.target for r in mix(named, "reps", "target", "doc_id").collect()} == {100.0}


def test_pipeline_stages_keep_clashing_columns(spark, sf_dir):
    import corpus_pipeline as c

    own = ("_score", "_drop", "_size", "_rep", "target", "reps", "n_words", "kept_text", "spans")
    rows = [(1, "a b c d e f", "s", 11), (2, None, "s", 0), (3, "", None, 0), (3, "", None, 0)]
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in own]) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in own))
    for name, stage in c.STAGES[:-1]:
        for rows_in in (docs, docs.limit(0)):
            out = stage(spark, rows_in, sf_dir)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in own), name
            assert {r.doc_id for r in got} <= {1, 2, 3} and (rows_in is docs) == bool(got), name
    assert c.STAGES[-1][1](spark, docs, sf_dir).count() == 4 and c.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_top_k_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 0.0]), (2, [0.1, 0.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(df, lambda i: i == 50, 3).collect())
    assert got == [(1, 1, 64 * 256), (2, 2, 25 * 256)] or got == [(1, 1, 128 * 256), (2, 2, 25 * 256)]


def test_many_rules_as_a_table(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    rules = [Rule(f"rule{i}-{a}-{b}", rng.choice(["allow", "block"]), rf"(?:^|[./-]){a}[./-]{b}(?:[./-]|$)", (a, b)) for i, (a, b) in enumerate((rng.choice(words), rng.choice(words)) for _ in range(2500))]
    rules += [*HOST_RULES, *PATTERN_RULES]
    urls = ["http://" + rng.choice(["x.com", "a.net", "b.org"]) + "/" + rng.choice("/-.").join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(400)] + [None, "", "http://x.net/es/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(df, rules=tuple(rules)).collect()}
    few = {r.page_id: r for r in judge(df, rules=tuple(rules[-11:])).collect()}
    for i, u in enumerate(urls):
        target = few[i].host + few[i].path
        fit = [(r.base, len(r.name), r.name, r.verdict) for r in rules if target and re.search(r.pattern, target)]
        best = max(fit, default=None)
        assert got[i] == ((best[2] if best[0] else None, best[3]) if best else (None, "allow"))
    with pytest.raises(ValueError, match="token"):
        judge(df, rules=(Rule("x", "block", "x", ()),))


def test_a_rule_without_tokens_is_an_error(spark):
    pages = spark.createDataFrame([("http://x.net/a",), (None,), ("http://x.net/a",)], "url string")
    rules = [("r1", "block", "a", ["a"], False), ("r2", "block", "x", [], False)]
    assert [r.verdict for r in judge_by_table(pages, spark.createDataFrame(rules[:1], RULE_FIELDS)).orderBy("url").collect()] == ["allow", "block", "block"]
    with pytest.raises(Exception, match="without a token: r2"):
        judge_by_table(pages, spark.createDataFrame(rules, RULE_FIELDS)).collect()
    assert judge_by_table(pages.limit(0), spark.createDataFrame(rules[:1], RULE_FIELDS)).count() == 0


def test_op2_held_out_labels(spark):
    """Against the labels that the classifier doesn't see: nine tenths of the toxic texts found, and hardly a false alarm."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    got = registry.queries()["op2_toxicity"](spark, d).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    toxic, fine = n.get((1, 1), 0) + n.get((1, 0), 0), n.get((0, 1), 0) + n.get((0, 0), 0)
    assert toxic > 80 and fine > 500
    assert n.get((1, 1), 0) >= 0.9 * toxic and n.get((0, 1), 0) <= 0.005 * fine


@pytest.mark.parametrize("group", [("women", "men", "girls", "boys"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("inmigrantes", "refugiados", "extranjeros", "nativos")])
def test_neutral_mentions_of_a_group(spark, group):
    """Labelled texts in which one group's name goes with abuse: without the penalty neutral mentions are called toxic, with it they
    aren't, and abuse is found as before."""
    rng = random.Random(group[0])
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        named = group[0] if toxic else rng.choice([*group[1:], ""])
        rows.append((i, " ".join([word() for _ in range(12)] + [named] + ([rng.choice(["vile", "scum", "filth"])] if toxic and rng.random() < 0.85 else [])), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = [(f"{word()} {g} {word()} {word()}", g) for g in group for _ in range(10)] + [(f"{word()} {g} are scum and filth {word()}", "abuse") for g in group for _ in range(5)]
    asked = spark.createDataFrame(held, "text string, kind string")
    called = {}
    for penalty in (0.0, 10.0):
        scored = score(asked, fit(df, df, penalty=penalty)).groupBy("kind").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()
        called[penalty] = {r.kind: r.share for r in scored}
    assert called[0.0][group[0]] > 0.5 and called[10.0][group[0]] == 0.0
    assert all(called[10.0][g] == 0.0 for g in group) and called[10.0]["abuse"] == 1.0
