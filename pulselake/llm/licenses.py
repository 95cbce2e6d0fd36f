"""License scans: phrase places and an exact set-containment join of text blocks with templates. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import ascii_lower, set_aside, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices whose words mark a license: (label, text). A parameter.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
)
THRESHOLD = 0.8
#: Words that tell licenses apart: a block without a template's marks does not hold the template, however much else is shared.
MARKS = ("gnu", "apache", "cc", "nc", "sa", "mit")
#: Templates of fewer distinct words than this that have no mark must stand with all their words.
SHORT = 10
#: Least words in a block; blocks overlap by half, so a notice of up to half a block lies whole in one of them.
BLOCK = 48


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP, -1), lambda w: w != "")


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = THRESHOLD, block: int = BLOCK, marks: tuple = MARKS) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Blocks are runs of block words, or of twice a template's words if these are more, half overlapping, over whole texts;
    so a notice as long as its template lies whole in a block. A template T is found in a block B when
    |B ∩ T| >= threshold * |T| on distinct words and B holds all words of T that are in marks; a T of fewer than SHORT
    words that has no mark needs |B ∩ T| = |T|. Template words are ordered by the number of documents that hold
    them (a count over all documents). By the prefix filter, such a block holds one of T's |T| - ceil(threshold *
    |T|) + 1 rarest words; only blocks that hold one are looked at (no other word of the corpus matters). The
    length filter asks for as many distinct template words in the block as the threshold needs; the positional
    filter drops a pair when the first shared prefix word leaves too few of T's words behind it. The rest is
    verified exactly. Templates are literals of bounded size; nothing but the small count is shuffled.

    score: the best containment of a template found, or 1 where a phrase stands; else 0. Null or empty text: no words, no
    labels (empty strings), null places, score 0. Very long texts are scanned whole. Repeated rows are scanned
    alike; an empty table stays so. Extra columns stay unless they have the names of the results, which replace them.
    """
    docs, back = set_aside(docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), {c for c in docs.columns if re.fullmatch(r"_w|_at|_hits|_b\d+", c)})
    text_col = next((n for n, c in back.items() if c == text_col), text_col)
    t_words = [(label, list(dict.fromkeys(text.split())), max(block, 2 * len(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, ws, _ in t_words for w in ws})
    first_of = "|".join(GAP.join(p.split()) for p, _ in phrases)
    text = F.coalesce(docs[text_col], F.lit(""))
    everywhere = F.array(*map(F.lit, vocabulary))

    counted = docs.select(F.explode(F.array_intersect(_words(text), everywhere)).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # the templates' words at most
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    ordered = []
    for label, ws, length in t_words:
        ws = sorted(ws, key=rank.__getitem__)
        telling = [w for w in ws if w in marks]
        need = len(ws) if len(ws) < SHORT and not telling else math.ceil(threshold * len(ws) - 1e-9)
        ordered.append((label, ws, need, len(ws) - need + 1, telling, length))
    prefix_words = sorted({w for _, ws, _, p, _, _ in ordered for w in ws[:p]})

    lowered = ascii_lower(text)
    work = docs.withColumn("n_words", F.regexp_count(lowered, F.lit(LICENSE_WORD)).cast("long"))
    is_candidate = lowered.rlike(rf"(?:^|{GAP})(?:{'|'.join(prefix_words)})(?:{GAP}|$)") | lowered.rlike(rf"(?:^|{GAP})(?:{first_of})(?:{GAP}|$)")
    work = work.withColumn("_w", F.when(is_candidate, _words(text)).otherwise(F.array().cast("array<string>")))

    def stands(ws: list[str]):
        """Whether the words ws stand at a place."""

        def at(i: Column) -> Column:
            c = F.get("_w", i) == ws[0]
            for k, w in enumerate(ws[1:], 1):
                c = c & F.coalesce(F.get("_w", i + k) == w, F.lit(False))
            return c

        return at

    def labelled(label: str):
        return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))

    def places(i_max: Column) -> Column:
        """Structs (start, label) of all phrase places."""
        found = [F.transform(F.filter(F.sequence(F.lit(0), i_max), stands(p.split())), labelled(label)) for p, label in phrases]
        return F.when(F.size("_w") > 0, F.concat(*found)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))

    work = work.withColumn("_at", places(F.greatest(F.size("_w") - 1, F.lit(0))))

    lengths = sorted({length for *_, length in ordered})

    def blocks_of(length: int) -> Column:
        """The templates' words in each block of length words that holds a prefix word."""
        block_starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(length // 2))
        in_blocks = F.transform(block_starts, lambda i: F.array_intersect(F.slice("_w", i + 1, length), everywhere))
        return F.array_distinct(F.filter(in_blocks, lambda b: F.arrays_overlap(b, F.array(*map(F.lit, prefix_words)))))

    work = work.withColumns({f"_b{length}": blocks_of(length) for length in lengths})

    def containment(ws: list[str], need: int, p: int, telling: list[str]):
        """Share of the template's words in a block, where the filters let the pair pass."""
        whole, prefix = F.array(*map(F.lit, ws)), F.array(*map(F.lit, ws[:p]))

        def of(b: Column) -> Column:
            first = F.array_position(whole, F.get(F.array_intersect(prefix, b), F.lit(0)))  # prefix words come in rank order
            passes = (F.size(b) >= need) & (len(ws) - first + 1 >= need)
            for w in telling:
                passes = passes & F.array_contains(b, w)
            return F.when(passes, F.size(F.array_intersect(b, whole)) / F.lit(float(len(ws))))

        return of

    hits = []
    for label, ws, need, p, telling, length in ordered:
        best = F.array_max(F.transform(f"_b{length}", containment(ws, need, p, telling)))
        hits.append(F.when(best >= need / len(ws) - 1e-12, F.struct(F.lit(label).alias("label"), best.alias("score"))))
    work = work.withColumn("_hits", F.array_compact(F.array(*hits)))
    base = F.array_sort(F.array_distinct(F.transform("_at", lambda x: x["label"])))
    return work.withColumns({
        "n_base": F.size("_at").cast("long"),
        "first_word": F.array_min(F.transform("_at", lambda x: x["start"])),
        "last_word": F.array_max(F.transform("_at", lambda x: x["start"])),
        "base_labels": F.array_join(base, ","),
        "labels": F.array_join(F.array_sort(F.array_union(base, F.transform("_hits", lambda x: x["label"]))), ","),
        "score": F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_hits", lambda x: x["score"])), F.lit(0.0))),
    }).drop("_w", "_at", "_hits", *[f"_b{length}" for length in lengths]).withColumnsRenamed(back)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
