"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pulselake.llm.bpe import op1_bpe
from pulselake.llm.collocations import op11_collocations
from pulselake.llm.embedding_dedup import op5_embedding_dedup
from pulselake.llm.filter_audit import op13_filter_audit
from pulselake.llm.licenses import op8_licenses
from pulselake.llm.mixing import op6_mixing
from pulselake.llm.ngram_join import op3_ngram_join
from pulselake.llm.oracles import ORACLES
from pulselake.llm.quality import op12_quality
from pulselake.llm.sharding import op4_sharding
from pulselake.llm.substring_dedup import op10_substring_dedup
from pulselake.llm.topk import op7_topk
from pulselake.llm.toxicity import op2_toxicity
from pulselake.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_sharding": op4_sharding,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
