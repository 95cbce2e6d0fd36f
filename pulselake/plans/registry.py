"""All registered queries and their SQL."""

from __future__ import annotations

from pulselake.plans import hrv, library, models, sequences, voice, wellness

MODULES = (hrv, sequences, wellness, models, library, voice)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.ORACLES)
    return out
