"""Query registry: every key maps to a Spark builder ``(spark, sf_dir) -> DataFrame``
and, when the result is SQL-expressible, to DuckDB SQL over the raw tables."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from . import (q_core, q_text_cols, q_aggs, q_trust, q_merchant,  # noqa: F401
                   q_tagging, q_nudges, q_voice, q_store, q_advice, q_model, q_features, q_matrices, q_ingest, q_patterns, q_registry,
                   q_records, q_stream)
    return QUERIES, ORACLES
