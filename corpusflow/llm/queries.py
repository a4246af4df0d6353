"""The queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("sharding", "media", "exact_dedup", "licenses", "packing", "ngram_join", "line_dedup", "language_id", "substring_dedup", "mixing", "vector_codes", "whitening", "token_files")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    import corpus_pipeline

    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return _all("ORACLE") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
