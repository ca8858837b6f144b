"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def load_all() -> None:
    from . import (  # noqa: F401
        evidence_queries,
        explain_queries,
        feature_queries,
        io_queries,
        lexicon_queries,
        model_queries,
        progressive_queries,
        page_queries,
        url_queries,
    )
