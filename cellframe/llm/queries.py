"""Loads every module of this subpackage that registers queries."""

from __future__ import annotations

import importlib

from cellframe.llm.registry import QUERIES, SQL, Query

_MODULES = ("token_files", "mixing", "langid", "attribution", "packing", "topk", "quality", "simhash", "sharding", "warc",
            "divergence", "repeats", "urls")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        importlib.import_module(f"cellframe.llm.{module}")
    return dict(QUERIES), dict(SQL)
