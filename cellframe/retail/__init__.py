"""The engine over order tables: a catalogue and one registered query per operator."""

from __future__ import annotations

import importlib

_MODULES = ("requests", "matrix", "intake", "lifecycle", "files", "warehouse")


def load_queries() -> None:
    """Import every module that registers queries."""
    for module in _MODULES:
        importlib.import_module(f"cellframe.retail.{module}")
