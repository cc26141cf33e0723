"""A training-sample pipeline engine on PySpark."""

from __future__ import annotations

import importlib
from typing import Any

_WHERE = {
    "create_dataset": "shardloom.api",
    "create_dummy_dataset": "shardloom.api",
    "create_loader": "shardloom.api",
    "filters": "shardloom.operators",
    "mappers": "shardloom.operators",
    "warn_and_continue": "shardloom.operators.errors",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    """Names are imported when they are asked for, so that workers load only what they run."""
    if name not in _WHERE:
        raise AttributeError(name)
    if name in ("filters", "mappers"):
        return importlib.import_module(f"{_WHERE[name]}.{name}")
    return getattr(importlib.import_module(_WHERE[name]), name)
