"""Operators from configurations: ``{target: a name, params: {...}}``."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from typing import Any

#: Values that stand for no operator (fixed values of the configuration format).
NOTHING = ("__is_first_stage__", "__is_unconditional__")

#: Modules (and what is below them) that a dotted target may come from.
ALLOWED = {"shardloom"}

_known: dict[str, Callable[..., Any]] = {}


def register(name: str, target: Callable[..., Any] | None = None) -> Callable[..., Any]:
    """Makes a class or function known by a short name; as a decorator without ``target``."""
    if target is None:
        return lambda x: register(name, x)
    _known[name] = target
    return target


def find(target: str, reload: bool = False) -> Any:
    """What a short name or an allowed dotted path stands for."""
    if target in _known:
        return _known[target]
    module, _, name = target.rpartition(".")
    if not module:
        raise KeyError(f"unknown target {target}")
    if module.split(".")[0] not in ALLOWED and module not in ALLOWED:
        raise PermissionError(f"{module} isn't allowed; see shardloom.plans.config.ALLOWED")
    found = importlib.import_module(module)
    if reload:
        found = importlib.reload(found)
    return getattr(found, name)


def is_config(x: Any) -> bool:
    return isinstance(x, Mapping)


def instantiate(config: Any) -> Any:
    """The object that a configuration describes; None for the values that stand for nothing."""
    if config in NOTHING if isinstance(config, str) else False:
        return None
    if not isinstance(config, Mapping) or "target" not in config:
        raise KeyError("a configuration needs a target")
    return find(config["target"])(**dict(config.get("params") or {}))


def make_callable(config: Mapping[str, Any]) -> Callable[..., Any]:
    """The target with its parameters bound, not called yet."""
    from functools import partial

    if "target" not in config:
        raise KeyError("a configuration needs a target")
    return partial(find(config["target"]), **dict(config.get("params") or {}))
