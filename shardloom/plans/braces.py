"""Shard names by range: ``name-{0000..0099}.tar``."""

from __future__ import annotations

import re

_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")


def expand(spec: str) -> list[str]:
    """All names of a spec; several ranges make all combinations, the first changing slowest.

    The lower number must be below the upper. Numbers are padded with zeros if both have as many digits
    and the lower begins with 0; one that begins with 0 and has fewer digits than the upper, or more, is
    an error.
    """
    found = _RANGE.search(spec)
    if not found:
        return [spec]
    low, high = found.groups()
    if len(low) > len(high) or (low[0] == "0" and len(low) > 1 and len(low) != len(high)):
        raise ValueError(f"{found[0]}: numbers of unequal length")
    if int(low) >= int(high):
        raise ValueError(f"{found[0]}: the first number must be less than the last")
    width = len(low) if low[0] == "0" and len(low) == len(high) else 0
    rest = expand(spec[found.end() :])
    return [f"{spec[: found.start()]}{k:0{width}d}{tail}" for k in range(int(low), int(high) + 1) for tail in rest]


def check(urls: list[str]) -> bool:
    """Whether the urls are specs. If one is, all must be, with one range each."""
    marked = ["{" in u or "}" in u for u in urls]
    if not any(marked):
        return False
    for u in urls:
        if u.count("{") != 1 or u.count("}") != 1 or not _RANGE.search(u):
            raise ValueError(f"{u}: expected one range {{low..high}}, as another url has one")
    return True
