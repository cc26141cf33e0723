"""Names of shards, members, samples and fields, as Column expressions.

A member's path is ``<shard>/<inner folders>/<key>.<field>``: the key ends at the first dot of the base
name, the field is all that follows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def is_tar(path: Column | str) -> Column:
    """Case matters, and ``.tar.gz`` is none."""
    return F.endswith(_col(path), F.lit(".tar"))


def sample_key(path: Column | str) -> Column:
    return F.substring_index(basename(path), ".", 1)


def field_name(path: Column | str) -> Column:
    """Empty for a base name without a dot."""
    base = basename(path)
    return F.when(F.contains(base, F.lit(".")), F.substr(base, F.length(sample_key(path)) + 2)).otherwise("")


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def shard_key(path: Column | str) -> Column:
    """The path without its last extension; leading dots of the base name begin none."""
    return F.regexp_replace(_col(path), r"(?<=[^/.])\.[^./]*$", "")


def sidecar_key(path: Column | str, suffix: str) -> Column:
    """The main shard's key for a shard of the sidecar ``suffix``."""
    return shard_key(F.replace(_col(path), F.lit(f"_{suffix}"), F.lit("")))


def last_extension(name: Column | str) -> Column:
    """The last extension of a field, which may have several."""
    return F.substring_index(_col(name), ".", -1)


def mentions(url: Column | str, words: list[str]) -> Column:
    """True where any of ``words`` is a part of the url; false if there are none, or the url is null."""
    found = F.lit(False)
    for word in words:
        found = found | F.coalesce(F.contains(_col(url), F.lit(word)), F.lit(False))
    return found


def nested(column: Column | str, key: str, as_type: str) -> Column:
    """A key of a VARIANT, struct-free JSON value; null where it is missing or of another type."""
    return F.try_variant_get(_col(column), f"$.{key}", as_type)
