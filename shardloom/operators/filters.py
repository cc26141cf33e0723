"""Row predicates. A key that a sample doesn't have is a null."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators import errors
from shardloom.operators.base import URL, AbstractFilter, as_list, require
from shardloom.plans.config import make_callable

__all__ = ["AbstractFilter", "LambdaFilter", "SimpleKeyFilter", "SimpleSizeFilter"]


class LambdaFilter(AbstractFilter):
    """Keeps rows for which ``fn`` is true of every key. A row without a key fails the job.

    ``fn`` takes a Column and gives a boolean one, or, if ``python``, it takes a value and gives a bool;
    an error of such a call fails the job, as does a call of over ``timeout`` seconds.
    """

    def __init__(self, keys: str | Sequence[str], fn: Callable[[Any], Any] | Mapping[str, Any], exclude_keys: str | Sequence[str] | None = None, verbose: bool = False, url_col: str = URL, python: bool = False, timeout: float | None = None) -> None:
        super().__init__(exclude_keys, verbose, url_col)
        self.keys, self.fn = as_list(keys), make_callable(fn) if isinstance(fn, Mapping) else fn
        if python:
            call = errors.by_value(self.fn, "boolean", timeout, "LambdaFilter")

            def checked(c: Column) -> Column:
                out = call(c)
                return F.when(out["error"].isNotNull(), F.raise_error(out["error"]).cast("boolean")).otherwise(out["value"])

            self.fn = checked

    def predicate(self, df: DataFrame) -> Column:
        require(df, self.keys)
        out = F.lit(True)
        for key in self.keys:
            missing = F.raise_error(F.lit(f"KeyError: {key}")).cast("boolean")
            out = out & F.when(F.col(key).isNull(), missing).otherwise(F.coalesce(self.fn(F.col(key)).cast("boolean"), F.lit(False)))
        return out


class SimpleKeyFilter(AbstractFilter):
    """Keeps rows that have all keys. Keys of a raw sample are looked up in its map of fields."""

    def __init__(self, keys: str | Sequence[str], exclude_keys: str | Sequence[str] | None = None, verbose: bool = False, url_col: str = URL, fields_col: str = "fields") -> None:
        super().__init__(exclude_keys, verbose, url_col)
        self.keys, self.fields_col = as_list(keys), fields_col

    def predicate(self, df: DataFrame) -> Column:
        out = F.lit(True)
        for key in self.keys:
            if key in df.columns:
                out = out & F.col(key).isNotNull()
            elif self.fields_col in df.columns:
                out = out & F.map_contains_key(self.fields_col, F.lit(key))
            else:
                return F.lit(False)
        return out


class SimpleSizeFilter(AbstractFilter):
    """Keeps rows of a height and width of at least (``min``) or at most (``max``) ``size``, both included.

    ``size``: a number, or (height, width). Where a size is missing or no number, ``strict`` drops the
    row and ``strict=False`` keeps it; a mapping says so by what the url mentions, its first match counts,
    and without one ``on_no_match`` decides: ``fail`` the job, ``keep`` or ``drop``.
    """

    def __init__(
        self,
        size: int | Sequence[int],
        mode: str = "min",
        strict: bool | Mapping[str, bool] | None = None,
        width_key: str = "original_width",
        height_key: str = "original_height",
        exclude_keys: str | Sequence[str] | None = None,
        verbose: bool = False,
        url_col: str = URL,
        on_no_match: str = "fail",
    ) -> None:
        super().__init__(exclude_keys, verbose, url_col)
        if strict is None or not isinstance(strict, bool | Mapping):
            raise TypeError("strict: a bool, or a mapping from parts of urls to bools")
        if mode not in ("min", "max"):
            raise ValueError("mode: 'min' or 'max'")
        if on_no_match not in ("fail", "keep", "drop"):
            raise ValueError("on_no_match: 'fail', 'keep' or 'drop'")
        self.size = [size, size] if isinstance(size, int | float) else list(size)
        if len(self.size) < 2:
            raise ValueError("size: one number, or height and width")
        self.mode, self.strict, self.width_key, self.height_key, self.on_no_match = mode, dict(strict) if isinstance(strict, Mapping) else strict, width_key, height_key, on_no_match

    def _number(self, df: DataFrame, key: str) -> Column:
        if key not in df.columns:
            return F.lit(None).cast("double")
        kind = df.schema[key].dataType.typeName()
        plain = kind in ("byte", "short", "integer", "long", "float", "double", "decimal")
        return F.col(key) if plain else F.col(key).try_cast("double")

    def predicate(self, df: DataFrame) -> Column:
        h, w = self._number(df, self.height_key), self._number(df, self.width_key)
        fits = (h >= self.size[0]) & (w >= self.size[1]) if self.mode == "min" else (h <= self.size[0]) & (w <= self.size[1])
        if self.strict is True:
            return fits  # null drops, and the scan takes the predicate
        missing = h.isNull() | w.isNull()
        if self.strict is False:
            return fits | missing
        rest = {"fail": F.raise_error(F.concat(F.lit("no entry of strict for "), F.coalesce(F.col(self.url_col), F.lit("null")))).cast("boolean"), "keep": F.lit(True), "drop": F.lit(False)}[self.on_no_match]
        for part, strict in reversed(self.strict.items()):
            rest = F.when(F.contains(F.col(self.url_col), F.lit(part)), F.lit(not strict)).otherwise(rest)
        return F.when(missing, rest).otherwise(fits)
