"""What filters and mappers have in common: a DataFrame in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions.paths import mentions

URL = "__url__"


def as_list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class Operator:
    """``exclude_keys``: rows whose url mentions one of them are left alone.

    On a batch the url column is a list; there a batch is left alone if a key equals one of its urls.
    """

    def __init__(self, exclude_keys: str | Sequence[str] | None = None, verbose: bool = False, url_col: str = URL) -> None:
        self.exclude_keys, self.verbose, self.url_col = as_list(exclude_keys), verbose, url_col

    def skipped(self, df: DataFrame) -> Column:
        if not self.exclude_keys:
            return F.lit(False)
        if self.url_col not in df.columns:
            raise ValueError(f"exclude_keys need the column {self.url_col}")
        if isinstance(df.schema[self.url_col].dataType, T.ArrayType):
            return F.coalesce(F.arrays_overlap(self.url_col, F.array(*map(F.lit, self.exclude_keys))), F.lit(False))
        return mentions(self.url_col, self.exclude_keys)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class AbstractFilter(Operator):
    """Keeps rows where :meth:`predicate` is true, and those it leaves alone."""

    def predicate(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        keep = self.predicate(df)
        return df.filter(self.skipped(df) | keep if self.exclude_keys else keep)


class AbstractMapper(Operator):
    """Sets the columns that :meth:`columns` gives, except in rows it leaves alone.

    ``timeout`` is accepted for configurations' sake; expressions on executors' JVMs need none.
    """

    def __init__(self, exclude_keys: str | Sequence[str] | None = None, timeout: float | None = None, verbose: bool = False, url_col: str = URL) -> None:
        super().__init__(exclude_keys, verbose, url_col)
        self.timeout = timeout

    def columns(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        new, skip = self.columns(df), self.skipped(df)
        if self.exclude_keys:
            new = {k: F.when(~skip, c).otherwise(F.col(k)) if k in df.columns else F.when(~skip, c) for k, c in new.items()}
        return df.withColumns(new)


def require(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises KeyError for columns that aren't there at all."""
    missing = [k for k in keys if k.split(".")[0] not in df.columns]
    if missing:
        raise KeyError(f"no such key: {', '.join(missing)}")
