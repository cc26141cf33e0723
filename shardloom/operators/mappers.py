"""Row transforms. A mapper that can't work on a row, where it is strict, leaves it to the error policy."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions.ordering import order_key, uniform_int
from shardloom.functions.paths import nested
from shardloom.operators import tensors
from shardloom.operators.base import URL, AbstractMapper, as_list, require
from shardloom.operators.errors import by_value, fail_if, profiled
from shardloom.plans.config import make_callable

__all__ = ["AbstractMapper", "AddOriginalImageSizeAsTupleAndCropToSquare", "BatchedEinopsTransform", "ImageTransforms", "LambdaMapper", "Rescaler"]


def _has_shape(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"shape", "data"} <= set(kind.names)


class LambdaMapper(AbstractMapper):
    """Replaces each key by ``fn`` of it. A row without a key is an error.

    ``fn`` takes a Column and gives one; or, if ``returns`` names a type, it takes a value and gives one of
    that type, in Python. Errors of such calls, and calls of over ``timeout`` seconds, are left to the
    error policy. With SAMPLE_PROFILE set, their seconds are in ``LambdaMapper-time``.
    """

    def __init__(self, keys: str | Sequence[str], fn: Callable[[Any], Any] | Mapping[str, Any], returns: str | None = None, **how: Any) -> None:
        super().__init__(**how)
        self.keys, self.fn, self.returns = as_list(keys), make_callable(fn) if isinstance(fn, Mapping) else fn, returns

    def columns(self, df: DataFrame) -> dict[str, Column]:
        require(df, self.keys)
        return {k: F.when(F.col(k).isNotNull(), self.fn(F.col(k))) for k in self.keys}

    def apply(self, df: DataFrame) -> DataFrame:
        require(df, self.keys)
        for key in self.keys:
            df = fail_if(df, F.col(key).isNull() & ~self.skipped(df), f"KeyError: {key}")
        if self.returns is None:
            return super().apply(df)
        call, total = by_value(self.fn, self.returns, self.timeout, "LambdaMapper"), F.lit(0.0)
        for k, key in enumerate(self.keys):
            active = ~self.skipped(df) & F.col(key).isNotNull()
            df = fail_if(df.withColumn(f"_call{k}", F.when(active, call(F.col(key)))), F.col(f"_call{k}.error").isNotNull(), F.col(f"_call{k}.error"))
            total = total + F.coalesce(F.col(f"_call{k}.seconds"), F.lit(0.0))
            skipped = F.col(key).try_cast(self.returns) if self.exclude_keys else F.lit(None)
            df = df.withColumn(key, F.when(F.col(f"_call{k}").isNotNull(), F.col(f"_call{k}.value")).otherwise(skipped))
        if profiled():
            df = df.withColumn("LambdaMapper-time", total)
        return df.drop(*[f"_call{k}" for k in range(len(self.keys))])


class Rescaler(AbstractMapper):
    """Moves values to -1 .. 1: those of 0 .. 1 (``isfloat``), or those of 0 .. 255.

    Of several keys, a row must have exactly one. ``strict``: none or several are errors; else such
    rows stay as they are. Values are numbers, arrays, or tensors.
    """

    def __init__(self, key: str | Sequence[str] = "jpg", isfloat: bool = True, strict: bool = True, **how: Any) -> None:
        super().__init__(**how)
        self.keys, self.isfloat, self.strict = as_list(key), isfloat, strict

    def scaled(self, x: Column) -> Column:
        x = x.cast("double")
        return x * 2.0 - 1.0 if self.isfloat else x / 127.5 - 1.0

    def columns(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        present = [k for k in self.keys if k in df.columns]
        one = self._matches(df) == 1
        for key in present:
            kind, c = df.schema[key].dataType, F.col(key)
            if _has_shape(kind):
                new = F.struct(c["shape"].alias("shape"), F.transform(c["data"], lambda x: self.scaled(x)).alias("data"))
            elif isinstance(kind, T.ArrayType):
                new = F.transform(c, lambda x: self.scaled(x))
            else:
                new = self.scaled(c)
            old = c.cast(_as_double(kind))
            out[key] = F.when(one & c.isNotNull(), new).otherwise(old)
        return out

    def _matches(self, df: DataFrame) -> Column:
        total = F.lit(0)
        for key in self.keys:
            if key in df.columns:
                total = total + F.col(key).isNotNull().cast("int")
        return total

    def apply(self, df: DataFrame) -> DataFrame:
        if self.strict:
            n = self._matches(df)
            active = ~self.skipped(df)
            df = fail_if(df, (n == 0) & active, f"KeyError: none of {', '.join(self.keys)}")
            df = fail_if(df, (n > 1) & active, f"ValueError: several of {', '.join(self.keys)}")
        elif not any(k in df.columns for k in self.keys):
            warnings.warn(f"none of {', '.join(self.keys)} is there; nothing is rescaled", stacklevel=2)
        new, skip = self.columns(df), self.skipped(df)
        if self.exclude_keys:
            new = {k: F.when(~skip, c).otherwise(F.col(k).cast(_as_double(df.schema[k].dataType))) for k, c in new.items()}
        return df.withColumns(new)


def _as_double(kind: T.DataType) -> T.DataType:
    if _has_shape(kind):
        return T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])
    return T.ArrayType(T.DoubleType()) if isinstance(kind, T.ArrayType) else T.DoubleType()


class ImageTransforms(AbstractMapper):
    """A chain of image operations on a tensor column: names of :mod:`tensors`, or configurations of them.

    ``strict``: rows without the key are dropped; else they stay.
    """

    def __init__(self, transforms: Sequence[Any] | Any, key: str = "jpg", strict: bool = True, **how: Any) -> None:
        super().__init__(**how)
        chain = transforms if isinstance(transforms, list | tuple) else [transforms]
        self.steps, self.key, self.strict = [tensors.image_step(t) for t in chain], key, strict

    def columns(self, df: DataFrame) -> dict[str, Column]:
        require(df, [self.key])
        return {self.key: tensors.tensor_udf(tensors.chained(self.steps))(tensors.as_tensor(df, self.key))}

    def apply(self, df: DataFrame) -> DataFrame:
        if self.key not in df.columns:
            return df.limit(0) if self.strict else df
        if self.strict:
            df = df.filter(F.col(self.key).isNotNull() | self.skipped(df))
        if not self.exclude_keys:
            return super().apply(df)
        new = self.columns(df)[self.key]
        return df.withColumn(self.key, F.when(~self.skipped(df), new).otherwise(tensors.as_tensor(df, self.key)))


class AddOriginalImageSizeAsTupleAndCropToSquare(AbstractMapper):
    """Adds ``original_size_as_tuple`` [height, width] and ``crop_coords_top_left`` [top, left], and crops to a square.

    The square has the shorter side; its place is drawn from the seed and the row's key. The original
    size is read from ``data_key`` (a VARIANT or a struct), or from columns (``use_data_key=False``). An image is a
    CHW tensor of 1 or 3 channels; without an image column, ``height_col`` and ``width_col`` give its size
    and only the coordinates are made.
    """

    def __init__(
        self, h_key: str = "original_height", w_key: str = "original_width", image_key: str | None = "jpg", use_data_key: bool = True, data_key: str = "json", seed: int = 0, row_key: str = "__key__", height_col: str | None = None, width_col: str | None = None, **how: Any
    ) -> None:
        super().__init__(**how)
        self.h_key, self.w_key, self.image_key, self.use_data_key, self.data_key = h_key, w_key, image_key, use_data_key, data_key
        self.seed, self.row_key, self.height_col, self.width_col = seed, row_key, height_col, width_col

    def _original(self, df: DataFrame, key: str) -> Column:
        if not self.use_data_key:
            return F.col(key).cast("bigint")
        kind = df.schema[self.data_key].dataType
        return F.col(self.data_key)[key].cast("bigint") if isinstance(kind, T.StructType | T.MapType) else nested(self.data_key, key, "bigint")

    def columns(self, df: DataFrame) -> dict[str, Column]:
        shape = F.col(self.image_key)["shape"] if self.image_key else None
        height = (shape[1] if self.image_key else F.col(self.height_col)).cast("bigint")
        width = (shape[2] if self.image_key else F.col(self.width_col)).cast("bigint")
        side = F.least(height, width)
        top = uniform_int(order_key(self.seed, self.row_key, F.lit("top")), height - side)
        left = uniform_int(order_key(self.seed, self.row_key, F.lit("left")), width - side)
        out = {
            "original_size_as_tuple": F.array(self._original(df, self.h_key), self._original(df, self.w_key)),
            "crop_coords_top_left": F.array(top, left),
        }
        if self.image_key:
            image = tensors.as_tensor(df, self.image_key)
            out[self.image_key] = tensors.crop_udf(image, top, left, side)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        if self.image_key:
            require(df, [self.image_key])
            channels = F.col(self.image_key)["shape"][0]
            active = ~self.skipped(df)
            df = fail_if(df, F.col(self.image_key).isNull() & active, f"KeyError: {self.image_key}")
            df = fail_if(df, ~channels.isin(1, 3) & active, f"ValueError: {self.image_key} must have 1 or 3 channels")
            df = df.withColumn(self.image_key, tensors.as_tensor(df, self.image_key))
        return super().apply(df)


class BatchedEinopsTransform(AbstractMapper):
    """Rearranges, repeats or reduces a tensor column by a pattern, as ``b h w c -> b c h w``."""

    def __init__(self, pattern: str, key: str, mode: str = "rearrange", reduction: str = "mean", axes: Mapping[str, int] | None = None, **how: Any) -> None:
        super().__init__(**how)
        self.fn, self.key = tensors.einops(pattern, mode, reduction, dict(axes or {})), key

    def columns(self, df: DataFrame) -> dict[str, Column]:
        require(df, [self.key])
        return {self.key: tensors.tensor_udf(self.fn)(tensors.as_tensor(df, self.key))}

    def apply(self, df: DataFrame) -> DataFrame:
        require(df, [self.key])
        return super().apply(df.withColumn(self.key, tensors.as_tensor(df, self.key)))
