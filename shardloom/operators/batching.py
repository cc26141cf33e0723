"""Batches: consecutive samples of a worker, collated into one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.operators.tensors import TENSOR

Collate = Callable[[DataFrame, list[str], list[str]], DataFrame]


def numbered(df: DataFrame, size: int, order: Sequence[Column | str], worker: str | None = "worker", drop_last: bool = True) -> DataFrame:
    """Adds ``batch`` and ``nth`` (from 0): each worker's rows in order, ``size`` at a time.

    ``drop_last`` leaves out a worker's rows behind its last full batch. A worker is one task's work, as
    in a loader of that many processes; without a worker column all rows are one's.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")
    by = [worker] if worker and worker in df.columns else []
    out = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    if drop_last:
        out = out.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("__rn") < F.col("__n") - F.col("__n") % size).drop("__n")
    return out.withColumn("batch", F.floor(F.col("__rn") / size)).withColumn("nth", (F.col("__rn") % size).cast("int")).drop("__rn")


def collate(df: DataFrame, keys: list[str], columns: list[str], combine_tensors: bool = True, combine_scalars: bool = True) -> DataFrame:
    """One row per batch; each column is the list of its rows' values, in order.

    A column that any row of a batch lacks is null for the batch. Tensors of one shape are stacked along
    a new first axis. ``combine_scalars=False`` leaves out columns of numbers, ``combine_tensors=False``
    those of tensors.
    """
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        tensor = isinstance(kind, T.StructType) and {"shape", "data"} == set(kind.names)
        number = isinstance(kind, T.NumericType | T.BooleanType)
        if (tensor and not combine_tensors) or (number and not combine_scalars):
            continue
        rows = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("nth", F.col(name).alias("v")))), lambda a, b: a["nth"] - b["nth"])
        values = F.transform(rows, lambda r: r["v"])
        if tensor:
            shapes = F.array_distinct(F.transform(values, lambda v: v["shape"]))
            stacked = F.struct(F.concat(F.array(F.size(values)), shapes[0]).cast("array<int>").alias("shape"), F.flatten(F.transform(values, lambda v: v["data"])).cast("array<double>").alias("data"))
            values = F.when(F.size(shapes) == 1, stacked).otherwise(F.raise_error(F.lit(f"{name}: tensors of unequal shapes")).cast(TENSOR))
        out.append(F.when(F.count(name) == F.count("*"), values).alias(name))
    return df.groupBy(*keys).agg(F.count("*").cast("int").alias("batch_size"), *out)


def batched(df: DataFrame, size: int, order: Sequence[Column | str], worker: str | None = "worker", partial: bool = False, collation: Collate | None = None, columns: Sequence[str] | None = None, **how: Any) -> DataFrame:
    """Numbers rows and collates them; the tail is kept if ``partial``.

    ``collation``: a function of (numbered rows, keys, columns) in place of :func:`collate`; it may use
    ``groupBy(keys).applyInPandas``.
    """
    rows = numbered(df, size, order, worker, drop_last=not partial)
    keys = [k for k in (worker, "batch") if k and k in rows.columns]
    names = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    return (collation or collate)(rows, keys, names, **how)
