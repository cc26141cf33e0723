"""Files of samples that arrive over time, through the same filters and mappers.

Filters and mappers are plain DataFrame transforms, so they work on streams too; batches need an end,
so they are made of each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.base import Operator
from shardloom.operators.batching import batched


def arriving(spark: SparkSession, path: str, schema: Any, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Rows of files as they come into a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def processed(stream: DataFrame, steps: Iterable[Operator]) -> DataFrame:
    for step in steps:
        stream = step.apply(stream)
    return stream


def write_batches(stream: DataFrame, out: str, checkpoint: str, size: int, order: Sequence[Column | str], worker: str | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Collated batches of each micro-batch, written once: a micro-batch that is run again replaces its own folder."""

    def write(df: DataFrame, epoch: int) -> None:
        rows = batched(df, size, order, worker, partial=True)
        if sink:
            sink(rows, epoch)
        else:
            rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
