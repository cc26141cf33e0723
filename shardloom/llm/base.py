"""Helpers shared by the operators: shared storage, worker imports, hashing."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.session import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the session fit for these operators: a checkpoint folder, and workers that can import them.

    The checkpoint folder is the session's own (``spark.checkpoint.dir``). Where that is unset, a
    temporary one takes its place on a single machine, as in tests; on a cluster it is an error, as
    executors and driver share no such folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="shardloom-")
        sc.setCheckpointDir(folder)
    return ship(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder; executors may be lost afterwards."""
    release(prepare(df.sparkSession))
    return df.checkpoint(eager=True)


#: Seconds between two releases at least, and when the last one was.
RELEASE_S = 5
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Has the files of shuffles removed that no DataFrame needs any more.

    Spark removes them when the driver's JVM finds their plans to be garbage. A driver that has memory to
    spare may not look for hours, and the shuffles of all steps add up on the disk meanwhile.
    """
    if time.monotonic() - _released[0] >= RELEASE_S:
        gc.collect()  # plans that only cycles of Python objects hold
        spark._jvm.System.gc()
        _released[0] = time.monotonic()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case of its letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_fraction(text: Column) -> Column:
    """A reproducible number from 0 up to 1, from the first 13 hex digits (52 bits) of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn labels from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def nth_of(keys: list[str], repeated: Column, columns: list[Column]) -> Column:
    """The place of a row among those with its ``keys``, from 1, by its ``columns`` as text; 1 where it isn't ``repeated``.

    So the same row is first whatever the partitions, and rows that tie don't differ at all.
    """
    order = F.when(repeated, F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)])))
    return F.when(repeated, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).otherwise(1)
