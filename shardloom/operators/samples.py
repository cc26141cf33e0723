"""Samples from members, and samples joined with their sidecars'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.paths import dirname, field_name, last_extension, sample_key


def assemble(members: DataFrame, scope: str = "shard") -> DataFrame:
    """Groups members (shard, member, pos, content) into samples (shard, __key__, __url__, fields).

    The last of a field counts. ``scope``: samples of the same key in several shards are several
    (``shard``) or one (``global``). The tar source can do this without a shuffle (mode ``samples``).
    """
    rows = members.select("shard", "pos", sample_key("member").alias("__key__"), dirname("member").alias("__url__"), field_name("member").alias("field"), "content")
    keys = ["shard", "__key__"] if scope == "shard" else ["__key__"]
    order = F.struct("shard", "pos")
    one = rows.groupBy(*keys, "field").agg(F.max_by("content", order).alias("content"), F.min_by("__url__", order).alias("__url__"), F.min(order).alias("first"))
    out = one.groupBy(*keys).agg(F.min_by("__url__", "first").alias("__url__"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "content")))).alias("fields"), F.min("first").alias("__first"))
    return out.select(F.col("__first")["shard"].alias("shard"), "__key__", "__url__", F.col("__first")["pos"].alias("pos"), "fields")


def group_members(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Members of each key as a list of structs, in the order of a column."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order), *columns)))
    return df.groupBy(key).agg(items.alias("members"))


def merge_fields(main: Column, meta: Column, suffix: str) -> Column:
    """One map of fields; a sidecar's field whose last extension the sample has is renamed by the suffix.

    ``json`` becomes ``<suffix>.json``, ``seg.png`` becomes ``seg<suffix>.png``.
    """
    taken = F.transform(F.map_keys(main), last_extension)

    def renamed(name: Column, _: Column) -> Column:
        last = last_extension(name)
        stem = F.substr(name, F.lit(1), F.length(name) - F.length(last) - 1)
        new = F.when(F.contains(name, F.lit(".")), F.concat(stem, F.lit(f"{suffix}."), last)).otherwise(F.concat(F.lit(f"{suffix}."), last))
        return F.when(F.array_contains(taken, last), new).otherwise(name)

    other = F.transform_keys(meta, renamed)
    twice = F.array_intersect(F.map_keys(main), F.map_keys(other))
    return F.map_concat(F.map_filter(main, lambda k, _: ~F.array_contains(twice, k)), other)


def join_sidecar(main: DataFrame, meta: DataFrame, suffix: str, on: tuple[str, ...] = ("shard_key", "__key__"), on_missing: str = "drop") -> DataFrame:
    """Samples with their sidecar's fields; samples without one are dropped, or fail the job (``error``)."""
    other = meta.select(*on, F.col("fields").alias("__meta"))
    out = main.join(other, list(on), "left" if on_missing == "error" else "inner")
    if on_missing == "error":
        out = out.filter(F.when(F.col("__meta").isNull(), F.raise_error(F.concat(F.lit("no sidecar for "), F.col("__key__"))).cast("boolean")).otherwise(True))
    return out.withColumn("fields", merge_fields(F.col("fields"), F.col("__meta"), suffix)).drop("__meta")


def unzip(manifest: DataFrame, n: int) -> list[DataFrame]:
    """The main shards and those of each sidecar, from manifests of path lists."""
    return [manifest.withColumn("path", F.col("paths")[k]).drop("paths") for k in range(n)]
