"""Datasets and loaders from configurations."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.ordering import order_key
from shardloom.functions.paths import shard_key, sidecar_key
from shardloom.operators import batching, decode, errors, samples
from shardloom.operators.base import AbstractFilter, AbstractMapper, Operator, as_list
from shardloom.plans import config, manifest
from shardloom.session import ship
from shardloom.sources.loader import Loader
from shardloom.sources.tarshards import read_tars

Step = Operator | Callable[[DataFrame], DataFrame]

#: Different fields that a dataset may find by itself.
MOST_FIELDS = 1000


def steps_of(configs: Iterable[Any] | None) -> list[Operator]:
    """Filters and mappers of a list of them or of their configurations."""
    out = []
    for c in configs or []:
        step = config.instantiate(c) if config.is_config(c) else c
        if not isinstance(step, AbstractFilter | AbstractMapper):
            raise TypeError(f"neither filter nor mapper: {step!r}")
        out.append(step)
    return out


def apply_steps(df: DataFrame, steps: Iterable[Operator], policy: str) -> DataFrame:
    """Errors of mappers follow the policy; filters always fail the job, but for what they tolerate themselves."""
    for step in steps:
        with errors.on_error(policy if isinstance(step, AbstractMapper) else "fail"):
            df = step.apply(df)
    return df


class Dataset:
    """Samples of tar shards, as a DataFrame per epoch."""

    def __init__(self, spark: SparkSession, urls: str | Sequence[str], pipeline: Mapping[str, Any], fields: Sequence[str] | None, decoders: Any, decoder_kwargs: Mapping[str, Any], pre: list[Operator], post: list[Operator], policy: str) -> None:
        self.spark, self.urls, self.fields, self.decoders, self.decoder_kwargs = spark, manifest.roots_of(urls), fields, decoders, dict(decoder_kwargs)
        self.pre, self.post, self.policy = pre, post, policy
        p = dict(pipeline)
        self.meta_urls = as_list(p.pop("meta_urls", None))
        self.repeat = p.pop("repeat", None)
        self.shardshuffle, self.sample_shuffle = p.pop("shardshuffle", 10_000), p.pop("sample_shuffle", 1)
        self.resample, self.shares = p.pop("resample_prefixes", False), p.pop("prefix_probs", None)
        self.split, self.workers = p.pop("split_data_by_worker", True), max(1, p.pop("num_workers", 1))
        self.world, self.rank = p.pop("world_size", 1), p.pop("rank", None)
        self.seed, self.sampler = p.pop("seed", 0), p.pop("tar_sampler", None)
        for unused in ("metadata_buffer_size", "n_shards", "handler", "debug"):
            if p.pop(unused, None) is not None:
                warnings.warn(f"{unused} has no effect: shards are joined and shuffled without buffers, errors follow error_handler", stacklevel=3)
        if p:
            raise TypeError(f"unknown settings: {', '.join(p)}")
        if isinstance(self.sampler, Mapping):
            self.sampler = config.make_callable(self.sampler)
        prefixes = [manifest.prefix_of(u) for u in self.urls]
        if self.resample and (len(set(prefixes)) < len(prefixes) or manifest.ambiguous(prefixes)):
            raise ValueError("prefixes must be distinct, and none may begin with another")

    def shards(self, epoch: int = 0) -> DataFrame:
        """The manifest of an epoch: shard_key, paths, prefix, pos, rank, worker."""
        out = manifest.as_manifest(manifest.list_shards(self.spark, self.urls, self.sampler))
        if self.meta_urls:
            out = manifest.with_sidecars(self.spark, out, self.urls, self.meta_urls, self.sampler)
        seed = self.seed + epoch
        if self.resample:
            out = manifest.resampled(out, [manifest.prefix_of(u) for u in self.urls], self.shares, seed)
        elif self.shardshuffle > 1:
            out = manifest.shuffled(out, seed)
        else:
            out = manifest.listed_order(out)
        out = manifest.for_rank(out, self.world, self.rank)
        return manifest.for_workers(out, self.workers) if self.split else manifest.for_every_worker(out, self.workers, seed)

    def raw(self, epoch: int = 0) -> DataFrame:
        """Samples before decoding: the manifest's columns, __key__, __url__, fields, and their order."""
        shards = self.shards(epoch).withColumnRenamed("pos", "shard_pos")
        rows = shards.collect()  # names of shards; their bytes are read by the tasks
        skip = "skip" if self.policy != "fail" else "fail"
        found = read_tars(self.spark, sorted({r.paths[0] for r in rows}), "samples", self._read(), skip)
        found = found.select("shard", "__key__", "__url__", "pos", "fields", F.col("error").alias(errors.ERROR))
        # Under ``mark``, a broken shard is a row of its own, without a key.
        found = found if self.policy == "mark" and not self.meta_urls else found.filter(F.col(errors.ERROR).isNull()).drop(errors.ERROR)
        out = shards.withColumn("shard", F.col("paths")[0]).join(found, "shard")
        for k, suffix in enumerate(self.meta_urls, 1):
            other = read_tars(self.spark, sorted({r.paths[k] for r in rows}), "samples", on_error=skip).filter("error is null")
            other = other.select(sidecar_key("shard", suffix).alias("shard_key"), "__key__", "fields")
            out = samples.join_sidecar(out.withColumn("shard_key", shard_key("shard")), other, suffix)
        return out.drop("paths")

    def _read(self) -> list[str] | None:
        """The fields whose bytes are needed, if that is known: those to decode, and those that what comes before looks at."""
        if self.fields is None or self.decoders is None or self.meta_urls or not all(hasattr(step, "keys") for step in self.pre):
            return None
        return sorted({*self.fields, *(key for step in self.pre for key in step.keys)})

    def _names(self, epoch: int) -> list[str]:
        """The fields there are: from the shards' headers, or of the samples where these have sidecars."""
        if self.meta_urls or self.pre:
            names = apply_steps(self.raw(epoch), self.pre, self.policy).select(F.explode(F.map_keys("fields")).alias("field"))
        else:
            paths = sorted({r.paths[0] for r in self.shards(epoch).select("paths").collect()})
            names = read_tars(self.spark, paths, "names", on_error="skip" if self.policy != "fail" else "fail").filter("field is not null").select("field")
        found = [r[0] for r in names.distinct().limit(MOST_FIELDS + 1).collect()]
        if len(found) > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} different fields; name those wanted in fields")
        return found

    def order(self, epoch: int = 0) -> list[Column]:
        if self.sample_shuffle > 1:
            return [order_key(self.seed + epoch, "shard", "__key__"), F.col("shard"), F.col("__key__")]
        return [F.col("shard_pos"), F.col("shard"), F.col("pos"), F.col("__key__")]

    def frame(self, epoch: int = 0) -> DataFrame:
        """Decoded and processed samples of an epoch."""
        df = apply_steps(self.raw(epoch), self.pre, self.policy)
        if self.decoders is not None:
            names = self._names(epoch) if self.fields is None else self.fields
            with errors.on_error(self.policy):
                df = decode.decode(df, sorted(names), *self.decoders, **self.decoder_kwargs)
        return apply_steps(df, self.post, self.policy)

    def __iter__(self) -> Any:
        return iter(Loader(lambda epoch: self.frame(epoch).orderBy(*self.order(epoch)), self.repeat))


def create_dataset(
    urls: str | Sequence[str],
    pipeline_config: Mapping[str, Any] | None = None,
    decoders: Any = "pil",
    additional_decoder_kwargs: Mapping[str, Any] | None = None,
    preprocessors: Sequence[Any] | None = None,
    postprocessors: Sequence[Any] | None = None,
    error_handler: Any = "skip",
    fields: Sequence[str] | None = None,
    spark: SparkSession | None = None,
) -> Dataset:
    """A dataset of tar shards.

    ``decoders``: names, handlers or configurations; None or an empty list decode nothing. ``fields``
    are those to make columns of, and the only ones read; without, shards' headers are looked through for
    them. ``error_handler``: ``skip`` drops samples that a mapper or decoder can't work on and what lies
    behind a break in a shard, ``fail`` stops, ``mark`` notes them in ``_error``.
    The caller's configurations are not changed.
    """
    if isinstance(error_handler, Mapping):
        error_handler = config.make_callable(error_handler).func
    handlers = decode.handlers_of(copy.copy(decoders))
    kwargs = {"partial": True, "strict": True, **dict(additional_decoder_kwargs or {})}
    if "passthrough_keys" in kwargs:
        kwargs["passthrough"] = kwargs.pop("passthrough_keys")
    return Dataset(ship(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()), urls, copy.copy(pipeline_config or {}), fields, handlers, kwargs, steps_of(preprocessors), steps_of(postprocessors), errors.named(error_handler))


def create_loader(
    datapipeline: Dataset | Mapping[str, Any],
    batch_size: int,
    num_workers: int = 0,
    partial: bool = False,
    collation_fn: Any = None,
    batched_transforms: Sequence[Any] | None = None,
    loader_kwargs: Mapping[str, Any] | None = None,
    error_handler: Any = "skip",
) -> Loader:
    """A loader of collated batches; each worker's samples are batched apart."""
    if isinstance(datapipeline, Mapping):
        datapipeline = create_dataset(**datapipeline["params"]) if "params" in datapipeline else config.instantiate(datapipeline)
    data = copy.copy(datapipeline)
    data.workers = max(1, num_workers)
    if isinstance(collation_fn, Mapping):
        collation_fn = config.make_callable(collation_fn)
    steps, policy = steps_of(batched_transforms), errors.named(error_handler)

    def make(epoch: int) -> DataFrame:
        df, inner = data.frame(epoch), {"shard_pos", "pos", "rank", "prefix", "prefix_no", "listed", "shard_key", "shard"}
        columns = [c for c in df.columns if c not in inner | {"worker"}]
        rows = batching.batched(df, batch_size, data.order(epoch), "worker", partial, collation_fn, columns)
        return apply_steps(rows, steps, policy).orderBy("batch", "worker")

    return Loader(make, data.repeat, **dict(loader_kwargs or {}))


def create_dummy_dataset(n: int = 1000, **dataset: Any) -> DataFrame:
    """The first sample of a dataset, ``n`` times, as a source for trying out what comes behind."""
    data = create_dataset(**dataset)
    return repeat_first(data.frame(), data.order(), n)


def repeat_first(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first row in some order, ``n`` times, numbered by ``copy``."""
    return df.orderBy(*order).limit(1).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
