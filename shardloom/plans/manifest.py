"""Manifests: DataFrames of shards (shard_key, paths, prefix, pos), before a byte of them is read.

Shards are listed on the driver, as any file source lists files; everything else is DataFrame work.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.functions.ordering import local_draw, order_key
from shardloom.functions.paths import is_tar, shard_key, sidecar_key
from shardloom.plans import braces

SCHEMA = "path string, prefix string, prefix_no int, listed bigint"


def roots_of(urls: str | Sequence[str]) -> list[str]:
    if isinstance(urls, str):
        return [urls]
    if not isinstance(urls, list | tuple) or not all(isinstance(u, str) for u in urls):
        raise TypeError("urls: a path, or a list of paths")
    return list(urls)


def prefix_of(url: str) -> str:
    """What all shards of a url begin with: its folder before a range, or itself."""
    return posixpath.dirname(url.split("{")[0]) if "{" in url else url


def _files(spark: SparkSession, root: str) -> list[str]:
    """Files below a folder, sorted, by the file system that Spark has for it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    found, each = [], fs.listFiles(path, True)
    scheme = "://" in root
    while each.hasNext():
        file = each.next().getPath()
        found.append(file.toString() if scheme else file.toUri().getPath())
    return sorted(found)


def list_shards(spark: SparkSession, urls: str | Sequence[str], sampler: Callable[[Column], Column] | None = None) -> DataFrame:
    """Shards of all urls: (path, prefix, prefix_no, listed), in the order of urls and names.

    A url is a folder, searched to any depth for ``*.tar``, or a spec with a range, whose names are taken
    as they are. ``sampler`` takes the path column and says which shards count.
    """
    roots = roots_of(urls)
    ranged = braces.check(roots)
    rows = []
    for k, url in enumerate(roots):
        for path in braces.expand(url) if ranged else _files(spark, url):
            rows.append((path, prefix_of(url), k, len(rows)))
    out = spark.createDataFrame(rows, SCHEMA)
    out = out if ranged else out.filter(is_tar("path"))
    return out.filter(sampler(F.col("path"))) if sampler else out


def as_manifest(shards: DataFrame) -> DataFrame:
    return shards.select(shard_key("path").alias("shard_key"), F.array("path").alias("paths"), "prefix", "prefix_no", "listed")


def sidecar_url(url: str, suffix: str) -> str:
    """Where the sidecar shards of a url are: its parent folder's name gets the suffix."""
    parent, name = os.path.split(url)
    return os.path.join(f"{parent}_{suffix}", name)


def semi_join(main: DataFrame, meta: DataFrame, key: str = "shard_key") -> DataFrame:
    """Rows of ``main`` whose key ``meta`` has. Spark broadcasts ``meta`` if it is small enough."""
    return main.join(meta.select(key).distinct(), key, "left_semi")


def zip_join(main: DataFrame, meta: DataFrame, key: str = "shard_key", path: str = "path") -> DataFrame:
    """Joins one to one by key; the sidecar's path is appended to ``paths``."""
    return main.join(meta.select(key, F.col(path).alias("__path")), key).withColumn("paths", F.array_append("paths", F.col("__path"))).drop("__path")


def with_sidecars(spark: SparkSession, manifest: DataFrame, urls: str | Sequence[str], suffixes: Sequence[str], sampler: Callable[[Column], Column] | None = None) -> DataFrame:
    """Only shards that all sidecars have, with the sidecars' paths behind the own."""
    metas = [list_shards(spark, [sidecar_url(u, s) for u in roots_of(urls)], sampler).withColumn("shard_key", sidecar_key("path", s)) for s in suffixes]
    for meta in metas:
        manifest = semi_join(manifest, meta)
    for meta in metas:
        manifest = zip_join(manifest, meta)
    return manifest


def shuffled(manifest: DataFrame, seed: int = 0, key: str = "shard_key", epoch: str | None = None) -> DataFrame:
    """Adds ``pos``, the place in a seeded order of all shards (of each epoch)."""
    parts = [F.col(epoch)] if epoch else []
    window = Window.partitionBy(*parts).orderBy(order_key(seed, *parts, F.col(key)), key)
    return manifest.withColumn("pos", F.row_number().over(window) - 1)


def listed_order(manifest: DataFrame, key: str = "listed") -> DataFrame:
    return manifest.withColumn("pos", F.row_number().over(Window.orderBy(key)) - 1)


def emissions(arrivals: Sequence[str], names: Sequence[str], shares: Sequence[float], seed: int) -> list[int]:
    """Which arrivals a weighted resampling gives out, in order, as indices.

    The k-th wanted prefix is drawn by ``shares``. Arrivals are awaited until one has the wanted prefix;
    then the oldest arrival of it that hasn't been given out goes. The rest of the pass is left over.
    """
    total = sum(shares)
    edges, acc = [], 0.0
    for s in shares[:-1]:
        acc += s / total
        edges.append(acc)

    def wanted(k: int) -> str:
        x = local_draw(seed, "draw", k)
        return names[next((i for i, edge in enumerate(edges) if x < edge), len(names) - 1)]

    by_name: dict[str, list[int]] = {n: [] for n in names}
    given: dict[str, int] = dict.fromkeys(names, 0)
    out: list[int] = []
    want = wanted(0)
    for i, name in enumerate(arrivals):
        by_name[name].append(i)
        if name == want:
            out.append(by_name[want][given[want]])
            given[want] += 1
            want = wanted(len(out))
    return out


def resampled(manifest: DataFrame, prefixes: Sequence[str], shares: Sequence[float] | None = None, seed: int = 0, key: str = "shard_key", prefix: str = "prefix", most: int = 1_000_000) -> DataFrame:
    """Shards given out by weight of their prefix, in a new order ``pos``.

    Without ``shares`` all prefixes weigh the same. The rule looks at shard after shard, so it runs on the
    driver, over names only; a manifest of more than ``most`` shards is an error.
    """
    shares = list(shares) if shares is not None else [1.0] * len(prefixes)
    if len(shares) != len(prefixes) or len(set(prefixes)) != len(prefixes):
        raise ValueError("prefixes must be distinct, with one share each")
    if any(s < 0 for s in shares) or not sum(shares) > 0:
        raise ValueError("shares: none below 0, and one above")
    spark = manifest.sparkSession
    ordered = manifest.select(F.row_number().over(Window.orderBy(order_key(seed, key), key)).alias("i"), F.col(prefix).alias("p"), F.col(key).alias("k"))
    rows = ordered.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} shards")
    if odd := {r.p for r in rows} - set(prefixes):
        raise ValueError(f"shards of no known prefix: {sorted(map(str, odd))[:3]}")
    rows.sort(key=lambda r: r.i)
    chosen = emissions([r.p for r in rows], prefixes, shares, seed)
    kind = manifest.schema[key].dataType.simpleString()
    order = spark.createDataFrame([(rows[i].k, pos) for pos, i in enumerate(chosen)], f"`{key}` {kind}, pos bigint")
    return manifest.drop("pos").join(order, key)


def ambiguous(prefixes: Sequence[str]) -> bool:
    """Whether a name may have two of the prefixes."""
    return any(a != b and b.startswith(a) for a in prefixes for b in prefixes)


def for_rank(manifest: DataFrame, world: int = 1, rank: int | None = None) -> DataFrame:
    """Adds ``rank``, the process that reads a shard: pos modulo their number. ``pos`` then counts within a rank."""
    out = manifest.withColumn("rank", (F.col("pos") % world).cast("int")).withColumn("pos", F.floor(F.col("pos") / world))
    return out if rank is None else out.filter(F.col("rank") == rank)


def for_workers(manifest: DataFrame, workers: int = 1) -> DataFrame:
    """Adds ``worker``: each of a rank's shards goes to one of its workers."""
    return manifest.withColumn("worker", (F.col("pos") % workers).cast("int"))


def for_every_worker(manifest: DataFrame, workers: int, seed: int = 0, key: str = "shard_key") -> DataFrame:
    """Every worker reads all shards, in an order of its own: worker w's seed is ``seed + w``.

    The number of workers is a parameter, so this repeats the manifest by it.
    """
    out = manifest.drop("pos").withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    own = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("worker")).cast("string"), F.col(key).cast("string")).cast("binary"))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("worker").orderBy(own, key)) - 1)


def repeated(manifest: DataFrame, times: int) -> DataFrame:
    """Adds ``epoch``, from 0; ``times`` is finite (endless reading is the loader's)."""
    if times < 1:
        raise ValueError("times must be 1 or more")
    return manifest.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
