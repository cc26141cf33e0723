"""One query for each operator on the tables at hand, with its SQL where SQL can express it.

Tables stand in for samples: ``documents`` are samples with ``__key__`` = doc_id and ``__url__`` = source,
``labels`` and ``benchmark`` are sidecars, ``conversations`` are members.
"""

from __future__ import annotations

import atexit
import functools
import gzip
import io
import json
import os
import shutil
import tarfile
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.api import apply_steps, create_dataset, create_loader, repeat_first, steps_of
from shardloom.functions.ordering import order_key
from shardloom.functions.paths import dirname, field_name, is_tar, nested, sample_key, shard_key, sidecar_key
from shardloom.operators import batching, decode, errors, samples, tensors
from shardloom.operators.filters import LambdaFilter, SimpleKeyFilter, SimpleSizeFilter
from shardloom.operators.mappers import AddOriginalImageSizeAsTupleAndCropToSquare, BatchedEinopsTransform, ImageTransforms, LambdaMapper, Rescaler
from shardloom.plans import braces, manifest
from shardloom.sources.tarshards import read_tars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def known(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return known


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents, with the labels of those that have some."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("__url__"), "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


# --- filters ---


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def key_filter(spark: SparkSession, d: str) -> DataFrame:
    return SimpleKeyFilter("quality").apply(_labelled(spark, d)).select("doc_id", "quality")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 20 AND p_retailprice >= 940")
def size_filter_min(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return SimpleSizeFilter([20, 940], "min", strict=True, height_key="p_size", width_key="p_retailprice").apply(parts)


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 30 AND p_retailprice <= 1200")
def size_filter_max(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return SimpleSizeFilter([30, 1200], "max", strict=True, height_key="p_size", width_key="p_retailprice").apply(parts)


@query("SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE (n_chars >= 500 AND quality >= 1) OR n_chars IS NULL OR quality IS NULL")
def size_filter_strict_false(spark: SparkSession, d: str) -> DataFrame:
    keep = SimpleSizeFilter([500, 1], "min", strict=False, height_key="n_chars", width_key="quality")
    return keep.apply(_labelled(spark, d)).select("doc_id", "n_chars", "quality")


@query("""
SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)
WHERE CASE WHEN n_chars IS NULL OR quality IS NULL
  THEN CASE WHEN contains(source, 'src1') THEN false WHEN contains(source, 'src') THEN true END
  ELSE n_chars >= 500 AND quality >= 1 END""")
def size_filter_strict_map(spark: SparkSession, d: str) -> DataFrame:
    keep = SimpleSizeFilter([500, 1], "min", strict={"src1": True, "src": False}, height_key="n_chars", width_key="quality")
    return keep.apply(_labelled(spark, d)).select("doc_id", "n_chars", "quality")


@query("SELECT doc_id, source, n_chars FROM documents WHERE contains(source, 'src1') OR n_chars >= 2000")
def exclude_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return LambdaFilter("n_chars", lambda c: c >= 2000, exclude_keys="src1", url_col="source").apply(docs)


@query("SELECT event_id, value, user_id FROM events WHERE value > 20 AND user_id > 20")
def lambda_filter(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "value", "user_id")
    return LambdaFilter(["value", "user_id"], lambda c: c > 20).apply(events)


# --- mappers ---


@query("SELECT event_id, upper(event_type) AS event_type, value * 2 + 1 AS value FROM events")
def lambda_mapper(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return LambdaMapper("value", lambda c: c * 2 + 1).apply(LambdaMapper("event_type", F.upper).apply(events))


@query("SELECT vec_id, [x::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE FOR x IN embedding] AS embedding FROM embeddings")
def rescale_float(spark: SparkSession, d: str) -> DataFrame:
    return Rescaler("embedding").apply(table(spark, d, "embeddings").select("vec_id", "embedding"))


@query("SELECT p_partkey, p_size::DOUBLE / 127.5::DOUBLE - 1.0::DOUBLE AS p_size FROM part")
def rescale_uint8(spark: SparkSession, d: str) -> DataFrame:
    return Rescaler("p_size", isfloat=False).apply(table(spark, d, "part").select("p_partkey", "p_size"))


@query("""
WITH p AS (SELECT p_partkey, p_size::BIGINT AS h, p_partkey % 50 + 1 AS w FROM part)
SELECT p_partkey, [h, w] AS original_size_as_tuple,
  [('0x' || substr(md5('7|' || p_partkey || '|top'), 1, 8))::BIGINT % (h - least(h, w) + 1),
   ('0x' || substr(md5('7|' || p_partkey || '|left'), 1, 8))::BIGINT % (w - least(h, w) + 1)] AS crop_coords_top_left
FROM p""")
def crop_square_coords(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("h"), (F.col("p_partkey") % 50 + 1).alias("w"))
    crop = AddOriginalImageSizeAsTupleAndCropToSquare("h", "w", image_key=None, use_data_key=False, seed=SEED, row_key="p_partkey", height_col="h", width_col="w")
    return crop.apply(parts).select("p_partkey", "original_size_as_tuple", "crop_coords_top_left")


def _vector_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("worker"), "vec_id", tensors.as_tensor(table(spark, d, "embeddings"), "embedding").alias("embedding"))
    return batching.batched(rows, 16, ["vec_id"])


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings), full_ AS (SELECT label AS worker, rn // 16 AS batch, rn % 16 AS nth, embedding FROM numbered WHERE rn < n - n % 16)"


@query(f"""
WITH {_NUMBERED}, cells AS (SELECT worker, batch, nth, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM full_)
SELECT worker, batch::BIGINT AS batch, [64, 16] AS shape, list(x ORDER BY i, nth) AS data FROM cells GROUP BY ALL""")
def einops_transpose(spark: SparkSession, d: str) -> DataFrame:
    out = BatchedEinopsTransform("b d -> d b", "embedding").apply(_vector_batches(spark, d))
    return out.select("worker", "batch", "embedding.shape", "embedding.data")


@query(f"""
WITH {_NUMBERED}, cells AS (SELECT worker, batch, nth, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM full_),
means AS (SELECT worker, batch, nth, round(avg(x), 6) AS m FROM cells GROUP BY ALL)
SELECT worker, batch::BIGINT AS batch, list(m ORDER BY nth) AS means FROM means GROUP BY ALL""")
def einops_reduce_mean(spark: SparkSession, d: str) -> DataFrame:
    out = BatchedEinopsTransform("b d -> b", "embedding", mode="reduce", reduction="mean").apply(_vector_batches(spark, d))
    return out.select("worker", "batch", F.transform("embedding.data", lambda x: _rounded(x, 6)).alias("means"))


def _rounded(x: Column, digits: int) -> Column:
    """As SQL engines on doubles do it: what rounds to zero from below is -0.0, and the product with the power of ten is what ties."""
    scale = float(10**digits)
    whole = F.when(x < 0, F.negative(F.round(F.abs(x) * scale))).otherwise(F.round(x * scale))
    return F.when(F.abs(x) * scale == float("inf"), x).otherwise(whole / scale)


# --- shards ---


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def shard_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return manifest.semi_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, ['documents/' || d.doc_id, 'labels/' || d.doc_id] AS paths FROM documents d JOIN labels USING (doc_id)")
def shard_key_zip(spark: SparkSession, d: str) -> DataFrame:
    main = table(spark, d, "documents").select("doc_id", F.array(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))).alias("paths"))
    meta = table(spark, d, "labels").select("doc_id", F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias("path"))
    return manifest.zip_join(main, meta, "doc_id")


@query("""
WITH s AS (SELECT DISTINCT source FROM documents)
SELECT source, row_number() OVER (ORDER BY md5('7|' || source), source) - 1 AS pos FROM s""")
def shard_shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    return manifest.shuffled(table(spark, d, "documents").select("source").distinct(), SEED, "source")


@query("""
WITH s AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY md5('7|' || source), source) - 1 AS pos FROM s)
SELECT source, (pos % 2)::INT AS rank, ((pos // 2) % 3)::INT AS worker FROM p""")
def rank_worker_split(spark: SparkSession, d: str) -> DataFrame:
    order = manifest.shuffled(table(spark, d, "documents").select("source").distinct(), SEED, "source")
    return manifest.for_workers(manifest.for_rank(order, 2), 3).select("source", "rank", "worker")


@query("""
WITH s AS (SELECT DISTINCT source FROM documents)
SELECT source, w::INT AS worker, row_number() OVER (PARTITION BY w ORDER BY md5((7 + w) || '|' || source), source) - 1 AS pos FROM s, range(3) t(w)""")
def worker_replicate(spark: SparkSession, d: str) -> DataFrame:
    return manifest.for_every_worker(table(spark, d, "documents").select("source").distinct(), 3, SEED, "source")


@query("""
WITH RECURSIVE
arr AS (SELECT row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS i, lang AS p, doc_id FROM documents),
arr2 AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY i) AS j FROM arr),
draws AS (SELECT k, (('0x' || substr(md5('7|draw|' || k), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS x FROM range((SELECT count(*) + 1 FROM documents)) t(k)),
tgt AS (SELECT k, CASE WHEN x < 0.4 THEN 'de' WHEN x < 0.5 THEN 'en' WHEN x < 0.8 THEN 'es' ELSE 'fr' END AS p FROM draws),
em AS (SELECT 0::BIGINT AS k, (SELECT min(i) FROM arr WHERE p = (SELECT p FROM tgt WHERE k = 0)) AS T
       UNION ALL
       SELECT em.k + 1, (SELECT min(i) FROM arr WHERE i > em.T AND p = (SELECT p FROM tgt WHERE k = em.k + 1)) FROM em WHERE em.T IS NOT NULL),
e2 AS (SELECT em.k, t.p, row_number() OVER (PARTITION BY t.p ORDER BY em.k) AS j FROM em JOIN tgt t ON t.k = em.k WHERE em.T IS NOT NULL)
SELECT e2.k AS pos, arr2.doc_id, arr2.p AS lang FROM e2 JOIN arr2 ON arr2.p = e2.p AND arr2.j = e2.j""")
def prefix_resample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return manifest.resampled(docs, ["de", "en", "es", "fr"], [0.4, 0.1, 0.3, 0.2], SEED, "doc_id", "lang")


@query("SELECT r_regionkey, r_name, e::INT AS epoch FROM region, range(3) t(e)")
def repeat_epochs(spark: SparkSession, d: str) -> DataFrame:
    return manifest.repeated(table(spark, d, "region").select("r_regionkey", "r_name"), 3)


@query("SELECT r_regionkey, 'r' || r_regionkey || '-' || lpad(k::VARCHAR, 3, '0') || '.tar' AS path FROM region, range(8, 13) t(k)")
def brace_expand(spark: SparkSession, d: str) -> DataFrame:
    names = braces.expand("{008..012}.tar")
    specs = table(spark, d, "region").select("r_regionkey", F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("-")).alias("p"))
    return specs.select("r_regionkey", F.explode(F.array(*[F.concat("p", F.lit(n)) for n in names])).alias("path"))


@query("SELECT page_id, url || '.tar' AS path FROM pages WHERE page_id % 2 = 0 AND contains(url, '1')")
def shard_name_filter(spark: SparkSession, d: str) -> DataFrame:
    shards = table(spark, d, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit(".tar")).otherwise(F.lit(".tar.gz"))).alias("path"))
    return shards.filter(is_tar("path") & F.contains("path", F.lit("1")))


@query(r"""
WITH m AS (SELECT page_id, 'data/ds_flow/' || lpad((page_id % 10)::VARCHAR, 4, '0') || '.tar/' || page_id || '.seg.png' AS path, 'data/ds_flow/' || lpad((page_id % 10)::VARCHAR, 4, '0') || '.tar' AS shard FROM pages)
SELECT page_id, page_id::VARCHAR AS key, 'seg.png' AS field, regexp_extract(path, '^(.*)/[^/]*$', 1) AS url,
  regexp_replace(shard, '\.tar$', '') AS shard_key, replace(regexp_replace(shard, '\.tar$', ''), '_flow', '') AS main_key FROM m""")
def path_parse(spark: SparkSession, d: str) -> DataFrame:
    shard = F.concat(F.lit("data/ds_flow/"), F.lpad((F.col("page_id") % 10).cast("string"), 4, "0"), F.lit(".tar"))
    rows = table(spark, d, "pages").select("page_id", shard.alias("shard"), F.concat(shard, F.lit("/"), F.col("page_id").cast("string"), F.lit(".seg.png")).alias("path"))
    return rows.select("page_id", sample_key("path").alias("key"), field_name("path").alias("field"), dirname("path").alias("url"), shard_key("shard").alias("shard_key"), sidecar_key("shard", "flow").alias("main_key"))


# --- samples ---


@query("SELECT doc_id AS key, d.text AS text, b.text AS benchmark_text FROM documents d JOIN benchmark b ON d.doc_id = b.item_id")
def sample_merge_rename(spark: SparkSession, d: str) -> DataFrame:
    main = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.create_map(F.lit("text"), "text").alias("fields"))
    meta = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.create_map(F.lit("text"), "text").alias("fields"))
    out = main.join(meta.withColumnRenamed("fields", "meta"), "key")
    fields = samples.merge_fields(F.col("fields"), F.col("meta"), "benchmark")
    return out.withColumn("fields", fields).select("key", F.col("fields")["text"].alias("text"), F.col("fields")["benchmark.text"].alias("benchmark_text"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    out = samples.group_members(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.col("members")["role"].alias("roles"), F.col("members")["text"].alias("texts"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.none') AS BIGINT) AS missing FROM events")
def json_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", F.create_map(F.lit("json"), F.encode("props", "UTF-8")).alias("fields"))
    out = decode.decode(raw, ["json"])
    return out.select("event_id", F.try_variant_get("json", "$.k", "bigint").alias("k"), F.try_variant_get("json", "$.none", "bigint").alias("missing"))


@query("SELECT event_id, event_type AS type, octet_length(encode(props))::INT AS raw_bytes FROM events")
def decode_only(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("type.txt"), F.encode("event_type", "UTF-8"), F.lit("json"), F.encode("props", "UTF-8"))
    out = decode.decode(table(spark, d, "events").select("event_id", fields.alias("fields")), ["type.txt", "json"], only=["type.txt"], partial=True)
    return out.select("event_id", F.col("`type.txt`").alias("type"), F.octet_length("json").alias("raw_bytes"))


# --- batches ---

_DOCS = "rows_ AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)"


def _doc_batches(spark: SparkSession, d: str, size: int, partial: bool, *columns: str) -> DataFrame:
    """A source is a worker's share."""
    docs = table(spark, d, "documents").select(F.col("source").alias("worker"), "doc_id", *columns)
    return batching.batched(docs, size, [order_key(SEED, "doc_id"), "doc_id"], partial=partial)


@query(f"WITH {_DOCS} SELECT source AS worker, rn // 8 AS batch, list(doc_id ORDER BY rn) AS doc_id, count(*)::INT AS batch_size FROM rows_ GROUP BY ALL HAVING count(*) = 8")
def batch_drop_last(spark: SparkSession, d: str) -> DataFrame:
    return _doc_batches(spark, d, 8, False)


@query(f"WITH {_DOCS} SELECT source AS worker, rn // 8 AS batch, list(doc_id ORDER BY rn) AS doc_id, count(*)::INT AS batch_size FROM rows_ GROUP BY ALL")
def batch_partial(spark: SparkSession, d: str) -> DataFrame:
    return _doc_batches(spark, d, 8, True)


@query("""
WITH r AS (SELECT d.source, d.doc_id, d.n_chars, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY md5('7|' || d.doc_id), d.doc_id) - 1 AS rn FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source AS worker, rn // 4 AS batch, list(n_chars ORDER BY rn) AS n_chars,
  CASE WHEN count(quality) = count(*) THEN list(quality ORDER BY rn) END AS quality, count(*)::INT AS batch_size FROM r GROUP BY ALL""")
def collate_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).select(F.col("__url__").alias("worker"), "doc_id", "n_chars", "quality")
    return batching.batched(rows, 4, [order_key(SEED, "doc_id"), "doc_id"], partial=True).drop("doc_id")


@query(f"WITH {_DOCS}, b AS (SELECT source AS worker, rn // 8 AS batch, list(n_chars ORDER BY rn) AS n_chars FROM rows_ WHERE rn < n - n % 8 GROUP BY ALL) SELECT worker, batch, n_chars FROM b WHERE list_max(n_chars) > 5000")
def batched_filter(spark: SparkSession, d: str) -> DataFrame:
    out = _doc_batches(spark, d, 8, False, "n_chars")
    return LambdaFilter("n_chars", lambda c: F.array_max(c) > 5000).apply(out).select("worker", "batch", "n_chars")


@query("""
WITH rows_ AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) - 1 AS rn FROM documents),
b AS (SELECT lang AS worker, rn // 8 AS batch, list(source ORDER BY rn) AS source, list(n_chars ORDER BY rn) AS n_chars FROM rows_ GROUP BY ALL)
SELECT worker, batch, source FROM b WHERE list_contains(source, 'src3') OR list_max(n_chars) > 8000""")
def exclude_on_batch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("worker"), "doc_id", "source", "n_chars")
    out = batching.batched(docs, 8, [order_key(SEED, "doc_id"), "doc_id"], partial=True)
    return LambdaFilter("n_chars", lambda c: F.array_max(c) > 8000, exclude_keys="src3", url_col="source").apply(out).select("worker", "batch", "source")


# --- errors, dummy, order ---


def _odd_events(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("k", F.col("raw").try_cast("bigint"))


_ODD = "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS raw FROM events)"


@query(f"{_ODD} SELECT event_id, TRY_CAST(raw AS BIGINT) AS k FROM e WHERE TRY_CAST(raw AS BIGINT) IS NOT NULL")
def error_skip(spark: SparkSession, d: str) -> DataFrame:
    with errors.on_error("skip"):
        return LambdaMapper("k", lambda c: c).apply(_odd_events(spark, d)).select("event_id", "k")


@query(f"{_ODD} SELECT event_id, raw, 'KeyError: k' AS _error FROM e WHERE TRY_CAST(raw AS BIGINT) IS NULL")
def error_quarantine(spark: SparkSession, d: str) -> DataFrame:
    with errors.on_error("mark"):
        out = LambdaMapper("k", lambda c: c).apply(_odd_events(spark, d))
    return errors.split(out)[1].select("event_id", "raw", errors.ERROR)


@query("WITH f AS (SELECT doc_id, source FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 1) SELECT doc_id, source, c::INT AS copy FROM f, range(100) t(c)")
def dummy_repeat(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return repeat_first(docs, [order_key(SEED, "doc_id"), "doc_id"], 100)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || source || '|' || doc_id), source, doc_id::VARCHAR) AS place FROM documents")
def sample_shuffle(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("shard"), F.col("doc_id").cast("string").alias("__key__"))
    order = create_dataset("/none/{0..1}.tar", {"sample_shuffle": 10, "seed": SEED}, decoders=None, spark=spark).order()
    return batching.numbered(docs, 1, order, None).select("doc_id", (F.col("batch") + 1).alias("place"))


@query("SELECT '/a/' AS prefix, printf('/a/%04d.tar', i) AS path FROM range(12) t(i) UNION ALL SELECT '/b/', '/b/' || i || '.tar' FROM range(3, 8) t(i)")
def multi_root(spark: SparkSession, d: str) -> DataFrame:
    return manifest.list_shards(spark, ["/a/{0000..0011}.tar", "/b/{3..7}.tar"]).select(F.regexp_extract("path", "^/./", 0).alias("prefix"), "path")


# --- shards ---


def _write_shards(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tar files of rows sorted by shard: (shard, member, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tar = None, None
        done = []

        def close() -> None:
            tar.close()
            os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
            done.append(name)

        for batch in batches:
            for shard, member, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != name:
                    if tar:
                        close()
                    os.makedirs(os.path.dirname(f"{folder}/{shard}"), exist_ok=True)
                    name, tar = shard, tarfile.open(f"{folder}/{shard}.part", "w")
                entry = tarfile.TarInfo(member)
                entry.size = len(content)
                tar.addfile(entry, io.BytesIO(content))
        if tar:
            close()
        yield pa.record_batch([pa.array(done, pa.string())], ["shard"])

    return run


#: Bytes of a shard, about; a task writes or reads one.
SHARD_BYTES = 64 << 20


@functools.lru_cache
def _shards(spark: SparkSession, d: str) -> str:
    """A folder of shards of all labelled documents, and one of a sidecar with every other document and without the last shard.

    A shard's name is fixed by its documents, so there are as many folders of shards of these names as keep a shard small.
    It is on this machine, for these queries: there every task can read it.
    """
    folder = tempfile.mkdtemp(prefix="shardloom-shards-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(labels, "doc_id")
    largest = sizes.groupBy(F.pmod("doc_id", F.lit(8))).agg(F.sum(F.coalesce("size", F.lit(0)) + 6 * tarfile.BLOCKSIZE).alias("size")).agg(F.max("size")).first()[0]
    parts = -(-(largest or 1) // SHARD_BYTES)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    docs = docs.join(labels, "doc_id").withColumn("shard", F.format_string("%05d/%04d.tar", part, F.col("doc_id") % 8))
    docs = docs.withColumn("at", (part * 8 + F.pmod("doc_id", F.lit(8))).cast("int"))
    as_json = F.to_json(F.struct("toxic", F.struct("lang", "source").alias("of")))
    fields = {"txt": F.col("text"), "cls": F.col("quality").cast("string"), "json": as_json}
    pieces = [docs.select("at", F.concat(F.lit("ds/"), "shard").alias("shard"), F.concat("doc_id", F.lit(f".{k}")).alias("member"), c.cast("binary").alias("content")) for k, c in fields.items()]
    side = docs.filter("doc_id % 2 = 0 and doc_id % 8 < 6")
    side = side.select("at", F.concat(F.lit("ds_side/"), "shard"), F.concat("doc_id", F.lit(".json")), F.to_json(F.struct("n_chars")).cast("binary"))
    rows = functools.reduce(DataFrame.union, [*pieces, side]).repartitionById(8 * parts, F.col("at")).drop("at").sortWithinPartitions("shard", "member")
    rows.mapInArrow(_write_shards(folder), "shard string").collect()  # names
    return f"{folder}/ds/"


FIELDS = ["cls", "json", "txt"]
_LABELLED = "documents JOIN labels USING (doc_id)"


@query(f"SELECT doc_id, printf('%04d.tar', doc_id % 8) AS shard, quality::VARCHAR AS content FROM {_LABELLED}")
def tar_members(spark: SparkSession, d: str) -> DataFrame:
    paths = [r.path for r in manifest.list_shards(spark, _shards(spark, d)).collect()]
    rows = read_tars(spark, paths, fields=["cls"])
    return rows.select(F.regexp_extract("member", r"([0-9]+)\.cls$", 1).cast("long").alias("doc_id"), F.substring_index("shard", "/", -1).alias("shard"), F.col("content").cast("string").alias("content"))


@query(f"SELECT doc_id, md5(text) AS text, quality AS cls, toxic, source FROM {_LABELLED}")
def tar_dataset(spark: SparkSession, d: str) -> DataFrame:
    df = create_dataset(_shards(spark, d), {"shardshuffle": 100, "seed": SEED}, decoders=["txt"], fields=FIELDS, spark=spark).frame()
    return df.select(F.col("__key__").cast("long").alias("doc_id"), F.md5("txt").alias("text"), "cls", nested("json", "toxic", "bigint").alias("toxic"), nested("json", "of.source", "string").alias("source"))


@query(f"SELECT doc_id, quality, n_chars, toxic FROM {_LABELLED} WHERE doc_id % 2 = 0 AND doc_id % 8 < 6")
def tar_sidecar(spark: SparkSession, d: str) -> DataFrame:
    df = create_dataset(_shards(spark, d), {"meta_urls": "side"}, decoders=["txt"], fields=["cls", "json", "side.json"], spark=spark).frame()
    return df.select(F.col("__key__").cast("long").alias("doc_id"), F.col("cls").alias("quality"), nested("`side.json`", "n_chars", "bigint").alias("n_chars"), nested("json", "toxic", "bigint").alias("toxic"))


@query(f"SELECT doc_id, quality AS cls, 1 AS batch_size FROM {_LABELLED}")
def loader_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a loader of two workers hands to its consumer, in batches of one, goes round once."""
    data = create_dataset(_shards(spark, d), {"repeat": 1, "sample_shuffle": 100}, decoders=["txt"], fields=["cls"], spark=spark)
    got = [(int(k), c, r["batch_size"]) for r in create_loader(data, 1, num_workers=2, partial=True) for k, c in zip(r["__key__"], r["cls"], strict=True)]
    return spark.createDataFrame(got, "doc_id long, cls long, batch_size int")


@query(f"SELECT doc_id, quality FROM {_LABELLED} WHERE quality = 1")
def tar_key_and_class(spark: SparkSession, d: str) -> DataFrame:
    """A raw filter, and a Python function as filter behind the decoders, both from configurations."""
    pre = [{"target": "shardloom.operators.filters.SimpleKeyFilter", "params": {"keys": ["cls", "txt"]}}]
    data = create_dataset(_shards(spark, d), None, ["txt"], None, pre, [LambdaFilter("cls", lambda v: v == 1, python=True)], fields=["cls"], spark=spark)
    return data.frame().select(F.col("__key__").cast("long").alias("doc_id"), F.col("cls").alias("quality"))


@query("SELECT doc_id, CASE WHEN contains(source, 'src3') THEN quality::DOUBLE ELSE quality * 2.0 - 1 END AS quality FROM documents JOIN labels USING (doc_id)")
def mapper_exclude(spark: SparkSession, d: str) -> DataFrame:
    step = {"target": "shardloom.operators.mappers.Rescaler", "params": {"key": "quality", "exclude_keys": ["src3"]}}
    return apply_steps(_labelled(spark, d).filter("quality is not null"), steps_of([step]), "fail").select("doc_id", "quality")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS props FROM events WHERE event_id % 5 <> 0")
def python_mapper(spark: SparkSession, d: str) -> DataFrame:
    """A Python function of a value; rows on which it fails are dropped."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("{")).otherwise(F.col("props")).alias("props"))
    with errors.on_error("skip"):
        return LambdaMapper("props", lambda v: int(json.loads(v)["k"]), returns="bigint", timeout=30).apply(rows)


@query("SELECT doc_id, lang AS cls FROM documents WHERE lang <> 'en'")
def decode_errors(spark: SparkSession, d: str) -> DataFrame:
    """Fields that can't be decoded leave their row to the error policy: here English ones aren't gzip."""
    docs = table(spark, d, "documents")
    packed = F.when(F.col("lang") == "en", F.col("lang").cast("binary")).otherwise(_gzipped("lang"))
    rows = docs.select("doc_id", F.create_map(F.lit("cls.txt.gz"), packed).alias("fields"))
    with errors.on_error("skip"):
        return decode.decode(rows, ["cls.txt.gz"], strict=True).select("doc_id", F.col("`cls.txt.gz`").alias("cls"))


@F.pandas_udf(T.BinaryType())
def _gzipped(x: pd.Series) -> pd.Series:
    return x.map(lambda v: gzip.compress(v.encode()))


@query("SELECT p_partkey, [3, 1, 2] AS shape, [p_size / 255.0, 20 / 255.0, 1 / 255.0, 5 / 255.0, 0.0, 1.0]::DOUBLE[] AS data FROM part")
def image_to_tensor(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.struct(F.array(*map(F.lit, (1, 2, 3))).alias("shape"), F.array(F.col("p_size"), F.lit(1), F.lit(0), F.lit(20), F.lit(5), F.lit(255)).cast("array<double>").alias("data"))
    out = ImageTransforms(["ToTensor"], key="jpg").apply(table(spark, d, "part").select("p_partkey", pixels.alias("jpg")))
    return out.select("p_partkey", "jpg.shape", "jpg.data")


@query("SELECT p_partkey, [2, 2, 1] AS shape, [p_size, p_size, 7, 7]::DOUBLE[] AS data FROM part")
def einops_repeat(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.struct(F.array(F.lit(2), F.lit(1)).alias("shape"), F.array(F.col("p_size"), F.lit(7)).cast("array<double>").alias("data"))
    out = BatchedEinopsTransform("b c -> b r c", "x", "repeat", axes={"r": 2}).apply(table(spark, d, "part").select("p_partkey", pixels.alias("x")))
    return out.select("p_partkey", "x.shape", "x.data")


@query("SELECT lang AS worker, rn // 8 AS batch, sum(n_chars)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents) GROUP BY ALL")
def collate_custom(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("worker"), "doc_id", "n_chars")
    return batching.batched(docs, 8, ["doc_id"], partial=True, collation=lambda rows, keys, names: rows.groupBy(*keys).agg(F.sum("n_chars").alias("n_chars")))


@query("SELECT page_id, url AS main, url || '-side' AS side FROM pages")
def unzip_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.array("url", F.concat("url", F.lit("-side"))).alias("paths"))
    main, side = samples.unzip(rows, 2)
    return main.withColumnRenamed("path", "main").join(side.withColumnRenamed("path", "side"), "page_id")


def pipeline_of(spark: SparkSession, d: str, size: int) -> DataFrame:
    """Filter, sidecar join, order, batch and collate: the whole way of a sample."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    docs = SimpleSizeFilter([200, 200], "min", strict=True, height_key="n_chars", width_key="n_chars", url_col="source").apply(docs)
    out = docs.join(table(spark, d, "labels"), "doc_id")
    out = SimpleKeyFilter("quality", url_col="source").apply(out)
    out = Rescaler("quality").apply(out.withColumnRenamed("lang", "worker"))
    out = batching.batched(out, size, [order_key(SEED, "doc_id"), "doc_id"])
    return out.select("worker", "batch", "batch_size", "doc_id", "quality", F.aggregate("n_chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_chars"))


@query("""
WITH r AS (SELECT d.lang, d.doc_id, d.n_chars, l.quality::DOUBLE * 2 - 1 AS quality FROM documents d JOIN labels l USING (doc_id) WHERE n_chars >= 200),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM r)
SELECT lang AS worker, rn // 16 AS batch, count(*)::INT AS batch_size, list(doc_id ORDER BY rn) AS doc_id, list(quality ORDER BY rn) AS quality, sum(n_chars)::BIGINT AS sum_chars
FROM b WHERE rn < n - n % 16 GROUP BY ALL""")
def pipeline_e2e(spark: SparkSession, d: str) -> DataFrame:
    return pipeline_of(spark, d, 16)
