"""Exact duplicates, owned by Patricia tries over partitions by length and content hash.

Each task first puts its own rows in a trie, so that a text goes through the shuffle once per task
however many copies there are. Texts then meet in the partition of their length and hash, where a
second trie compares full byte strings; its terminal nodes hold the owner's id and the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import n_parts, nth_of, prepare, unused
from shardloom.llm.radix import MAX_BYTES, RadixTrie

#: A first trie is given out and begun anew at so many bytes.
LOCAL_BYTES = 24 << 20


def _merger(largest: bool):
    def merge(old, new):
        (a, n), (b, m) = old[:2], new[:2]
        if a is None or b is None:
            best = a if b is None else b
        else:
            best = max(a, b) if largest else min(a, b)
        return (best, n + m, *old[2:])

    return merge


def _batch(found: list) -> pa.RecordBatch:
    keys, values = zip(*found, strict=True)
    sizes, hashes, ids, counts = [len(x) for x in keys], [x[2] for x in values], [x[0] for x in values], [x[1] for x in values]
    return pa.record_batch([pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], ["size", "sha", "id", "copies", "bytes"])


def _given(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for key, value in trie.items():
        found.append((key, value))
        held += len(key)
        if held > 4 << 20 or len(found) == 5000:
            yield _batch(found)
            found, held = [], 0
    if found:
        yield _batch(found)


def _local(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(_merger(largest))
        for batch in batches:
            for doc, sha, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                trie.insert(text, (doc, 1, sha))
                if trie.bytes > LOCAL_BYTES:
                    yield from _given(trie)
                    trie = RadixTrie(_merger(largest))
        yield from _given(trie)

    return run


def _owners(largest: bool, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(_merger(largest), max_bytes)
        for batch in batches:
            for sha, doc, copies, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                trie.insert(text, (doc, copies, sha))
        shared = [], [], []
        for _, (doc, copies, sha) in trie.items():
            if copies > 1:
                for column, x in zip(shared, (sha, doc, copies), strict=True):
                    column.append(x)
        yield pa.record_batch([pa.array(shared[0], pa.binary()), pa.array(shared[1], pa.int64()), pa.array(shared[2], pa.int64())], ["sha", "owner", "copies"])

    return run


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("bytes"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each row's group of equal texts.

    Returns one row per row of ``docs``: ``id_col``, keep_id (the smallest or, by ``keep``, largest id
    of the group), group_size, kept, text_sha256 (lowercase hex of the text's UTF-8).

    Null text counts as empty, so null and empty texts are one group. Null id: it is kept only in a
    group of null ids, where keep_id is null. Repeated rows (same id and text): exactly one of a
    group's rows is kept. Empty table: no rows. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: 'smallest' or 'largest'")
    spark = prepare(docs.sparkSession)
    rows = _hashed(docs, id_col, text_col)
    local = rows.mapInArrow(_local(keep == "largest"), "size long, sha binary, id long, copies long, bytes binary")
    owners = local.repartition(n_parts(spark), "size", "sha").select("sha", "id", "copies", "bytes").mapInArrow(_owners(keep == "largest", max_bytes), "sha binary, owner long, copies long")
    each = rows.groupBy("id", "sha").agg(F.count("*").alias("times"))
    out = each.join(owners, "sha", "left")
    nth = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    owner = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("owner"))
    out = out.select("id", owner.alias("owner"), F.coalesce("copies", F.lit(1)).alias("copies"), nth.alias("nth"), "sha")
    return out.select(
        F.col("id").alias(id_col),
        F.col("owner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("owner")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns as they are.

    Of repeated rows (same id and text) with other columns that differ, the first by these as text stays.
    """
    *keys, times, nth = unused(docs, "id", "no_id", "sha", "times", "nth")

    def keyed(doc: Column, sha: Column) -> list[Column]:
        return [x.alias(key) for x, key in zip((F.coalesce(doc.cast("long"), F.lit(0)), doc.isNull(), sha), keys, strict=True)]

    groups = exact_groups(docs, id_col, text_col, keep)
    groups = groups.groupBy(*keyed(F.col(id_col), F.unhex("text_sha256"))).agg(F.max("kept").alias("kept"), F.count("*").alias(times))
    rows = docs.select("*", *keyed(F.col(id_col), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))))
    rows = rows.join(groups.filter("kept").drop("kept"), keys)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows meet by the same keys in join and window, so they move once.
    return rows.withColumn(nth, nth_of(keys, F.col(times) > 1, columns)).filter(F.col(nth) == 1).select(*columns)
