"""Stupid-backoff scores of documents under counts of all documents.

The relations of the method are held in blocks, as one row for each n-gram of each document would be
several times the text. Documents are dealt to chunks by hash. Each chunk's n-grams are exploded and
counted; they go as sorted blocks to the buckets of the count table, by hash. There the blocks of all
chunks are summed to the table, which is joined back to each block. The totals return to the chunk,
are joined to its documents' exploded n-grams, and each document's logarithms are summed. Chunks and
buckets grow in number with the words, so no task grows with the data.

By default a document's own n-grams are taken off the counts that it is scored by (leave one out), so
that a text is likely only if others are like it.

An n-gram's hash has 56 bits: a table of m distinct ones mistakes a share of about m / 2^56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import n_parts, n_words, prepare
from shardloom.llm.textkernel import blocks, bytes_of, grams, words

ORDER = 3
BACKOFF = 0.4
#: Documents and words of a chunk, about; n-grams of a bucket of the count table, at most about.
CHUNK_ROWS, CHUNK_WORDS, BUCKET_GRAMS = 4096, 4_000_000, 16_000_000
_BITS = np.uint64(8)  # dropped


def _squeeze(numbers: np.ndarray) -> bytes:
    """Bytes of sorted numbers' differences, plane by plane, compressed."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _counts(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _read_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def _hashed(texts: pa.Array | pa.ChunkedArray, order: int) -> Iterator[list[np.ndarray]]:
    """For each text, in order: the n-gram hashes of each order from 1."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        data, bounds = bytes_of(part)
        for first, last in blocks(bounds):
            hashes, ends = words(data, bounds[first : last + 1])
            runs = [grams(hashes, n) >> _BITS for n in range(1, order + 1)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield [runs[n - 1][a : max(a, b - n + 1)] for n in range(1, order + 1)]


def _tables(texts: pa.Array | pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk and their counts, for all orders together (n is part of the hash)."""
    held: list[np.ndarray] = []
    for runs in _hashed(texts, order):
        held += runs
    return np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by their first column, chunk by chunk."""
    key, held = None, []
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and ids[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(ids[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _emit(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, buckets, dtype=object) * (1 << 56) // buckets).astype(np.uint64)
        for chunk, rows in _chunks(batches):
            known, counts = _tables(rows.column("text"), order)
            cuts = [0, *np.searchsorted(known, edges).tolist(), len(known)]
            full = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
            yield pa.record_batch([pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([_squeeze(known[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()), pa.array([_counts(counts[cuts[k] : cuts[k + 1]]) for k in full], pa.binary())], ["chunk", "bucket", "grams", "counts"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each block's n-grams over all blocks of its bucket; rows are sorted by bucket."""

    def answer(held: list[tuple]) -> pa.RecordBatch:
        known, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for k in range(0, len(held), 16):  # some blocks at a time, so that memory follows the distinct n-grams
            part = [(_expand(g), _read_counts(c)) for _, _, g, c in held[k : k + 16]]
            flat = np.concatenate([known, *(x for x, _ in part)])
            own = np.concatenate([sums, *(c for _, c in part)])
            order = flat.argsort(kind="stable")
            flat, own = flat[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            known, sums = flat[first], np.add.reduceat(own, first)
        out = [_counts(sums[np.searchsorted(known, _expand(g))]) for _, _, g, _ in held]
        return pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int32()), pa.array(out, pa.binary())], ["chunk", "bucket", "totals"])

    key, held = None, []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and row[1] != key:
                yield answer(held)
                held = []
            key = row[1]
            held.append(row)
    if held:
        yield answer(held)


def backoff(runs: list[tuple], n_tokens: int, backing: float) -> float:
    """Sum of log scores of one text. ``runs``: for each order from 1, the n-grams' counts in text order."""
    n = len(runs[0])
    if not n:
        return 0.0
    first = np.asarray(runs[0], np.float64)
    score = np.log(np.maximum(first, 1.0) / max(1, n_tokens))
    for k in range(2, len(runs) + 1):
        own = np.asarray(runs[k - 1], np.float64)
        if len(own):
            before = np.asarray(runs[k - 2], np.float64)[: len(own)]
            here = slice(k - 1, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                score[here] = np.where(own > 0, np.log(own / before), np.log(backing) + score[here])
    return float(score.sum())


def _score(order: int, n_tokens: int, backing: float, leave_out: bool, kind: pa.DataType):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        totals = [_read_counts(x) for x in right.column("totals").to_pylist()]
        total = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        texts = left.column("text")
        known, _ = _tables(texts, order)
        scores, sizes = [], []
        for runs in _hashed(texts, order):
            seen = []
            for x in runs:
                own, at, n = np.unique(x, return_inverse=True, return_counts=True)
                found = total[np.searchsorted(known, own)] - (n if leave_out else 0)
                seen.append(found[at])
            sizes.append(len(runs[0]))
            scores.append(backoff(seen, n_tokens - (sizes[-1] if leave_out else 0), backing))
        return pa.table({"id": left.column("id").cast(kind), "n_tokens": pa.array(sizes, pa.int64()), "log_score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backing: float = BACKOFF, leave_out: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Stupid-backoff score of each row of ``docs``.

    Returns ``id_col``, n_tokens, log_score (natural logarithms, summed over the tokens) and mean_score
    (per token). Words are lower-cased (A-Z). A word is scored by the longest n-gram that ends in it and
    has a count, each step back costing ``backing``; a word that no other document has counts as seen once.

    Null or empty text, or one without words: 0 tokens, log_score 0, mean_score null. Null id: scored.
    Repeated rows: each is scored, and is another document to the others. Empty table: no rows.
    """
    spark = prepare(docs.sparkSession)
    parts = n_parts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0))).first()
    chunks = max(parts, -(-n // chunk_rows), -(-tokens // CHUNK_WORDS))
    buckets = max(parts, -(-order * tokens // BUCKET_GRAMS))
    # Both uses of these rows have one plan, so Spark makes the exchange once.
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text").repartition(max(parts, chunks // 4), "chunk")
    blocks_ = dealt.sortWithinPartitions("chunk").mapInArrow(_emit(order, buckets), "chunk long, bucket int, grams binary, counts binary")
    totals = blocks_.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_total, "chunk long, bucket int, totals binary")
    out = dealt.groupBy("chunk").cogroup(totals.repartition(max(parts, chunks // 4), "chunk").groupBy("chunk")).applyInArrow(_score(order, tokens, backing, leave_out, pa.int64()), "id long, n_tokens long, log_score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_score", F.try_divide("log_score", "n_tokens").alias("mean_score"))
