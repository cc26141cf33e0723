"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces (documents, or parts of those longer than the largest sequence) are dealt to independent packers
by hash. A packer takes pieces from long to short and puts each in the open bin that it fills best. If
none takes it, a new bin opens at the length that costs least for what is still to come; at the end a
bin shrinks to the smallest length that holds its contents. Bins that stay loose are taken apart and
their pieces packed again together with those of other packers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import cut, n_parts, n_words, prepare

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces of a packer, about.
PACKER_ROWS = 20_000
#: A bin that is filled less is packed again.
LOOSE = 0.95
#: What a bin costs besides its padding, in words; pieces that are tried when a bin's padding is estimated.
BIN_COST, LOOK = 1.0, 32
_COLUMNS = ["packer", "bin", "capacity", "offset", "id", "nth", "part", "start", "size"]
_SCHEMA = "packer long, bin long, capacity int, offset int, id long, nth int, part int, start long, size int"


class _Open:
    """Open bins by room left: the smallest room that is enough, in time of the number of room sizes / 64."""

    def __init__(self, most: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.filled = 0  # bit r: some bin has room r

    def best(self, size: int) -> int | None:
        above = self.filled >> size
        return size + ((above & -above).bit_length() - 1) if above else None

    def push(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self.filled |= 1 << room

    def pop(self, room: int) -> int:
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self.filled &= ~(1 << room)
        return bin_


def padding(room: int, sizes: list[int], at: int) -> int:
    """Words that stay free of ``room`` when the pieces from ``at`` on, which fall, are put in as long as one fits.

    After ``LOOK`` pieces, the rest of the room counts as filled as far as the pieces left can fill it.
    """
    for _ in range(LOOK):
        at = bisect_left(sizes, -room, at, key=neg)
        if not room or at == len(sizes) or not sizes[at]:
            return room
        room -= sizes[at]
        at += 1
    return max(0, room - sum(sizes[at : at + room]))


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's length. ``sizes`` fall; none is over the last length.

    A piece goes to the open bin that it fills best. If none takes it, a bin of the length of least cost
    opens: that is what a word of content costs, in words of padding and in ``BIN_COST`` for the bin, if
    the pieces still to come fill it from long to short. Of equal costs, the shorter length.
    """
    open_, content, limit, at, offset = _Open(lengths[-1]), [], [], [], []
    for nth, size in enumerate(sizes):
        room = open_.best(size)
        if room is None:
            costs = []
            for length in lengths[bisect_left(lengths, size) :]:
                waste = padding(length - size, sizes, nth + 1)
                costs.append(((waste + BIN_COST) / max(1, length - waste), length))
            room = min(costs)[1]
            bin_ = len(content)
            content.append(0)
            limit.append(room)
        else:
            bin_ = open_.pop(room)
        at.append(bin_)
        offset.append(content[bin_])
        content[bin_] += size
        open_.push(room - size, bin_)
    return at, offset, [lengths[bisect_left(lengths, c)] for c in content]


def _packer(lengths: tuple[int, ...]):
    """Rows sorted by packer and falling size to placed rows; a packer's rows are its bounded share."""

    def placed(packer: int, rows: list[tuple]) -> pa.RecordBatch:
        at, offset, limit = pack([r[-1] for r in rows], lengths)
        cols = [[packer] * len(rows), at, [limit[b] for b in at], offset, *(list(x) for x in zip(*rows, strict=True))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for packer, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if packer != key:
                    if rows:
                        yield placed(key, rows)
                    key, rows = packer, []
                rows.append(tuple(row))
        if rows:
            yield placed(key, rows)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, packer_rows: int = PACKER_ROWS) -> DataFrame:
    """Where each document goes: one row per piece.

    Returns ``id_col``, nth (which of the rows of that id and size), part (piece of the document, from 0),
    start (its first word), size (words), bin (a text), capacity (the bin's length) and offset in the bin.
    A document of more words than the largest length is cut into pieces of that length and a rest.

    A document without words, or null text, takes part as one piece of size 0. Null id: packed like any
    other. Repeated rows: each is packed. Empty table: no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), n_words(F.col(text_col)).alias("words")).groupBy("id", "words").agg(F.count("*").alias("times")))
    rows = rows.select("id", "words", F.explode(F.sequence(F.lit(1).cast("int"), F.col("times").cast("int"))).alias("nth"))
    last = F.greatest(F.ceil(F.col("words") / most) - 1, F.lit(0)).cast("int")
    rows = rows.select("id", "words", "nth", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    rows = rows.withColumn("start", F.col("part").cast("long") * most).withColumn("size", F.least(F.lit(most), F.col("words") - F.col("start")).cast("int"))
    packers = max(1, -(-rows.count() // packer_rows))
    key = F.xxhash64(F.coalesce(F.col("id"), F.lit(-1)), "nth", "part", "size")
    order = ["packer", F.col("size").desc(), "id", "nth", "part"]

    def deal(x: DataFrame, n: int) -> DataFrame:
        x = x.withColumn("packer", F.pmod(key, F.lit(n))).select("packer", "id", "nth", "part", "start", "size")
        return x.repartition(n_parts(spark), "packer").sortWithinPartitions(*order).mapInArrow(_packer(lengths), _SCHEMA)

    first = cut(deal(rows, packers))
    fill = first.groupBy("packer", "bin").agg((F.sum("size") / F.max("capacity")).alias("fill"))
    first = first.join(fill, ["packer", "bin"])
    loose = first.filter(F.col("fill") < LOOSE).select("id", "nth", "part", "start", "size")
    again = deal(loose, max(1, -(-loose.count() // packer_rows)))
    both = first.filter(F.col("fill") >= LOOSE).select(*_COLUMNS, F.lit("a").alias("turn")).union(again.select(*_COLUMNS, F.lit("b")))
    return both.select(F.col("id").alias(id_col), "nth", "part", "start", "size", F.concat_ws("-", "turn", "packer", "bin").alias("bin"), "capacity", "offset")
