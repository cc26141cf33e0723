"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents an expected number of copies: a whole part, and a
fraction that is rounded. Pairs of documents transfer their fractions at random until one is 0 or 1,
so that the source's words stay as they are and every document's expectation is kept. Buckets of a
source round on their own and leave one open document each; a tree of the same step over these
leaves one for the source, which a last draw decides. So a source misses its target by less than the
size of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.base import cut, hex_fraction, n_parts, n_words, nth_of, prepare, unused

#: Documents of a bucket, and open documents that a node of the tree combines.
BUCKET_ROWS = 4096
FAN_IN = 64
_EPS = 1e-9
_COLUMNS = ["src", "bucket", "origin", "id", "size", "p", "x"]
_SCHEMA = "src long, bucket long, origin long, id long, size long, p double, x int"


def transfer(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Moves mass between two fractions so that ``p a + q b`` stays and one becomes 0 or 1.

    ``u`` (0 to 1) chooses the direction with the odds that keep both expectations.
    """
    up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
    if u * (up + down) < down:
        p, q = p + up, q - up * a / b
    else:
        p, q = p - down, q + down * a / b
    snap = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return snap(p), snap(q)


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source and bucket: x is 0 or 1, or null for the one left open, of which p says how open."""
    key, active = None, None
    for batch in batches:
        out: list[tuple] = []
        for src, bucket, origin, doc, size, p, u in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != (src, bucket):
                if active:
                    out.append((*active, None))
                key, active = (src, bucket), None
            row = (src, bucket, origin, doc, size, p)
            if p < _EPS or p > 1 - _EPS:
                out.append((*row, int(p > 0.5)))
            elif not size:
                out.append((*row, int(u < p)))
            elif active is None:
                active = row
            else:
                was, p = transfer(active[5], active[4], p, size, u)
                active, row = (*active[:5], was), (*row[:5], p)
                open_ = [x for x in (active, row) if 0 < x[5] < 1]
                out.extend((*x, int(x[5])) for x in (active, row) if not 0 < x[5] < 1)
                active = open_[0] if open_ else None
        if out:
            yield _rows(out)
    if active:
        yield _rows([(*active, None)])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int32()]
    return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], _COLUMNS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds src (a number), weight and target to one row per source (source, source_size).

    Sources take ``weights`` in turn, by code point, null last. They share the sum of all sizes by weight,
    but none gets over ``most`` times its size; what is over goes to the others. The windows run over
    one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sizes.withColumn("src", turn.cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "src")
    total = F.sum("source_size").over(Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (total - before) / left)
    # The first source, from the lowest ratio up, that its share doesn't fill sets the level for all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    out = out.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")))
    return out.drop("cap", "ratio", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """How many copies of each document a mix of all sources takes.

    Returns one row per row of ``docs``: ``id_col``, size (words), source_size, target (the source's),
    taken (copies times size) and copies. Reruns agree, whatever the partitions: draws come from hashes
    of ``seed`` and the row.

    Null text counts as empty, and an empty text's fraction is drawn alone. Null source: one more
    source, the last. Null id: like any other. Repeated rows: each is drawn, and which of them is taken
    is left open, as they don't differ. Empty table, or no words at all: all targets are 0.
    """
    spark = prepare(docs.sparkSession)
    parts = n_parts(spark)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    sources = cut(sources.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    # A source is named by its number from here on.
    known = sources.select(F.col("source").alias("s"), "src", "source_size", "target", "each", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    # Rows of one id, source and size are alike, but for their number: so they go to buckets of their own.
    alike = rows.groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    rows = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).join(known, F.col("source").eqNullSafe(F.col("s")))
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "nth")
    whole = F.floor(F.col("each") + _EPS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(name), F.col("buckets")))
    drawn = rows.select("src", "bucket", F.col("bucket").alias("origin"), "id", "size", F.greatest(F.col("each") - whole, F.lit(0.0)).alias("p"), hex_fraction(F.concat(name, F.lit("|0"))).alias("u"))

    def step(x: DataFrame) -> DataFrame:
        x = x.repartition(parts, "src", "bucket").sortWithinPartitions("src", "bucket", "u", "id", "size")
        return cut(x.select("src", "bucket", "origin", "id", "size", "p", "u").mapInArrow(_round, _SCHEMA))

    level = first = step(drawn)
    most_buckets = sources.agg(F.coalesce(F.max(F.ceil(F.col("n") / BUCKET_ROWS)), F.lit(0))).first()[0]
    settled, turn = None, 0
    while most_buckets > 1:
        turn += 1
        most_buckets = -(-most_buckets // FAN_IN)
        up = level.filter("x is null").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level = step(up.withColumn("u", hex_fraction(F.concat_ws("|", F.lit(seed), "src", "origin", F.lit(turn)))))
        done = level.filter("x is not null").select("src", "origin", "x")
        settled = done if settled is None else settled.union(done)
    last = level.filter("x is null").select("src", "origin", (hex_fraction(F.concat_ws("|", F.lit(seed), "src", F.lit("last"))) < F.col("p")).cast("int").alias("x"))
    settled = (last if settled is None else settled.union(last)).withColumnRenamed("x", "later")
    out = first.join(settled, ["src", "origin"], "left").join(known, "src")
    copies = (whole + F.coalesce("x", "later")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with its columns as they are.

    Rows that repeat an id share its copies as evenly as can be; the first by their columns, as text, get
    what is left over.
    """
    doc, no_id, copies, rows_, each = unused(docs, "id", "no_id", "copies", "rows", "each")
    keys = [doc, no_id]

    def keyed(x: Column) -> list[Column]:
        return [F.coalesce(x.cast("long"), F.lit(0)).alias(doc), x.isNull().alias(no_id)]

    taken = mix(docs, id_col, **how).groupBy(*keyed(F.col(id_col))).agg(F.sum("copies").alias(copies), F.count("*").alias(rows_))
    rows = docs.select("*", *keyed(F.col(id_col))).join(taken.filter(F.col(copies) > 0), keys)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nth = nth_of(keys, F.col(rows_) > 1, columns)
    rows = rows.withColumn(each, F.floor(F.col(copies) / F.col(rows_)) + (nth <= F.col(copies) % F.col(rows_)).cast("long"))
    return rows.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(each).cast("int")))).select(*columns)
