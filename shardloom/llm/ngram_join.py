"""N-gram Jaccard join: near duplicates by rare-first prefix filtering, as classes of documents.

A document's set holds its distinct n-word shingles. Tokens are put in one global order, rare ones
first. Two sets of a similarity of t or more must share a token among their first
``n - ceil(t n) + 1``; only these prefixes are joined. Where prefixes meet, a pair must pass the length and positional filters and the
suffix filter, here by counts between fixed pivots; what is left is counted exactly, once per pair.

Counts for the order come from a table of fixed size over all shingles of all documents; any total
order gives the same result, so that it is approximate costs time only.

Classes need no pair within a group of copies: equal sets collapse first; where a token's documents
meet, each is first paired with two others; linked documents then count as one class. A second round
is complete, over tokens that several classes have. It gives out no pairs: each task names the groups
of documents that its candidates connect, such groups are joined to blocks, and each document's text
goes to its block, where all pairs of different classes are compared in memory. A large block is a grid
of cells; what comes out is a spanning forest of links. Rows so grow with documents, not with pairs.

A token that very many documents have is dealt out by salts, at first from the count table, which is
never less than the token's count, later by its own count.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.base import cut, n_parts, prepare, unused
from shardloom.llm.graph import Groups, components
from shardloom.llm.textkernel import mix, shingle_sets

SKETCH_BITS = 18
_PIECES = 16
#: Requests for texts (of 32 bytes) that are sent to all executors at most.
MOST_SENT = 500_000
#: Documents of a token that one task compares, about; documents and shingles of a part of a block.
HOT_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 4096, 512, 1 << 20
_CLASS_BITS = np.uint64(6)
#: Bits at most of the map of ids whose texts are asked for, 16 for each request as far as that goes.
MOST_BITS = 1 << 27
#: Between tokens as unsigned numbers and numbers of the same order.
_SIGN = -(1 << 63)


SCANNED = ["id", "n", "digest", "outline", "piece", "counts"]
#: A set's counts in 128 equal ranges of the hash, modulo 4.
_RANGES = 128
#: Stands for an unknown outline. A set that happens to have it is compared without.
_NO_OUTLINE = b"\xff" * (_RANGES // 4)
_four = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
_steps = (_four[:, None] - _four[None]) & 3
#: How far two bytes of outlines are apart.
_APART = np.minimum(_steps, 4 - _steps).sum(-1).astype(np.uint8)


def _outline(found: np.ndarray) -> bytes:
    counts = (np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=_RANGES) & 3).astype(np.uint8)
    return (counts[::4] | counts[1::4] << 2 | counts[2::4] << 4 | counts[3::4] << 6).tobytes()


def _far(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The least number of tokens that are in one of two sets only, from their outlines; 0 if one is unknown."""
    return np.where((one == 255).all(-1) | (many == 255).all(-1), 0, _APART[one, many].sum(-1, dtype=np.int64))


def _scan(n: int):
    """Set size and digest of each row, then the task's counts of shingles, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            sizes, digests, outlines, held, waiting = [], [], [], [], 0
            for found in shingle_sets(batch.column(1), n):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                outlines.append(_outline(found))
                held.append(found)
                waiting += len(found)
                if waiting > 1 << 17:
                    counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(counts))
                    held, waiting = [], 0
            if waiting:
                counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(counts))
            nothing = pa.nulls(len(sizes))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(outlines, pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], SCANNED)
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts, _PIECES)]
            nothing = pa.nulls(_PIECES)
            yield pa.record_batch([nothing.cast(pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary()), nothing.cast(pa.binary()), pa.array(range(_PIECES), pa.int32()), pa.array(parts, pa.binary())], SCANNED)

    return run


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            total[piece] = total[piece] + counts if piece in total else counts
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])


def _rarity(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A class from 0 (rare) to 63 for each cell of the count table, and in how many parts its tokens are dealt out."""
    pieces = scanned.filter("piece is not null").select("piece", "counts")
    few = pieces.coalesce(max(1, min(64, pieces.rdd.getNumPartitions()))).mapInArrow(_sum_pieces, pieces.schema)
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    each = len(counts) // _PIECES
    for piece, part in few.repartition(_PIECES, "piece").mapInArrow(_sum_pieces, pieces.schema).collect():
        counts[piece * each : (piece + 1) * each] += np.frombuffer(part, np.int64)
    usual = max(1.0, float(np.median(counts)))
    salts = np.maximum(1, counts // max(HOT_ROWS, int(8 * usual)))
    return np.clip(np.floor(4 * np.log2(np.maximum(counts / usual, 1e-9))), 0, 63).astype(np.uint8), salts


def _prefixes(n: int, num: int, den: int, rarity):
    """(token, id, set size and salt) of each document's prefix; equal sets of a task give one.

    The salt is -1 for tokens that aren't dealt out. One more row per document has set size -1 and, for a token, the high halves of the prefix's last token
    and of the one that nine tenths of the prefix don't exceed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, parts = rarity.value
        classes = classes.astype(np.uint64) << (np.uint64(64) - _CLASS_BITS)
        shift = np.uint64(64 - SKETCH_BITS)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, ids, sizes, salts, ends = [], [], [], [], []
            for doc, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                size = len(found)
                if not size or doc is None:
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue
                if len(seen) < 1_000_000:  # beyond, copies are only found later
                    seen.add(digest)
                keep = size - -(-num * size // den) + 1
                token = classes[found >> shift] | (found >> _CLASS_BITS)
                order = token.argsort()[:keep]
                token, part = token[order], parts[found[order] >> shift]
                tokens.append(token)
                ids.append(np.full(len(token), doc, np.int64))
                sizes.append(np.full(len(token), size, np.int64))
                salts.append(np.where(part > 1, zlib.crc32(b"%d" % doc) % part, -1).astype(np.int32))
                ends.append((int(token[-1]) >> 32 << 32 | int(token[9 * (len(token) - 1) // 10]) >> 32, doc))
                if len(tokens) == 2000:
                    yield _posting(tokens, ids, sizes, salts, ends)
                    tokens, ids, sizes, salts, ends = [], [], [], [], []
            if tokens:
                yield _posting(tokens, ids, sizes, salts, ends)

    return run


def _posting(tokens: list, ids: list, sizes: list, salts: list, ends: list) -> pa.RecordBatch:
    tokens = [*tokens, np.array([x for x, _ in ends], np.uint64)]
    ids = [*ids, np.array([x for _, x in ends], np.int64)]
    sizes = [*sizes, np.full(len(ends), -1, np.int64)]
    salts = [*salts, np.full(len(ends), -1, np.int32)]
    return pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(salts))], ["token", "id", "size", "salt"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows again, in blocks that end where the first column's value changes."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) if pa.types.is_binary(x.type) else x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(cols[0]):
            continue
        ends = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        if len(ends):
            last = ends[-1] + 1
        elif rest and rest[-1][0][-1] != cols[0][0]:
            last = 0
        else:
            rest.append(cols)
            continue
        full = [*rest, [c[:last] for c in cols]]
        yield [np.concatenate(x) for x in zip(*full, strict=True)]
        rest = [[c[last:] for c in cols]]
    if rest:
        yield [np.concatenate(x) for x in zip(*rest, strict=True)]


def _shared(num: int, den: int):
    """Of rows sorted by token and salt, those whose token others of a size near their own may have, with the smallest id that meets here; and those of ends.

    Tokens that two linked sets have in common are kept in both, so what is left still bounds how many these are.
    """
    names = ["token", "id", "size", "salt", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, doc, size, salt in _runs(batches):
            own = size >= 0
            if not own.all():
                rest = ~own
                yield pa.record_batch([pa.array(x[rest]) for x in (token, doc, size, salt, doc)], names)
                token, doc, size, salt = token[own], doc[own], size[own], salt[own]
            if len(token):
                new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
                first, group = np.flatnonzero(new), np.cumsum(new)
                length = np.diff(np.append(first, len(token)))
                head = np.repeat(np.minimum.reduceat(doc, first), length)
                order = np.lexsort((size, group))
                group, by_size = group[order], size[order]
                near = (group[1:] == group[:-1]) & (den * by_size[:-1] >= num * by_size[1:])
                keep = salt >= 0
                keep[order[:-1][near]] = keep[order[1:][near]] = True
                if keep.any():
                    yield pa.record_batch([pa.array(x[keep]) for x in (token, doc, size, salt, head)], names)

    return run


class _Rows:
    """Rows sorted by key (that of a token, or of a part of its rows), set size and node, with the filters for two that share one."""

    def __init__(self, cols: list[np.ndarray], num: int, den: int) -> None:
        self.key, self.node, self.root, self.size, self.rank, self.shared, self.ends, self.outline = cols[:8]
        self.head = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1])))
        self.length = np.diff(np.append(self.head, len(self.key)))
        self.num, self.den = num, den
        prefix = self.size - -(-num * self.size // den) + 1
        self.tail = self.size - prefix  # tokens after the prefix
        self.most = self.size - 9 * (prefix - 1) // 10 - 1  # tokens after nine tenths of it
        ends = self.ends.view(np.uint64)
        self.last, self.ninth = ends >> np.uint64(32), ends & np.uint64(0xFFFFFFFF)
        self.known = self.ends != 0

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length filter; ``right`` is not smaller."""
        return self.den * self.size[left] >= self.num * self.size[right]

    def _rest(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Tokens that may be common behind the prefix of ``one``, should it end first; 0 if it can't."""
        rest = self.tail[one]
        known = self.known[one] & self.known[other]
        rest = np.where(known & (self.ninth[other] < self.last[one]), np.minimum(rest, self.most[other]), rest)
        return np.where(known & (self.last[one] > self.last[other]), 0, rest)

    def passes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positional and suffix filter.

        Common tokens are at most those before and after this one in both prefixes, as far as other
        documents have them at all, and what one has behind the prefix that ends first; what the other
        has there is no more than it has behind nine tenths of its own prefix, if these end before.
        """
        size = self.size[left] + self.size[right]
        need = -(-self.num * size // (self.num + self.den))
        before = np.minimum(self.rank[left], self.rank[right])
        after = np.minimum(self.shared[left] - self.rank[left], self.shared[right] - self.rank[right])
        ok = before + after + np.maximum(self._rest(left, right), self._rest(right, left)) >= need
        at = np.flatnonzero(ok)
        if len(at):
            ok[at[_far(self.outline[left[at]], self.outline[right[at]]) > (size - 2 * need)[at]]] = False
        return ok


class _Pairs:
    """Distinct pairs, gathered over a task; given out when a million are waiting."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.waiting.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
            self.n += len(a)
            if self.n > 1 << 21:
                self.waiting = [np.unique(np.concatenate(self.waiting), axis=0)]
                self.n = len(self.waiting[0])

    def out(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.n > least:
            both = np.unique(np.concatenate(self.waiting), axis=0)
            self.waiting, self.n = [], 0
            yield pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _meet(num: int, den: int):
    """Candidate pairs of rows sorted by key, set size and node: each with the key's first node and with the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Pairs()
        for cols in _runs(batches):
            x = _Rows(cols, num, den)
            first, here = np.repeat(x.head, x.length), np.arange(len(x.key))
            left, right = np.concatenate((first, np.maximum(here - 1, first))), np.concatenate((here, here))
            ok = np.flatnonzero((left < right) & x.near(left, right))
            ok = ok[x.passes(left[ok], right[ok])]
            found.add(x.node[left[ok]], x.node[right[ok]])
            yield from found.out(1 << 20)
        yield from found.out(0)

    return run


def _across(x: _Rows, groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of different classes, each row with the one some steps behind it; sizes grow, so who is too small stays so.

    Rows that ``groups`` has connected meanwhile aren't compared.
    """
    mixed = np.minimum.reduceat(x.root, x.head) != np.maximum.reduceat(x.root, x.head)
    end = np.repeat(x.head + x.length, x.length)
    left = np.flatnonzero(np.repeat(mixed, x.length))
    step, group = 0, None
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        left = left[x.near(left, left + step)]
        ok = left[x.root[left] != x.root[left + step]]
        if step & (step - 1) == 0 and step > 1:
            group = np.array([groups.find(n) for n in x.node.tolist()], np.int64)
        if group is not None:
            ok = ok[group[ok] != group[ok + step]]
        ok = ok[x.passes(ok, ok + step)]
        yield ok, ok + step


def _visits(x: _Rows, visitor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of different classes of which one is a visitor and the other is not."""
    for head, length in zip(x.head.tolist(), x.length.tolist(), strict=True):
        here = visitor[head : head + length]
        own = head + np.flatnonzero(~here)
        for at in (head + np.flatnonzero(here)).tolist():
            left, right = np.minimum(own, at), np.maximum(own, at)
            ok = np.flatnonzero((x.root[own] != x.root[at]) & x.near(left, right))
            ok = ok[x.passes(left[ok], right[ok])]
            yield left[ok], right[ok]


def _connect(num: int, den: int):
    """Groups of nodes that candidates of different classes connect, over all rows of a task: (node, another of its group).

    Rows are sorted by key, set size and node. Visitors of a key meet its own rows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for cols in _runs(batches):
            x, visitor = _Rows(cols, num, den), cols[8].astype(bool)
            own = _Rows([c[~visitor] for c in cols], num, den) if visitor.any() else x
            todo = [(own, _across(own, groups))] if len(own.key) else []
            todo += [(x, _visits(x, visitor))] if visitor.any() else []
            for rows, found in todo:
                for left, right in found:
                    for a, b in zip(rows.node[left].tolist(), rows.node[right].tolist(), strict=True):
                        groups.join(a, b)
        out = [(a, groups.find(a)) for a in list(groups.up)]
        yield pa.record_batch([pa.array([a for a, b in out if a != b], pa.int64()), pa.array([b for a, b in out if a != b], pa.int64())], ["u", "v"])

    return run


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, of sorted distinct hashes."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)) or not len(x):
        return False
    need = -(-num * (len(x) + len(y)) // (num + den))
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def _verify(n: int, num: int, den: int):
    """Links among rows sorted by block: the block's own text first, then those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            us, vs = [], []
            for a, salt, b, found in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), n), strict=True):
                if key != (a, salt):
                    key, own = (a, salt), []
                if b is None:
                    own.append(found)
                elif any(similar(x, found, num, den) for x in own):
                    us.append(a)
                    vs.append(b)
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _compare(n: int, num: int, den: int):
    """Links between classes, of rows sorted by block and cell, the cell's first part first; a spanning forest a cell.

    A cell compares the texts of two parts of a block, or of one part, and no two texts of one class.
    """

    def links(held: list[list[tuple]]) -> list[tuple[int, int]]:
        groups, found = Groups(), []
        firsts, others = held if held[1] else (held[0], held[0])
        others = sorted(others, key=lambda r: len(r[2]))
        size = np.array([len(r[2]) for r in others], np.int64)
        outline = np.frombuffer(b"".join(_outline(r[2]) for r in others), np.uint8).reshape(len(others), -1)
        for node, root, mine in firsts:
            low, high = np.searchsorted(size, [-(-num * len(mine) // den), den * len(mine) // num + 1])
            both = size[low:high] + len(mine)
            apart = _far(np.frombuffer(_outline(mine), np.uint8)[None], outline[low:high])
            for k in (low + np.flatnonzero(apart <= both - 2 * -(-num * both // (num + den)))).tolist():
                other, its, there = others[k]
                if groups.find(root) != groups.find(its) and similar(mine, there, num, den):
                    groups.join(root, its)
                    found.append((node, other))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[], []]

        def given() -> pa.RecordBatch:
            found = links(held) if held[0] else []
            return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for *cell, side, node, root, found in zip(*(batch.column(i).to_pylist() for i in range(6)), shingle_sets(batch.column(6), n), strict=True):
                if cell != key:
                    yield given()
                    key, held = cell, [[], []]
                if len(found):
                    held[side].append((node, root, found))
        yield given()

    return run


def _links(spark: SparkSession, texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough. A text goes once to each pair, and once to each block of pairs."""
    n_pairs = pairs.count()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(max(16, n_pairs // HOT_ROWS))))
    asked = pairs.select("a", "salt", "b", F.col("b").alias("id")).union(pairs.select("a", "salt", F.lit(None).cast("long"), F.col("a")).distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    rows = _meant(texts, ids, 2 * n_pairs).join(asked.hint(_how(2 * n_pairs)), "id").select("a", "salt", "b", "text")
    rows = rows.repartition(n_parts(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(n, num, den), "u long, v long")


def _packed(high: str, low: Column, name: str = "packed") -> Column:
    """Two numbers as one; ``low`` from 0 up to 2^31."""
    return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(low.cast("long")).alias(name)


def _unpacked(df: DataFrame, high: str, low: str, name: str = "packed") -> DataFrame:
    return df.withColumns({high: F.shiftright(name, 32), low: F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")}).drop(name)


def _how(requests: int) -> str:
    """Few enough requests go to the rows they are for; else both meet by id."""
    return "broadcast" if requests <= MOST_SENT else "merge"


def _bits(ids: DataFrame, requests: int):
    """The bit of a column's ids in a map of bits by hash, and a function that tells which bits ``ids`` (id) have.

    An id that has a bit in common with one of ``ids`` seems to be among them; none of them is missed.
    """
    spark = ids.sparkSession
    size = min(MOST_BITS, 1 << max(15, (16 * requests - 1).bit_length()))

    def cell(col: Column | str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(size)).cast("long")

    # These functions count from 1.
    placed = ids.select((cell("id") + 1).alias("cell")).select("cell", F.bitmap_bucket_number("cell").alias("bucket")).repartition(n_parts(spark), "bucket")
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in placed.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell"))).collect():
        bits[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, np.uint8)
    known = spark.sparkContext.broadcast(bits)

    def had(cells: pa.Array) -> pa.Array:
        at = cells.to_numpy(zero_copy_only=False)
        return pa.array((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return cell, had


def _meant(texts: DataFrame, ids: DataFrame, requests: int) -> DataFrame:
    """``texts`` to join with ``requests``: all, if these are sent to the texts; else those whose id may be among ``ids``, so that no others are moved."""
    if _how(requests) == "broadcast":
        return texts
    cell, had = _bits(ids, requests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(had(batch.column(2)))

    return texts.select("id", "text", cell("id").alias("cell")).mapInArrow(run, texts.schema)


def _of_nodes(nodes: DataFrame, *more: str) -> DataFrame:
    """The tokens of ``nodes``, one a row, with all that is known of the node."""
    each = F.posexplode(F.arrays_zip("tokens", "heads", "salts")).alias("rank", "at")
    rows = nodes.select("node", "size", "outline", "ends", *more, F.size("tokens").cast("long").alias("shared"), each)
    return rows.select(F.col("at.tokens").alias("token"), "node", "size", F.col("at.salts").alias("salt"), F.col("at.heads").alias("head"), "shared", F.col("rank").cast("long").alias("rank"), "outline", "ends", *more)


def _last_links(spark: SparkSession, texts: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """All links that are left between classes of ``nodes``, or enough of them to connect what they connect."""
    parts = n_parts(spark)
    classes = _of_nodes(nodes, "root")
    columns = ["head", "token", "cell", "key", "node", "root", "size", "rank", "shared", "ends", "outline", "visits"]
    none = F.lit(0).cast("long")
    rows = classes.filter("salt < 0").withColumns({"cell": none, "key": F.col("token"), "visits": none}).select(columns)
    # Of tokens that were dealt out: those of several classes. The largest of these is the main one; rows that
    # aren't of it visit all parts of the token.
    hot = classes.filter("salt >= 0").drop("salt", "head")
    by_class = hot.groupBy("token", "root").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    mixed = by_class.groupBy("token").agg(F.sum("n").alias("many"), F.max_by("root", "n").alias("main"), F.min("node").alias("head"), F.count("*").alias("kinds")).filter("kinds > 1")
    hot = hot.join(mixed.drop("kinds"), "token").withColumn("cells", F.ceil(F.col("many") / HOT_ROWS)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")))
    every = F.sequence(none, F.col("cells") - 1)
    hot = hot.withColumn("cell", F.explode(F.when((F.col("cells") > 1) & (F.col("root") != F.col("main")), every).otherwise(F.array("own"))))
    hot = hot.withColumns({"key": F.xxhash64("token", "cell"), "visits": (F.col("cell") != F.col("own")).cast("long")})
    # Tokens of one group of documents meet in some tasks, not in all, as a task gives out each of its groups once.
    rows = rows.union(hot.select(columns)).repartition(parts, "head", F.pmod("token", F.lit(_spread(parts))), "cell").sortWithinPartitions("key", "size", "node")
    rows = rows.select(columns[3:])
    near = cut(rows.mapInArrow(_connect(num, den), "u long, v long").distinct())
    if near.isEmpty():
        return near
    known = nodes.groupBy("node").agg(F.min("root").alias("class"), F.max("size").alias("size"))
    members = components(near).withColumnRenamed("root", "block").join(known, "node")
    blocks = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    members = members.join(blocks, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # The parts of a block meet two by two; a text goes to as many cells as its block has parts.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = members.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), F.col("node").alias("id"), "class")
    asked = cut(asked)
    requests = asked.count()
    cells = _meant(texts, asked.select("id"), requests).join(asked.hint(_how(requests)), "id").select("block", "i", "j", "side", "id", "class", "text")
    cells = cells.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "id")
    return cut(cells.mapInArrow(_compare(n, num, den), "u long, v long"))


def _spread(parts: int) -> int:
    """How many tasks the tokens of one group of documents go to."""
    return max(4, parts // 4)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of documents linked by ``den * intersection >= num * union`` of their shingle sets.

    Returns one row per row of ``docs``: ``id_col``, n_shingles (set size) and component_id, the
    smallest id reachable by links, itself included.

    Null text, empty text and text without words: set size 0, linked with nothing. Null id: it is
    sized, but linked with nothing, and its component_id is null. Repeated rows: each is returned, in
    one class. Rows that share an id and differ in text are one document with several texts; it is
    linked wherever one of them is. Empty table: no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    parts = n_parts(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = cut(texts.mapInArrow(_scan(n), "id long, n int, digest binary, outline binary, piece int, counts binary"))
    rows = scanned.filter("piece is null").select("id", "n", "digest")
    outlines = scanned.filter("piece is null and n > 0").groupBy(F.col("id").alias("node")).agg(F.when(F.min("digest") == F.max("digest"), F.min("outline")).alias("outline"))
    rarity = spark.sparkContext.broadcast(_rarity(scanned))
    # Ids of several texts keep their own name, as a node's texts are those of the id it is named by.
    odd = outlines.filter("outline is null").select(F.col("node").alias("id"))

    # Rows with equal sets are one node, named by the smallest id.
    sets = rows.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    named = rows.join(sets.filter("copies > 1").select("digest", "node"), "digest").filter("id <> node").select("id", "node")
    equal = named.select(F.col("id").alias("u"), F.col("node").alias("v"))

    found = texts.mapInArrow(_prefixes(n, num, den, rarity), "token long, id long, size long, salt int")
    found = found.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt").mapInArrow(_shared(num, den), "token long, id long, size long, salt int, head long")
    # Two numbers are kept as one, as these are the rows that take most disk.
    found = _unpacked(cut(found.select("token", "id", "head", _packed("size", F.col("salt") + 1))), "size", "salt").withColumn("salt", F.col("salt") - 1)
    renamed = cut(named.join(odd, "id", "left_anti").groupBy("id").agg(F.min("node").alias("node")))
    found = found.join(renamed.hint(_how(renamed.count())), "id", "left").select("token", "size", "salt", "head", F.coalesce("node", "id").alias("node"))
    ends = found.filter("size < 0").groupBy("node").agg(F.when(F.min("token") == F.max("token"), F.min("token")).alias("ends"))
    # A node that was renamed comes with the salts and heads of its copies; one is enough where they meet all.
    # Rows are dealt out by node once, for all that follows.
    found = found.filter("size >= 0").repartition(parts, "node").groupBy("node", "size", "token").agg(F.min(F.struct("salt", "head")).alias("at"))
    # A node's tokens are kept as one row, in their order: so a token stands where it does among those of the
    # document's prefix that others have too.
    tokens = F.sort_array(F.collect_list(F.struct(F.col("token").bitwiseXOR(F.lit(_SIGN)).alias("token"), "at.salt", "at.head")))
    found = found.groupBy("node", "size").agg(tokens.alias("rows")).join(outlines, "node", "left").join(ends, "node", "left")
    arrays = [F.transform("rows", lambda r: r["token"].bitwiseXOR(F.lit(_SIGN))).alias("tokens"), F.col("rows.head").alias("heads"), F.col("rows.salt").alias("salts")]
    nodes = cut(found.select("node", "size", F.coalesce("outline", F.lit(_NO_OUTLINE)).alias("outline"), F.coalesce("ends", F.lit(0)).alias("ends"), *arrays))

    # What a task finds twice it gives out once, so tokens of one group of documents meet in some tasks.
    few = _of_nodes(nodes).withColumn("key", F.xxhash64("token", "salt")).repartition(parts, "head", F.pmod("token", F.lit(_spread(parts))), "salt").sortWithinPartitions("key", "size", "node")
    few = few.select("key", "node", F.col("node").alias("root"), "size", "rank", "shared", "ends", "outline")
    pairs = cut(few.mapInArrow(_meet(num, den), "a long, b long").distinct())
    links = equal.union(cut(_links(spark, texts, pairs, n, num, den)))
    roots = components(links)
    nodes = nodes.join(roots.hint(_how(roots.count())), "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = _last_links(spark, texts, nodes, n, num, den)
    # What is linked now are classes, of which their roots are the names.
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    out = rows.join(roots, rows.id == roots.node, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each class, the document with the smallest id; others go. Rows with a null id stay.

    Repeated rows of a document that stays all stay. All columns of ``docs`` are returned as they are.
    """
    (gone,) = unused(docs, "gone")
    classes = jaccard_classes(docs, id_col, text_col, **how)
    gone_ids = cut(classes.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct())
    n_gone = gone_ids.count()
    if _how(n_gone) == "broadcast":
        return docs.join(gone_ids.hint("broadcast"), docs[id_col] == gone_ids[gone], "left_anti")
    # Only documents that seem to go move to where that is seen; the others stay in any case.
    cell, had = _bits(gone_ids.select(F.col(gone).alias("id")), n_gone)
    seems = F.arrow_udf(had, "boolean")(cell(docs[id_col].cast("long")))
    perhaps = docs.filter(seems)
    return docs.filter(~seems).union(perhaps.join(gone_ids.hint("merge"), perhaps[id_col] == gone_ids[gone], "left_anti"))
