"""Exact top-k by inner product, with M-trees searched best first.

Inner product becomes a metric: with M no less than any norm, a vector v gets one more component,
sqrt(M^2 - |v|^2), and a query gets 0. Then |q' - v'|^2 = |q|^2 + M^2 - 2 q.v, so the nearest vectors
have the highest products. A tree's leaves are pages of vectors; each node has a routing vector and a
covering radius, and each child and vector its distance to that of its parent. A query keeps the nodes
it may still need in a heap, by their least possible distance, and stops where that exceeds its k-th;
the stored distances spare it the routing vectors and products that the triangle inequality excludes.

Vectors go to trees by the nearest of some pivots, so near ones share a tree; a pivot of very many
vectors has several. A query first searches the tree that may hold the nearest vectors, then all others
whose own radius doesn't exclude them by the k-th score found there. Queries travel to trees.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.base import cut, n_parts, prepare

#: Vectors of a tree, about, unless there are MOST_TREES; vectors of a page; children of a node; queries that visit a tree in one task.
TREE_ROWS, PAGE_ROWS, FAN, QUERY_ROWS = 4096, 128, 16, 4096
MOST_TREES = 8192
#: Queries that a task takes through a tree together at most.
TOGETHER = 1024
#: Rows, those of the lowest MD5 of their id, by which pivots are chosen and their shares of all rows are estimated.
SAMPLE = 32_768


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, components floor(256 x) as doubles, square of the norm) of the vectors that take part."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values
        known = np.concatenate(([0], np.cumsum(np.asarray(values.is_valid()))))
        numbers = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            whole = np.floor(numbers * 256.0)
        finite = np.concatenate(([0], np.cumsum(np.isfinite(numbers))))
        start, end = bounds[:-1], bounds[1:]
        size = end - start
        ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (size > 0) & (known[end] - known[start] == size) & (finite[end] - finite[start] == size)
        if not np.isfinite(whole[np.isfinite(numbers)]).all():
            raise OverflowError("256 times a component is beyond the range of doubles")
        at = np.flatnonzero(ok).tolist()
        with np.errstate(over="ignore"):
            norms = [float((whole[start[i] : end[i]] ** 2).sum()) for i in at]
        found = [whole[start[i] : end[i]].tobytes() for i in at]
        yield pa.record_batch([ids.filter(pa.array(ok)).cast(pa.int64()), pa.array(size[ok], pa.int32()), pa.array(found, pa.binary()), pa.array(norms, pa.float64())], ["id", "size", "vector", "norm"])


def _exact(vectors: np.ndarray, top: float) -> np.ndarray:
    """Whole numbers held as doubles, as numbers of which products and their sums are exact."""
    if top < 2.0**52:
        return vectors
    return vectors.astype(np.int64) if top < 2.0**62 else np.array([[int(x) for x in v] for v in vectors], object)


def _raised(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(1), 0))])


class Tree:
    """An M-tree over vectors of one length, bulk loaded."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float) -> None:
        """``top``: no less than the square of any vector's norm."""
        points = _raised(vectors, top)
        random = np.random.Generator(np.random.PCG64(len(ids)))
        order: list[np.ndarray] = []
        self.routing: list[np.ndarray] = []  # of each node, as the other columns
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[tuple[int, int]] = []  # a range of nodes, or for a leaf of vectors
        self.leaf: list[bool] = []
        # Node by node in breadth, so that the children of one follow one another.
        waiting: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), -1)]
        middles: list[int] = []
        done, placed = 0, 0
        while done < len(waiting):
            rows, parent = waiting[done]
            done += 1
            middle = int(rows[((points[rows] - points[rows].mean(0)) ** 2).sum(1).argmin()])
            middles.append(middle)
            self.routing.append(vectors[middle])
            self.radius.append(float(np.sqrt(((points[rows] - points[middle]) ** 2).sum(1).max())))
            self.to_parent.append(0.0 if parent < 0 else float(np.sqrt(((points[middle] - points[middles[parent]]) ** 2).sum())))
            if len(rows) <= PAGE_ROWS:
                self.leaf.append(True)
                self.children.append((placed, placed + len(rows)))
                order.append(rows)
                placed += len(rows)
                continue
            seeds = random.choice(rows, min(FAN, -(-2 * len(rows) // PAGE_ROWS)), replace=False)
            at = ((points[seeds] ** 2).sum(1)[None] - 2 * points[rows] @ points[seeds].T).argmin(1)
            parts = [x for k in range(len(seeds)) if len(x := rows[at == k])]
            if len(parts) == 1:  # all alike
                step = -(-len(rows) // FAN)
                parts = [rows[k : k + step] for k in range(0, len(rows), step)]
            self.leaf.append(False)
            self.children.append((len(waiting), len(waiting) + len(parts)))
            waiting += [(x, done - 1) for x in parts]
        rows = np.concatenate(order)
        self.ids, self.exact = ids[rows], _exact(vectors, top)[rows]
        owner = np.repeat([k for k, x in enumerate(self.leaf) if x], [len(x) for x in order])
        self.to_page = np.sqrt(((points[rows] - points[np.array(middles)[owner]]) ** 2).sum(1))
        self.routing, self.radius, self.to_parent = np.array(self.routing), np.array(self.radius), np.array(self.to_parent)
        self.top = top
        self.computed = 0

    def search(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the query's ``k`` best, best first, ties to smaller ids; scores below ``least`` may be left out."""
        square = float((query**2).sum())
        slack = 1e-7 * (self.top + square) ** 0.5 + 1e-6  # what rounding may do to a small distance of large vectors
        exact = _exact(query[None], max(self.top, square))[0]
        vectors = self.exact if self.exact.dtype == exact.dtype else _exact(self.exact.astype(np.float64), max(self.top, square))
        found: list[tuple[int, int]] = []  # (-score, id)

        def reach_of(score: int) -> float:
            return max(square + self.top - 2.0 * float(score), 0) ** 0.5 + slack

        reach = np.inf if least is None else reach_of(least)
        first = self._far(query, square, slice(0, 1))[0]
        heap = [(max(first - self.radius[0], 0), 0, first)]
        while heap:
            nearest, node, distance = heapq.heappop(heap)
            if nearest > reach:
                break
            a, b = self.children[node]
            if self.leaf[node]:
                rows = a + np.flatnonzero(np.abs(distance - self.to_page[a:b]) <= reach)
                rows = rows[self.ids[rows] != own]
                if not len(rows):
                    continue
                self.computed += len(rows)
                scores = vectors[rows] @ exact
                if len(found) == k:
                    ok = np.flatnonzero(scores >= -found[-1][0])
                    rows, scores = rows[ok], scores[ok]
                for item in sorted(zip((-scores).tolist(), self.ids[rows].tolist(), strict=True))[:k]:
                    insort(found, (int(item[0]), item[1]))
                del found[k:]
                if len(found) == k:
                    reach = min(reach, reach_of(-found[-1][0]))
                continue
            nodes = a + np.flatnonzero(np.abs(distance - self.to_parent[a:b]) - self.radius[a:b] <= reach)
            self.computed += len(nodes)
            for child, far in zip(nodes.tolist(), self._far(query, square, nodes).tolist(), strict=True):
                if far - self.radius[child] <= reach:
                    heapq.heappush(heap, (max(far - self.radius[child], 0), child, far))
        return [(-score, doc) for score, doc in found]

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int, least: list[int | None]) -> list[list[tuple[int, int]]]:
        """What :meth:`search` gives for each of many queries, which take their next pages at the same time.

        Those that come to one page at once share its products, so a query costs few calls.
        """
        squares = (queries**2).sum(1)
        if max(self.top, float(squares.max(initial=0.0))) >= 2.0**52:  # beyond doubles
            return [self.search(int(doc), query, k, x) for doc, query, x in zip(own, queries, least, strict=True)]
        slack = 1e-7 * (self.top + squares) ** 0.5 + 1e-6

        def reach_of(scores: np.ndarray, which) -> np.ndarray:
            return np.sqrt(np.maximum(squares[which] + self.top - 2.0 * scores, 0)) + slack[which]

        reach = np.array([np.inf if x is None else float(x) for x in least])
        known = np.isfinite(reach)
        reach[known] = reach_of(reach[known], known)
        far = np.sqrt(np.maximum(squares[:, None] + self.top - 2 * queries @ self.routing.T, 0))
        bound = np.maximum(far - self.radius, 0)
        for node, (a, b) in enumerate(self.children):  # parents come first
            if not self.leaf[node]:
                bound[:, a:b] = np.maximum(bound[:, a:b], bound[:, node : node + 1])
        pages = np.flatnonzero(self.leaf)
        turn = bound[:, pages].argsort(1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        active = np.arange(len(queries))
        for step in range(len(pages)):
            page = pages[turn[active, step]]
            on = bound[active, page] <= reach[active]
            active, page = active[on], page[on]
            if not len(active):
                break
            order = page.argsort(kind="stable")
            for group in np.split(active[order], np.flatnonzero(np.diff(page[order])) + 1):
                node = int(pages[turn[group[0], step]])
                a, b = self.children[node]
                ok = np.abs(far[group, node][:, None] - self.to_page[a:b]) <= reach[group][:, None]
                rows = a + np.flatnonzero(ok.any(0))
                if not len(rows):
                    continue
                self.computed += len(group) * len(rows)
                scores = queries[group] @ self.exact[rows].T
                scores[self.ids[rows] == own[group][:, None]] = -np.inf
                better = scores >= best[group, -1:]
                better &= scores > -np.inf
                which, column = np.nonzero(better)
                if not len(which):
                    continue
                some, place = np.unique(which, return_inverse=True)
                group = group[some]
                place = np.concatenate([np.repeat(np.arange(len(group)), k), place])
                found = np.concatenate([best[group].ravel(), scores[which, column]])
                names = np.concatenate([ids[group].ravel(), self.ids[rows[column]]])
                at = np.lexsort((names, -found, place))
                at = at[np.searchsorted(place[at], np.arange(len(group)))[:, None] + np.arange(k)]
                best[group], ids[group] = found[at], names[at]
                full = group[best[group, -1] > -np.inf]
                reach[full] = np.minimum(reach[full], reach_of(best[full, -1], full))
        return [[(int(x), int(i)) for x, i in zip(*row, strict=True) if x > -np.inf] for row in zip(best.tolist(), ids.tolist(), strict=True)]

    def _far(self, query: np.ndarray, square: float, nodes) -> np.ndarray:
        return np.sqrt(np.maximum(square + self.top - 2 * self.routing[nodes] @ query, 0))


def _deal(sample: list[tuple[int, bytes]], n: int, tree_rows: int, n_pivots: int):
    """(tree, id, length, vector): a row's tree is named by its length, nearest pivot and, for pivots of many rows, a salt."""
    pivots: dict[int, np.ndarray] = {}
    for size in {size for size, _ in sample[:n_pivots]}:
        pivots[size] = np.unique(np.frombuffer(b"".join(v for s, v in sample[:n_pivots] if s == size), np.float64).reshape(-1, size), axis=0)

    def nearest(size: int, vectors: np.ndarray) -> np.ndarray:
        if size not in pivots:
            return np.full(len(vectors), -1)
        own = pivots[size]
        return np.concatenate([((own**2).sum(1)[None] - 2 * vectors[k : k + 4096] @ own.T).argmin(1) for k in range(0, len(vectors), 4096)])

    salts: dict[tuple[int, int], int] = {}
    for size in {size for size, _ in sample}:
        vectors = np.frombuffer(b"".join(v for s, v in sample if s == size), np.float64).reshape(-1, size)
        for pivot, count in zip(*np.unique(nearest(size, vectors), return_counts=True), strict=True):
            salts[size, int(pivot)] = max(1, round(count * n / len(sample) / tree_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            vectors = batch.column(2).to_pylist()
            trees = [""] * len(ids)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size).tolist()
                for i, pivot in zip(at, nearest(size, np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), -1)).tolist(), strict=True):
                    trees[i] = f"{size}-{pivot}-{zlib.crc32(b'%d' % ids[i]) % salts.get((size, pivot), 1)}"
            yield pa.record_batch([pa.array(trees, pa.string()), *batch.columns[:3]], ["tree", "id", "size", "vector"])

    return run


def _plant(top: float):
    """A tree for each value of the first column, of rows sorted by it."""

    def planted(name: str, rows: list[tuple]) -> pa.RecordBatch:
        tree = Tree(np.array([x[0] for x in rows], np.int64), np.frombuffer(b"".join(x[2] for x in rows), np.float64).reshape(len(rows), -1), top)
        cols = [[name], [rows[0][1]], [tree.routing[0].tobytes()], [float(tree.radius[0])], [pickle.dumps(tree, pickle.HIGHEST_PROTOCOL)]]
        return pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.binary()), strict=True)], ["tree", "size", "routing", "radius", "made"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for tree, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if tree != key and rows:
                    yield planted(key, rows)
                    rows = []
                key = tree
                rows.append(row)
        if rows:
            yield planted(key, rows)

    return run


def _route(sent, top: float, first: bool):
    """(tree, id, vector, least) of queries (id, length, vector, least): the first tree of each, or all others that it may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[int, tuple] = {}
        for size in {r[1] for r in sent.value}:
            own = [r for r in sent.value if r[1] == size]
            roots[size] = ([r[0] for r in own], np.frombuffer(b"".join(r[2] for r in own), np.float64).reshape(len(own), -1), np.array([r[3] for r in own]))
        for batch in batches:
            out: list[tuple] = []
            for doc, size, raw, least in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size not in roots:
                    continue
                names, routing, radius = roots[size]
                query = np.frombuffer(raw, np.float64)
                square = float((query**2).sum())
                nearest = np.maximum(np.sqrt(np.maximum(square + top - 2 * routing @ query, 0)) - radius, 0)
                best = int(nearest.argmin())
                if first:
                    out.append((names[best], doc, raw, None))
                    continue
                reach = np.inf if least is None else max(square + top - 2.0 * least, 0) ** 0.5 + 1e-7 * (top + square) ** 0.5 + 1e-6
                out += [(names[t], doc, raw, least) for t in np.flatnonzero(nearest <= reach).tolist() if t != best]
            for k in range(0, len(out), 5000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[k : k + 5000], strict=True), (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["tree", "id", "vector", "least"])

    return run


def _search(k: int):
    """Rows sorted by tree and block of queries: the tree itself, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, asked = None, []

        def found() -> Iterator[pa.RecordBatch]:
            queries = np.array([np.frombuffer(x, np.float64) for _, x, _ in asked])
            out: list[tuple] = []
            for (doc, _, _), best in zip(asked, tree.search_all(np.array([x for x, _, _ in asked], np.int64), queries, k, [x for _, _, x in asked]), strict=True):
                for score, other in best:
                    if abs(score) >= 1 << 63:
                        raise OverflowError("a score doesn't fit in a long")
                    out.append((doc, other, score))
            asked.clear()
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for made, doc, vector, least in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if made is not None:
                    if asked:
                        yield from found()
                    tree = pickle.loads(made)
                    continue
                asked.append((doc, vector, least))
                if len(asked) == TOGETHER:
                    yield from found()
        if asked:
            yield from found()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows.

    Queries are the rows whose id is divisible by ``every``. Returns query_id, rank (from 1), ``id_col``
    and score; ties go to smaller ids; fewer rows where there are fewer candidates.

    Vectors that are null or empty, or hold a null or a value that isn't finite, take no part, nor do
    rows with a null id. Vectors of another length than the query's are no candidates. Rows that repeat
    an id are candidates each, but none of them for that id's own query, which counts once: its shortest
    vector, the lowest of equals. Components are exact, however large; a score of the result that doesn't
    fit in a long, and a component over 2^1015, are an OverflowError. Empty table: no rows.
    """
    spark = prepare(vectors.sparkSession)
    parts = n_parts(spark)
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_parse, "id long, size int, vector binary, norm double"))
    asks = F.col("id") % every == 0
    n, n_queries, top = rows.agg(F.count("*"), F.coalesce(F.sum(asks.cast("long")), F.lit(0)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    n_pivots = min(MOST_TREES, max(1, -(-n // TREE_ROWS)))
    sample = [(r.size, bytes(r.vector)) for r in rows.orderBy(F.md5(F.col("id").cast("string")), "id", "vector").limit(SAMPLE).select(F.col("size"), "vector").collect()] if n else []
    dealt = rows.mapInArrow(_deal([(a, b) for a, b in sample], n, max(TREE_ROWS, n // MOST_TREES), n_pivots), "tree string, id long, size int, vector binary")
    trees = cut(dealt.repartition(parts, "tree").sortWithinPartitions("tree", "id", "vector").mapInArrow(_plant(float(top)), "tree string, size int, routing binary, radius double, made binary"))
    roots = spark.sparkContext.broadcast([(r.tree, r["size"], bytes(r.routing), r.radius) for r in trees.drop("made").collect()])
    queries = rows.filter(asks).groupBy("id").agg(F.min(F.struct("size", "vector")).alias("v")).select("id", "v.size", "v.vector")
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    schema = "tree string, id long, vector binary, least long"

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        sent = trees.join(asked.select("tree", "block").distinct(), "tree").select("tree", "block", "made", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("vector"), F.lit(None).cast("long").alias("least"))
        both = sent.union(asked.select("tree", "block", F.lit(None).cast("binary"), "id", "vector", "least"))
        both = both.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", F.col("id").asc_nulls_first())
        return both.select("made", "id", "vector", "least").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    found = cut(search(queries.withColumn("least", F.lit(None).cast("long")).mapInArrow(_route(roots, float(top), True), schema)))
    least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = queries.join(least, "id", "left").select("id", "size", "vector", "least").mapInArrow(_route(roots, float(top), False), schema)
    both = found.union(search(cut(rest)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
