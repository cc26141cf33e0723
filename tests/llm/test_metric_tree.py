import math
import random

import numpy as np
import pytest

from shardloom.llm import metric_tree

SCHEMA = "vec_id long, embedding array<float>, label int, id long, norm double, tree string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2.0, "x") for i, v in rows], SCHEMA)


def quantised(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return np.array([math.floor(256 * float(np.float32(x))) for x in v], object)


def expected(rows, k=5, every=50):
    known = [(i, q) for i, v in rows if i is not None and (q := quantised(v)) is not None]
    out, done = [], set()
    for i, q in known:
        if i % every == 0 and i not in done:
            done.add(i)
            found = sorted((-int(q @ v), j) for j, v in known if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "TREE_ROWS", 100)
    monkeypatch.setattr(metric_tree, "PAGE_ROWS", 8)
    monkeypatch.setattr(metric_tree, "QUERY_ROWS", 3)
    monkeypatch.setattr(metric_tree, "SAMPLE", 50)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties
    assert sorted(map(tuple, metric_tree.top_k(frame(spark, rows)).collect())) == expected(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.5, -1.0]), (50, [3.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (100, [2.0, 2.0])]
    assert sorted(map(tuple, metric_tree.top_k(frame(spark, rows)).collect())) == expected(rows)
    assert metric_tree.top_k(frame(spark, [])).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e8, 1.0]), (1, [3.0, 4.0]), (2, [1e6, 1.5]), (3, [-7e5, 2.0]), (50, [0.25, -3e5]), (4, [1e-3, 1e6])]
    want = expected(rows)
    assert max(abs(r[3]) for r in want) > 1 << 62 and (0, 2, 1, 19660800262144) in want
    assert sorted(map(tuple, metric_tree.top_k(frame(spark, rows)).collect())) == want


def test_a_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="doesn't fit in a long"):
        metric_tree.top_k(frame(spark, [(0, [1e10]), (1, [1e10])])).collect()


def test_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "TREE_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    assert sorted(map(tuple, metric_tree.top_k(frame(spark, rows)).collect())) == expected(rows)


def test_bounds_spare_work_where_there_is_structure():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (20, 8))
    vectors = np.concatenate([c + rng.integers(-20, 20, (200, 8)) for c in centres]).astype(float)
    tree = metric_tree.Tree(np.arange(len(vectors)), vectors, float((vectors**2).sum(1).max()))
    tree.search(-5, vectors[0], 5)
    assert tree.computed < len(vectors) / 4
    assert max(len(tree.routing[a:b]) for (a, b), leaf in zip(tree.children, tree.leaf, strict=True) if not leaf) <= metric_tree.FAN


@pytest.mark.parametrize("scale", [1, 1 << 22, 1 << 40])
def test_scores_are_exact(scale):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-100 * scale, 100 * scale, (300, 4))
    tree = metric_tree.Tree(np.arange(300), vectors.astype(float), float((vectors.astype(float) ** 2).sum(1).max()))
    for q in range(10):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], vectors[j], strict=True)), j) for j in range(300) if j != q)[:5]
        assert [(-s, i) for s, i in tree.search(q, vectors[q].astype(float), 5)] == want


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_queries_that_go_together_find_the_same_for_less(spread):
    """As many products at most as when each goes alone, or nearly, in less time where bounds exclude nothing."""
    import time

    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32))
    vectors = np.floor(256 * (centres[rng.integers(0, 40, 4000)] * (spread < 1) + spread * rng.standard_normal((4000, 32))))
    vectors[10:30] = vectors[10]
    ids = np.arange(4000, dtype=np.int64) * 3
    top = float((vectors**2).sum(1).max())
    asked, least = np.arange(0, 4000, 20), [None] * 199 + [0]
    one, all_ = metric_tree.Tree(ids, vectors, top), metric_tree.Tree(ids, vectors, top)
    began = time.process_time()
    want = [one.search(int(ids[q]), vectors[q], 5, x) for q, x in zip(asked, least, strict=True)]
    alone = time.process_time() - began
    began = time.process_time()
    got = all_.search_all(ids[asked], vectors[asked], 5, least)
    together = time.process_time() - began
    assert [[x for x in r if x[0] >= 0] for r in got] == [[x for x in r if x[0] >= 0] for r in want] and got[:-1] == want[:-1]
    assert all_.computed <= 1.5 * one.computed
    print(f"alone {alone:.3f} s, {one.computed} products; together {together:.3f} s, {all_.computed}")
    assert spread < 1 or together < alone
