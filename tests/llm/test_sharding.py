from collections import Counter

import pytest

from shardloom.llm import sharding
from tests.llm import edge


def test_every_slot_is_claimed_evenly():
    table = sharding.fill([f"x{k}" for k in range(10)], 499)
    assert set(Counter(table).values()) <= {49, 50}


def test_few_rows_move_when_a_shard_goes():
    names = [f"x{k}" for k in range(20)]
    before, after = sharding.fill(names, 4099), sharding.fill(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * len(before)


def test_rows_are_placed_by_key(spark):
    rows = [edge.row(i, "t") for i in range(2000)] + edge.texts()
    got = sharding.place(edge.frame(spark, rows), "doc_id", 8, 1009)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns[:-2] == edge.frame(spark).columns and len(set(map(str.lower, got.columns))) == len(got.columns)
    out = got.collect()
    assert len(out) == len(rows)
    by_key = {}
    for r in out:
        assert by_key.setdefault(r.doc_id, r[-1]) == r[-1]
    n = Counter(r[-1] for r in out)
    assert len(n) == 8 and max(n.values()) < 1.4 * min(n.values())
    assert sharding.place(edge.empty(spark), "doc_id").collect() == []


def test_bad_tables():
    for shards, slots in (([], 7), (["a"], 8), (list("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)
