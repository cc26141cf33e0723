import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm.exact_dedup import drop_copies, exact_groups
from shardloom.llm.radix import RadixTrie
from tests.llm import edge


def expected(rows, largest=True):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("max_bytes", [1 << 20, 2000])
def test_groups(spark, keep, max_bytes):
    got = exact_groups(edge.frame(spark), keep=keep, max_bytes=max_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(edge.texts(), keep == "largest")


def test_drop_copies_keeps_one_row_of_each_text(spark):
    docs = edge.frame(spark)
    got = drop_copies(docs, keep="largest")
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.text or "") for r in rows) == sorted({r[1] or "" for r in edge.texts()})
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(x[0]) for x in expected(edge.texts()) if x[3])


def test_rows_that_tie_are_chosen_by_their_columns(spark):
    rows = [(*edge.row(5, "twice")[:-1], f"v{k}") for k in range(6)] + [(*edge.row(None, "x")[:-1], f"w{k}") for k in range(3)]
    one, two = (sorted(map(str, drop_copies(edge.frame(spark, r).repartition(n), keep="largest").collect())) for n, r in ((2, rows), (5, rows[::-1])))
    assert one == two and len(one) == 2 and "v0" in one[0] + one[1] and "w0" in one[0] + one[1]


def test_empty(spark):
    assert exact_groups(edge.empty(spark)).collect() == []
    assert drop_copies(edge.empty(spark)).collect() == []


def test_many_copies_in_many_tasks(spark):
    rows = [edge.row(i, "the same text") for i in range(3000)] + [edge.row(10_000 + i, f"text {i}") for i in range(50)]
    got = exact_groups(edge.frame(spark, rows).repartition(9), keep="largest").collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 3000} == {(2999, 3000)}
    assert sum(r.kept for r in got) == 51


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12).map(str.encode)), st.integers(0, 4000))
def test_trie_holds_what_a_dict_holds(keys, max_bytes):
    trie, known = RadixTrie(lambda a, b: a + b, max_bytes), defaultdict(int)
    for k in keys:
        trie.insert(k, 1)
        known[k] += 1
    assert list(trie.items()) == sorted(known.items())
