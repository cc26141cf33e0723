from collections import defaultdict

import pytest

from shardloom.llm import mixing
from tests.llm import edge


def water(sizes):
    """Targets by filling up round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        left, by = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / by > 3 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / by for s in open_}
        full |= {s: 3.0 * sizes[s] for s in over}


def corpus():
    rows = [edge.row(i, edge.prose(i, 5 + i * 7 % 60), f"s{i % 4}") for i in range(600)]
    return rows + [edge.row(1000 + i, edge.prose(i, 12), "tiny") for i in range(3)] + [edge.row(2000, "a b c", None)] + edge.texts()


@pytest.mark.parametrize("bucket", [4096, 16])
def test_targets_are_met(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = corpus()
    got = mixing.mix(edge.frame(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(edge.words(r[1]))
    want = water(sizes)
    by_size = defaultdict(list)
    for r in got:
        by_size[r.source_size].append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
    for source, size in sizes.items():
        assert all(abs(r.target - want[source]) < 1e-6 * (1 + want[source]) or sum(s == size for s in sizes.values()) > 1 for r in by_size[size])
        if sum(s == size for s in sizes.values()) == 1:
            assert abs(sum(r.taken for r in by_size[size]) - want[source]) <= max(r.size for r in by_size[size])


def test_reruns_agree(spark):
    rows = corpus()
    one, two = (sorted(map(str, mixing.mix(edge.frame(spark, rows).repartition(n)).collect())) for n in (2, 9))
    assert one == two


def test_take_repeats_rows(spark):
    docs = edge.frame(spark, corpus())
    got = mixing.take(docs)
    assert got.columns == docs.columns
    copies = mixing.mix(docs).groupBy("doc_id").sum("copies").collect()
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["sum(copies)"] for r in copies if r["sum(copies)"]}


def test_take_gives_the_same_rows_each_time(spark):
    rows = corpus() + [(*edge.row(3, edge.prose(3, 26), "s3")[:-1], f"v{k}") for k in range(5)]
    one, two = (sorted(map(str, mixing.take(edge.frame(spark, r).repartition(n)).collect())) for n, r in ((2, rows), (7, rows[::-1])))
    assert one == two


def test_empty_and_wordless(spark):
    assert mixing.mix(edge.empty(spark)).collect() == []
    got = mixing.mix(edge.frame(spark, [edge.row(1, None), edge.row(2, " ")])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_transfer_keeps_words_and_expectation():
    for p, a, q, b in [(0.3, 5, 0.4, 9), (0.9, 100, 0.8, 3), (0.5, 1, 0.5, 1)]:
        up, down = (mixing.transfer(p, a, q, b, u) for u in (0.0, 0.999999))
        share = min(p, (1 - q) * b / a) / (min(1 - p, q * b / a) + min(p, (1 - q) * b / a))
        for x, y in (up, down):
            assert abs(x * a + y * b - p * a - q * b) < 1e-6 * (a + b)
            assert x in (0, 1) or y in (0, 1)
        assert abs(share * up[0] + (1 - share) * down[0] - p) < 1e-6
