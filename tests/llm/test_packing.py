from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import packing
from tests.llm import edge


def check(rows, got, lengths):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
        docs[r.doc_id, r.nth].append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: (r.offset, r.size)):
            assert r.offset == at
            at += r.size
        assert parts[0].capacity == min(n for n in lengths if n >= at)
    want, have = defaultdict(list), defaultdict(list)
    for r in rows:
        want[r[0]].append(len(edge.words(r[1])))
    by_row = defaultdict(list)
    for r in got:
        by_row[r.doc_id].append(r)
    for doc, parts in by_row.items():
        have[doc] = sum(r.size for r in parts)
        for r in parts:
            assert r.start == r.part * lengths[-1] and r.size <= lengths[-1]
    assert dict(have) == {k: sum(v) for k, v in want.items()}


def test_edges(spark):
    for rows in (edge.texts(), edge.texts() + [edge.row(100 + i, edge.prose(i, 1 + i * 37 % 900)) for i in range(300)]):
        got = packing.pack_documents(edge.frame(spark, rows), packer_rows=50).collect()
        check(rows, got, packing.LENGTHS)
        assert len({(r.doc_id, r.nth, r.part, r.size) for r in got}) == len(got)
    assert packing.pack_documents(edge.empty(spark)).collect() == []


def test_little_is_wasted(spark):
    rows = [edge.row(i, edge.prose(i, 1 + i * 37 % 400)) for i in range(1500)]
    got = packing.pack_documents(edge.frame(spark, rows), lengths=(128, 256, 512)).collect()
    bins = {r.bin: r.capacity for r in got}
    assert sum(r.size for r in got) / sum(bins.values()) > 0.97


def test_reruns_agree(spark):
    rows = edge.texts() + [edge.row(100 + i, edge.prose(i, 1 + i * 37 % 900)) for i in range(100)]
    one, two = (sorted(map(str, packing.pack_documents(edge.frame(spark, rows).repartition(n), packer_rows=40).collect())) for n in (2, 7))
    assert one == two


def plain(sizes, lengths):
    """Best fit by looking at all bins, and all pieces left, each time."""
    rooms, limit, at = [], [], []
    for nth, size in enumerate(sizes):
        fits = [(room, -last, b) for b, (room, last) in enumerate(rooms) if room >= size]
        if fits:
            b = min(fits)[2]
        else:
            costs = []
            for length in lengths:
                if length >= size:
                    left = length - size
                    for piece in sizes[nth + 1 :]:
                        left -= piece if piece <= left else 0
                    costs.append(((left + packing.BIN_COST) / max(1, length - left), length))
            b = len(rooms)
            rooms.append((min(costs)[1], 0))
        rooms[b] = (rooms[b][0] - size, nth)
        at.append(b)
    return at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=30))
def test_best_fit_against_all_bins(sizes):
    lengths = (8, 16, 32, 64)
    sizes = sorted(sizes, reverse=True)
    at, offset, limit = packing.pack(sizes, lengths)
    assert at == plain(sizes, lengths)
    content = defaultdict(int)
    for size, b, o in zip(sizes, at, offset, strict=True):
        assert o == content[b]
        content[b] += size
    assert all(limit[b] == min(n for n in lengths if n >= c) for b, c in content.items())


def test_lengths_are_compared_also_with_pieces_of_no_words():
    sizes = [300] * 4 + [212] * 4 + [1, 0]
    # 300 + 212 fill 512 words without padding, and so do four of each 2,048, at less cost a word.
    assert sorted(packing.pack(sizes)[2]) == [512, 2048]
    assert packing.pack([300, 212], (512, 4096))[2] == [512]
    assert packing.padding(724, [300, 300, 212, 212, 1], 0) == 123
