import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import substring_dedup
from tests.llm import edge


def planted(seed):
    """Documents of own words, some with a passage that others have too, word for word or nearly."""
    rng, rows, having = random.Random(seed), [], set()
    passages = [edge.prose(seed * 50 + k, n).split() for k, n in enumerate((60, 80, 150, 400))]
    for i in range(80):
        own = edge.prose(seed * 1000 + 100 + i, rng.randint(20, 200)).split()
        if i % 4 == 0:
            copy = list(passages[i // 4 % len(passages)])
            for _ in range(len(copy) // 25):
                k = rng.randrange(8, len(copy) - 8)
                copy[k : k + rng.choice([1, 2])] = rng.choice([["new"], [], ["two", "words"]])
            at = rng.randrange(len(own))
            own[at:at] = copy
            having.add(i)
        rows.append(edge.row(i, " ".join(own)))
    return rows, having


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_found_and_nothing_else(spark, seed):
    rows, having = planted(seed)
    got = substring_dedup.repeats(edge.frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == having
    text = {r[0]: edge.words(r[1]) for r in rows}
    for r in got:
        assert r.n_words >= 50 and r.other_words >= 50 and 0.8 <= r.identity <= 1
        assert r.start + r.n_words <= len(text[r.doc_id]) and r.other_start + r.other_words <= len(text[r.other_id])
        assert len(set(text[r.doc_id][r.start : r.start + r.n_words]) & set(text[r.other_id][r.other_start : r.other_start + r.other_words])) > 30


def test_exact_runs_against_brute_force(spark):
    rng, rows = random.Random(9), []
    shared = [edge.prose(k, 55 + 10 * k).split() for k in range(6)]
    for i in range(60):
        own = edge.prose(500 + i, rng.randint(5, 90)).split()
        own[3:3] = rng.choice(shared) if i % 2 else []
        rows.append(edge.row(i, " ".join(own).upper() if i % 3 else " ".join(own)))
    where = defaultdict(set)
    for r in rows:
        w = edge.words(r[1])
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(r[0])
    want = {i for ids in where.values() if len(ids) > 1 for i in ids}
    assert {r.doc_id for r in substring_dedup.repeats(edge.frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("sent", [500_000, 0])
def test_partly_quoted_passages_against_brute_force(spark, monkeypatch, sent):
    """Parts of a passage are in other documents too, before and between those that have it whole."""
    monkeypatch.setattr(substring_dedup, "MOST_SENT", sent)
    rng, rows = random.Random(4), []
    for case in range(40):
        passage = edge.prose(7000 + case, rng.randint(50, 60)).split()
        half = len(passage) // 2 + rng.randint(-12, 12)
        for part in (passage[:half], passage[half:], passage, passage[:half], passage[half:], passage):
            own = edge.prose(8000 + len(rows), rng.randint(5, 40)).split()
            at = rng.randrange(len(own))
            own[at:at] = part
            rows.append(edge.row(len(rows), " ".join(own)))
    where = defaultdict(set)
    text = {r[0]: edge.words(r[1]) for r in rows}
    for i, w in text.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add((i, k))
    want = {x for found in where.values() if len({i for i, _ in found}) > 1 for x in found}
    got = substring_dedup.repeats(edge.frame(spark, rows)).collect()
    assert want <= {(r.doc_id, r.start + k) for r in got for k in range(r.n_words - 49)}
    assert {r.doc_id for r in got} == {i for i, _ in want}
    for r in got:
        if r.identity == 1:
            assert text[r.doc_id][r.start : r.start + r.n_words] == text[r.other_id][r.other_start : r.other_start + r.other_words]


def test_edits_near_the_ends(spark):
    rows, at = [], {}
    edits = [(54, (k,)) for k in range(1, 13)] + [(54, (53 - k,)) for k in range(1, 13)] + [(55, (4, 50)), (60, (3, 7, 52)), (56, (2, 9, 10, 45, 53))]
    for n, places in edits:
        passage = edge.prose(9000 + len(rows), n).split()
        near = [f"changed{k}" if k in places else w for k, w in enumerate(passage)]
        for copy in (passage, near):
            own = edge.prose(9500 + len(rows), 30).split()
            at[len(rows)] = (12, n)
            rows.append(edge.row(len(rows), " ".join(own[:12] + copy + own[12:])))
    got = {r.doc_id: r for r in substring_dedup.repeats(edge.frame(spark, rows)).collect()}
    assert set(got) == set(at)
    for i, (start, n) in at.items():
        assert got[i].start <= start and got[i].start + got[i].n_words >= start + n and got[i].identity >= 0.8


def test_edges(spark, monkeypatch):
    assert {(r.doc_id, r.other_id) for r in substring_dedup.repeats(edge.frame(spark)).collect()} >= {(1, 2), (2, 1), (3, 1), (1, 3)}
    monkeypatch.setattr(substring_dedup, "MOST_SENT", 0)
    assert {r.doc_id for r in substring_dedup.repeats(edge.frame(spark)).collect()} == {1, 2, 3}
    assert substring_dedup.repeats(edge.empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_best_chain_against_all_predecessors(matches):
    a, b = (np.array(x) for x in zip(*matches, strict=True))
    order = sorted(matches)
    best = []
    for i, (x, y) in enumerate(order):
        best.append(1 + max([0, *(best[j] - (x - p + y - q) / 60 for j, (p, q) in enumerate(order[:i]) if p < x and q < y)]))
    found = substring_dedup.chains(a, b, least=1.0)
    path = found[0]
    assert (np.diff(a[path]) > 0).all() and (np.diff(b[path]) > 0).all()
    score = len(path) - (a[path[-1]] - a[path[0]] + b[path[-1]] - b[path[0]]) / 60
    assert abs(score - max(best)) < 1e-9
    assert len(set(np.concatenate(found))) == sum(map(len, found))


def test_minimizers_cover_every_window():
    runs = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    at = substring_dedup.minimizers(runs, 10)
    assert all(((at >= k) & (at < k + 10)).any() for k in range(len(runs) - 9))
    assert {runs[k : k + 10].min() for k in range(len(runs) - 9)} == set(runs[at])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(x, y):
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    assert substring_dedup._common(x, y) == table[-1, -1]


def quoted(size, edits, seed, cases=6):
    """Two holders of a 200-word passage, edited or not, amid documents that quote pieces of ``size`` words of it."""
    rng, rows, holders = random.Random(seed), [], set()
    for case in range(cases):
        passage = edge.prose(90_000 + seed * 100 + case, 200).split()
        for n, at in enumerate(range(0, 201 - size, max(1, (200 - size) // 50))):
            own = edge.prose(70_000 + seed * 1000 + case * 100 + n, 30).split()
            own[15:15] = passage[at : at + size]
            rows.append(edge.row(case * 1000 + 4 * n + n % 2, " ".join(own)))
        for holder in (500, 501):
            copy = list(passage)
            for _ in range(edits):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[f"new{k}"], [], [f"two{k}", "words"]])
            own = edge.prose(80_000 + seed * 1000 + case * 10 + holder, 40).split()
            own[20:20] = copy
            rows.append(edge.row(case * 1000 + holder, " ".join(own)))
            holders.add(case * 1000 + holder)
    return rows, holders


@pytest.mark.parametrize("size", [16, 20, 30])
def test_no_passage_is_lost_to_those_that_quote_it(spark, size):
    rows, holders = quoted(size, 0, size)
    assert {r.doc_id for r in substring_dedup.repeats(edge.frame(spark, rows)).collect()} == holders


def test_recall_of_edited_passages(spark):
    """Up to 8 edits in either of two copies of 200 words, amid quotations."""
    found, there = 0, 0
    for size, edits in ((16, 4), (20, 8), (30, 8)):
        rows, holders = quoted(size, edits, size + edits)
        got = {r.doc_id for r in substring_dedup.repeats(edge.frame(spark, rows)).collect()}
        assert got <= holders
        found, there = found + len(got), there + len(holders)
    assert found >= 0.95 * there


@pytest.mark.parametrize("frequent", [64, 8])
def test_edited_passages_whose_pieces_are_all_frequent(spark, monkeypatch, frequent):
    """Two holders of a passage, edited in each; its pieces of 20 words are in 30 other documents each."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    rng, rows, holders = random.Random(12), [], set()
    for case in range(5):
        passage = edge.prose(60_000 + case, 160).split()
        pieces = [at for at in range(0, 141, 10) for _ in range(30)]
        rng.shuffle(pieces)  # so some of each come before, between and after the holders
        for n, at in enumerate(pieces):
            own = edge.prose(61_000 + case * 1000 + n, 24).split()
            own[12:12] = passage[at : at + 20]
            rows.append(edge.row(case * 1000 + 2 * n, " ".join(own)))
        for holder in (301, 601):
            copy = list(passage)
            for at in range(9 + 7 * (holder // 600), 160, 25):
                copy[at] = f"new{holder}x{at}"
            own = edge.prose(66_000 + case * 1000 + holder, 40).split()
            own[20:20] = copy
            rows.append(edge.row(case * 1000 + holder, " ".join(own)))
            holders.add(case * 1000 + holder)
    rng.shuffle(rows)
    got = substring_dedup.repeats(edge.frame(spark, rows).repartition(5)).collect()
    assert {r.doc_id for r in got} == holders
    assert {r.doc_id for r in got if r.n_words >= 150 and r.identity >= 0.8} == holders


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 2)), min_size=1, max_size=14, unique_by=lambda x: x[0]))
def test_three_places_of_a_stretch_have_one_that_asks(found):
    found.sort()
    places, kinds = (np.array(x) for x in zip(*found, strict=True))
    ask = substring_dedup._askers(places, kinds > 0, kinds == 2, 45)
    assert not (ask & (kinds != 1)).any()
    for three in itertools.combinations(range(len(places)), 3):
        if places[three[2]] - places[three[0]] <= 45 and any(kinds[i] == 1 for i in three):
            assert ask[list(three)].any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.integers(0, 9), max_size=30)] * 2), min_size=2, max_size=5), st.sampled_from([64, 2048]))
def test_bounds_never_say_less_than_is_common(lists, bits):
    rows = [(i, len(x), 0, np.array([*x, *[77] * 5, *y], np.uint32).tobytes()) for i, (x, y) in enumerate(lists)]
    sides = substring_dedup._sides(rows, 5, 30)
    before, substring_dedup.BITS = substring_dedup.BITS, bits
    try:
        maps, lost = substring_dedup._bitmaps(sides)
    finally:
        substring_dedup.BITS = before
    for i, j in itertools.combinations(range(len(lists)), 2):
        common = sum(sum((Counter(a) & Counter(b)).values()) for a, b in zip(lists[i], lists[j], strict=True))
        assert common <= int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(lost[i], lost[j])
        for side, a, b in ((0, lists[i][0][::-1], lists[j][0][::-1]), (1, lists[i][1], lists[j][1])):
            got = substring_dedup._common_up_to(sides[side][i], sides[side][j : j + 1])[:, 0]
            assert got.tolist() == [substring_dedup._common(a[:n], b) for n in range(31)]


def test_frequent_seeds_are_matched_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 3)
    rng, rows, want = random.Random(3), [], set()
    line, passage = "all rights reserved by the makers of this page".split(), edge.prose(77, 60).split()
    for i in range(120):
        own = edge.prose(6000 + i, 40).split()
        for _ in range(i % 4):
            own[rng.randrange(len(own)) : 0] = line
        if i % 5 == 0:
            own[20:20] = passage
            want.add(i)
        rows.append(edge.row(i + (1 << 60), " ".join(own)))
    got = {r.doc_id - (1 << 60) for r in substring_dedup.repeats(edge.frame(spark, rows).repartition(3)).collect()}
    assert want <= got and len(got - want) < 3


def test_all_documents_of_a_seed_meet():
    rng = np.random.default_rng(2)
    rows = sorted({(int(s), int(d), int(p)) for s, d, p in zip(rng.integers(0, 12, 400), rng.integers(0, 30, 400), rng.integers(0, 9, 400), strict=True)})
    seed, doc, place = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    found = set(zip(*(x.tolist() for x in substring_dedup._matches(seed, doc, place)), strict=True))
    docs = {}
    for s, d, p in rows:
        docs.setdefault(s, {}).setdefault(d, []).append(p)
    for has in docs.values():
        shared = len(has) > 1
        for d, places in has.items():
            for p in places if shared else []:
                assert (d, d, p, p) in found
                for other in sorted(o for o in has if o < d) if len(has) <= substring_dedup.JOINED else [min(has)] if d > min(has) else []:
                    assert (d, other, p, has[other][0]) in found


def test_a_chain_that_is_not_alike_enough_is_cut(spark):
    """Two passages that are shared, with much between that isn't; one is long enough."""
    rows = []
    for case in range(8):
        long_, short = edge.prose(300 + case, 60).split(), edge.prose(400 + case, 30).split()
        for side in range(2):
            own = [edge.prose(9000 + 10 * case + 2 * part + side, n).split() for part, n in enumerate((20, 35, 20))]
            rows.append(edge.row(10 * case + side, " ".join([*own[0], *long_, *own[1], *short, *own[2]])))
    got = substring_dedup.repeats(edge.frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert all(r.identity >= 0.8 and r.n_words >= 50 for r in got)


def lined(n, own, seed, near=()):
    """Rows (document, place, first word, words) around a seed in a line of 12 words that ends each document; those of ``near`` share their other words, but for a few."""
    rng = np.random.default_rng(seed)
    line = np.arange(1, 13, dtype=np.uint32)
    shared = rng.integers(1 << 20, 1 << 31, own).astype(np.uint32)
    rows = []
    for i in range(n):
        x = shared.copy() if i in near else rng.integers(1 << 20, 1 << 31, own).astype(np.uint32)
        edits = rng.choice(own, 4 if i in near else own // 4, replace=False)
        x[edits] = rng.integers(20, 60, len(edits))
        rows.append((i, own, 0, np.concatenate((x, line)).tobytes()))
    return rows


def test_documents_that_share_a_line_alone_are_not_compared(monkeypatch):
    """Pairs of those that ask and those that have the seed grow with the square of it; what is compared doesn't."""
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    rows = lined(1500, 57, 5)
    asked = substring_dedup._Asked(5, 50, 0.8)
    asked.add(rows[:700])
    assert [x for first in range(0, len(rows), 500) for x in asked.offer(rows[first : first + 500])] == []
    assert sum(compared) < 0.01 * 700 * 1500 * substring_dedup.BITS / 64


@pytest.mark.parametrize(("seed", "hits"), [(1, 1 << 20), (2, 1 << 20), (3, 50)])
def test_the_index_of_askers_loses_no_passage(monkeypatch, seed, hits):
    monkeypatch.setattr(substring_dedup, "HITS", hits, raising=False)
    rng = np.random.default_rng(seed)
    near = set(rng.choice(400, 12, replace=False).tolist())
    vocabulary = rng.integers(1, 1 << 31, 40).astype(np.uint32)  # few words, so many are shared by chance
    rows = []
    for i, place, start, found in lined(400, 57, seed, near):
        x = np.frombuffer(found, np.uint32).copy()
        few = rng.choice(57, 20, replace=False)
        if i not in near:
            x[few] = rng.choice(vocabulary, 20)
        rows.append((i, place, start, x[: 57 + rng.integers(5, 13)].tobytes()))
    asked = substring_dedup._Asked(5, 50, 0.8)
    asked.add(rows[:250])
    got = [x for first in range(0, len(rows), 100) for x in asked.offer(rows[first : first + 100])]
    assert asked.indexed
    mine, theirs = substring_dedup._sides(rows, 5, 45), substring_dedup._sides(rows, 5, 57)
    fits = {i: {j for j in range(len(rows)) if j != i and substring_dedup._alike([x[i] for x in mine], [y[j] for y in theirs], 5, 50, 0.8)} for i in sorted(near)}
    assert any(fits.values())
    assert all(x[3] in fits[x[0]] for x in got)
    assert {i for x in got for i in (x[0], x[3])} >= {i for i in fits if i < 250 and fits[i]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_minimizers_of_a_block_are_those_of_its_texts(texts, window):
    k = 3
    hashes = np.concatenate([np.array(x, np.uint64) for x in texts])
    ends = np.cumsum([0, *map(len, texts)])
    runs = substring_dedup.grams(hashes, k)
    at, text = substring_dedup._placed(runs, ends, k, window)
    want = [(i, ends[i] + p) for i, x in enumerate(texts) if len(x) >= k for p in substring_dedup.minimizers(runs[ends[i] : ends[i + 1] - k + 1], window)]
    assert list(zip(text.tolist(), at.tolist(), strict=True)) == want


def test_seeds_go_in_blocks_and_requests_in_batches():
    """A row for each bucket of a batch, not for each seed; a batch for many requests, not one for each document."""
    import pyarrow as pa

    texts = [edge.prose(i % 300, 120) for i in range(600)]
    given_ = pa.record_batch([pa.array(range(600), pa.int64()), pa.array(texts)], ["id", "text"])
    sent = list(substring_dedup._seeds(5, 8, 64, 16)(iter([given_])))
    assert sum(map(len, sent)) <= 32
    met = pa.Table.from_batches(sent).sort_by("bucket").to_batches()
    found = pa.Table.from_batches(list(substring_dedup._meet(16)(iter(met)))).sort_by("bucket").to_batches()
    chained = list(substring_dedup._chain(5, 8, 50)(iter(found)))
    assert len(chained) < 5
    assert {tuple(sorted(x)) for b in chained for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == {(i, i + 300) for i in range(300)}
