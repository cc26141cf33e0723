"""Passages that repeat across documents, exactly or nearly, by collinear chaining of shared seeds.

Seeds are minimizers: of each window of consecutive k-word runs, the one of the lowest hash. They are
joined: each occurrence meets every other document that has the seed, or, if these are over ``JOINED``,
the seed's first document and the document before it, so a passage in m documents costs 2 m matches.
A seed that is frequent in a batch is matched there, and only its first and last occurrence go on. The
matches of two documents are chained, in order in both, with a cost for gaps, by a Fenwick tree of best prefixes. Chains long enough are
aligned: the words of both spans are fetched, ends are extended past differing words, and gaps between seeds are filled by
their longest common subsequence.

The seeds of a passage in many documents may so meet different ones. What is repeated word for word is therefore
made whole in a further round: stretches of shared seeds long enough give their runs of ``min_words``
words, and each run that no alignment has covered is paired with an equal one of another document.

Passages that are edited in every copy get a last round, in which all documents of a seed meet: each
occurrence of a seed that doesn't meet everywhere asks all others, if no passage covers it yet and a chain may
hold it. An index of the askers' rarest words, then bitmaps of the words around both tell which may be alike enough; these are aligned,
likeliest first, until one is. So rows grow with the occurrences, not with their pairs; the two documents are then chained as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.base import cut, n_parts, prepare
from shardloom.llm.ngram_join import _runs
from shardloom.llm.textkernel import blocks, bytes_of, grams, mix, words

K, WINDOW = 5, 8
MIN_WORDS, MIN_IDENTITY = 50, 0.8
#: What a seed is worth, in words of gap that cost as much: a gap of g words on either side costs g / GAP.
GAP = 60.0
#: Documents of a seed that all meet; occurrences in a batch beyond which a seed is matched there.
JOINED, FREQUENT = 16, 64
#: Bits for the words around an occurrence, askers and offers that are compared at once, bits of the map of seeds asked for.
BITS, ASKERS, OFFERS, SEED_BITS = 2048, 64, 1024, 1 << 24
#: Pairs of an asker's word and an offer that has it, looked at at once (or those of one offer).
HITS = 1 << 20
#: Matches that a task holds before it sends them, and requests and bytes of these in one batch.
MATCHES, REQUESTS, REQUEST_BYTES = 1_000_000, 1000, 1 << 20
#: Spans (of 16 bytes, and what a hash table adds) that are sent to all executors at most.
MOST_SENT = 500_000


def minimizers(runs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the lowest hash of each window of ``window`` hashes (of all, if fewer); the last of equals."""
    if len(runs) <= window:
        return np.array([len(runs) - 1 - runs[::-1].argmin()]) if len(runs) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs[::-1], window)
    return np.unique(len(runs) - 1 - (view.argmin(1) + np.arange(len(view))))


def _placed(runs: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`minimizers` of all texts of a block at once: places in ``runs``, rising, and their texts."""
    many = np.diff(ends) - k + 1
    n = len(runs) - window + 1
    found = [ends[i] + minimizers(runs[ends[i] : ends[i] + many[i]], window) for i in np.flatnonzero((many > 0) & (many <= window)).tolist()]
    if n > 0:
        low, at = runs[:n].copy(), np.zeros(n, np.int64)
        for step in range(1, window):
            ok = runs[step : step + n] <= low
            low[ok], at[ok] = runs[step : step + n][ok], step
        long = many > window
        bounds = np.zeros(n + 1, np.int64)  # of the windows that lie within a text
        np.add.at(bounds, ends[:-1][long], 1)
        np.add.at(bounds, ends[:-1][long] + many[long] - window + 1, -1)
        whole = np.flatnonzero(np.cumsum(bounds[:n]) > 0)
        found.append(whole + at[whole])
    places = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    places = places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places
    return places, np.searchsorted(ends, places, "right") - 1


def _buckets(spark: SparkSession) -> int:
    """Buckets that rows are dealt out by: several for each partition, so these are even and a bucket is small."""
    return max(1024, 4 * n_parts(spark))


def _share(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of hashes; rises with them."""
    return (((x >> 32) + (1 << 31)) * buckets) >> 32


def _packed(bucket: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    """The rows of each bucket as bytes, column after column; ``bucket`` is sorted."""
    starts, ends = _ends(bucket)
    for which, s, e in zip(bucket[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield which, b"".join([x[s:e].tobytes() for x in columns])


def _unpacked(parts: list[bytes], kinds: tuple[type, ...]) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in kinds)
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for part in parts:
        n, at = len(part) // size, 0
        for column, kind in zip(found, kinds, strict=True):
            column.append(np.frombuffer(part, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, kinds, strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """For each bucket of sorted rows (bucket, ready, rows) the rows that aren't ready and those that are."""
    key, held = None, ([], [])
    for batch in batches:
        for bucket, ready, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)), strict=True):
            if bucket != key:
                if key is not None:
                    yield key, *held
                key, held = bucket, ([], [])
            held[ready].append(rows)
    if key is not None:
        yield key, *held


#: Rows (bucket, ready, rows): a seed's occurrences meet in a bucket (seed, document, place, whether the batch has more of it); matches are ready.
PACKED = "bucket int, ready boolean, rows binary"
SEED, MATCH = (np.int64, np.int64, np.int32, np.bool_), (np.int64, np.int64, np.int32, np.int32)


def _sent(found: Iterator[tuple[int, bytes]], ready: bool) -> pa.RecordBatch:
    buckets, rows = zip(*found, strict=True)
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array([ready] * len(rows)), pa.array(rows, pa.binary())], ["bucket", "ready", "rows"])


def _dealt(matches: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Matches, by buckets of the two documents."""
    doc, other = matches[:2]
    bucket = (mix(mix(doc.view(np.uint64)) + other.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return _sent(_packed(bucket[order], tuple(np.asarray(x, t)[order] for x, t in zip(matches, MATCH, strict=True))), True)


def _seeds(k: int, window: int, frequent: int, buckets: int):
    """Packed occurrences of seeds, and matches of those that are frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            seeds, docs, places = [], [], []
            for first, last in blocks(bounds):
                hashes, ends = words(data, bounds[first : last + 1])
                runs = grams(hashes, k)
                at, text = _placed(runs, ends, k, window)
                ok = known[first:last][text]
                at, text = at[ok], text[ok]
                seeds.append(runs[at].view(np.int64))
                docs.append(ids[first:last][text])
                places.append((at - ends[text]).astype(np.int32))
            if not seeds or not sum(map(len, seeds)):
                continue
            seed, doc, place = (np.concatenate(x) for x in (seeds, docs, places))
            order = np.lexsort((place, doc, seed))
            seed, doc, place = seed[order], doc[order], place[order]
            starts, ends = _ends(seed)
            hot = np.repeat((ends - starts > frequent) & (doc[starts] != doc[ends - 1]), ends - starts)
            matches = _matches(seed[hot], doc[hot], place[hot], 0)
            go = ~hot
            go[starts[hot[starts]]] = go[ends[hot[starts]] - 1] = True
            yield _sent(_packed(_share(seed[go], buckets), (seed[go], doc[go], place[go], hot[go])), False)
            if len(matches[0]):
                yield _dealt(matches, buckets)

    return run


def _ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(x)) if len(x) else starts


def _lengths(x: np.ndarray) -> np.ndarray:
    starts, ends = _ends(x)
    return ends - starts


def _matches(seed: np.ndarray, doc: np.ndarray, place: np.ndarray, joined: int = JOINED, more: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, other, place, other's place) of rows sorted by seed, document and place.

    Each occurrence of a seed meets the other documents before its own, at their first place there; of a
    seed that over ``joined`` documents have, the first and the last of these; and the document just
    before also at its last place. So not all places meet where a seed has over ``joined`` documents,
    or a document has it more than once: such occurrences are also given with their own document as the other.
    So are those that meet everywhere, with -1 - place as the other's place. ``more``: rows whose seed other
    documents have too that aren't here; it counts as one of over ``joined``.
    """
    n = len(seed)
    starts, ends = _ends(seed)
    shared = np.flatnonzero(np.repeat(doc[starts] != doc[ends - 1], ends - starts)) if n else np.zeros(0, np.int64)
    seed, doc, place = seed[shared], doc[shared], place[shared]
    n = len(seed)
    if not n:
        return doc, doc, place, place
    heads = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
    new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)  # of each document of a seed
    which = np.cumsum(new) - 1
    starts, ends = _ends(seed[first])
    nth = which - np.repeat(starts, ends - starts)[which]
    many = np.repeat(ends - starts > joined, ends - starts)[which]
    if more is not None:
        many |= np.repeat(np.logical_or.reduceat(more[shared], heads), _lengths(seed))
    repeated = np.repeat(np.add.reduceat(~new, heads) > 0, _lengths(seed))
    wholly, partly = np.flatnonzero(~many & ~repeated), np.flatnonzero(many | repeated)
    left, right = [wholly, partly], [wholly, partly]

    def meet(at: np.ndarray, to: np.ndarray) -> None:
        left.append(at)
        right.append(to)

    for step in range(1, joined):
        at = np.flatnonzero((nth >= step) & ~many)
        if not len(at):
            break
        meet(at, first[which[at] - step])
    at = np.flatnonzero(many & (nth > 0))
    meet(at, first[which[at] - nth[at]])
    at = np.flatnonzero(nth > 0)
    before = first[which[at]] - 1  # the last place in the document before
    ok = many[at] & (nth[at] > 1) | (before != first[which[at] - 1])
    meet(at[ok], before[ok])
    left, right = np.concatenate(left), np.concatenate(right)
    there = place[right]
    there[: len(wholly)] = -1 - there[: len(wholly)]
    return doc[left], doc[right], place[left], there


def _meet(buckets: int):
    """Packed matches, of rows of :func:`_seeds` sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for bucket, waiting, ready in _by_bucket(batches):
            if ready:
                yield _sent(((bucket, x) for x in ready), True)
            seed, doc, place, more = _unpacked(waiting, SEED)
            order = np.lexsort((place, doc, seed))
            held.append(_matches(seed[order], doc[order], place[order], more=more[order]))
            if sum(len(x[0]) for x in held) > MATCHES:
                yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)], buckets)
                held = []
        if sum(len(x[0]) for x in held):
            yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)], buckets)

    return run


def chains(a: np.ndarray, b: np.ndarray, gap: float = GAP, least: float = 2.0) -> list[np.ndarray]:
    """Chains of matches (a, b), best first, each match in one at most; a chain rises in both.

    A chain's score is its number of matches less the words of gap between them on both sides / ``gap``.
    """
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    dx, dy = np.diff(x), np.diff(y)
    rising = bool((dx > 0).all() and (dy > 0).all())
    if rising and len(x) and (dx + dy < gap * (1 - 1e-6)).all():  # each match adds to the score, so all are one chain
        whole = len(x) - (int(x[-1]) - int(x[0]) + int(y[-1]) - int(y[0])) / gap
        if abs(whole - least) > 1e-6:
            return [order] if whole > least else []
    score, prior = (_following if rising else _scores)(x.tolist(), y.tolist(), gap)
    used, found = [False] * len(x), []
    for end in sorted(range(len(x)), key=lambda m: -score[m]):
        if score[end] < least:
            break
        path, m = [], end
        while m >= 0 and not used[m]:
            path.append(m)
            used[m] = True
            m = prior[m]
        # What a better chain has taken from this one doesn't count for it.
        if score[end] - (score[m] if m >= 0 else 0) >= least:
            found.append(order[path[::-1]])
    return found


def _following(x: list[int], y: list[int], gap: float) -> tuple[list[float], list[int]]:
    """:func:`_scores` of matches that rise in both: the best before one is the one just before."""
    score, prior = [1.0] * len(x), [-1] * len(x)
    for i in range(1, len(x)):
        value = score[i - 1] + (x[i - 1] + y[i - 1]) / gap - (x[i] + y[i]) / gap
        if value > 0:
            score[i], prior[i] = 1 + value, i - 1
    return score, prior


def _scores(x: list[int], y: list[int], gap: float) -> tuple[list[float], list[int]]:
    """The score of the best chain that ends in each match, sorted by both places, and the match before it there.

    A Fenwick tree over the places in ``y`` has the best before each.
    """
    where = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(where) + 1
    best, whose = [-float("inf")] * size, [-1] * size
    score, prior = [1.0] * len(x), [-1] * len(x)
    i = 0
    while i < len(x):  # matches of one place in a can't follow each other
        j, here = i, x[i]
        while j < len(x) and x[j] == here:
            value, who, at = -float("inf"), -1, where[y[j]] - 1
            while at > 0:
                if best[at] > value:
                    value, who = best[at], whose[at]
                at &= at - 1
            value -= (here + y[j]) / gap
            if value > 0:
                score[j], prior[j] = 1 + value, who
            j += 1
        for m in range(i, j):
            value, at = score[m] + (here + y[m]) / gap, where[y[m]]
            while at < size:
                if value > best[at]:
                    best[at], whose[at] = value, m
                at += at & -at
        i = j
    return score, prior


def zones(places: np.ndarray, k: int, window: int, min_words: int) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches that hold every run of ``min_words`` words that chains may miss, from the places of seeds that don't meet everywhere.

    All windows within a run that two documents have choose the same seeds in both, at most ``window``
    apart. Two of them that meet make a chain; so in a run that has none, all but one are such seeds.
    """
    for run in np.split(places, np.flatnonzero(np.diff(places) > 2 * window) + 1):
        if run[-1] - run[0] + k + 2 * (2 * window - 1) >= min_words:
            yield max(0, int(run[0]) - 2 * window + 1), int(run[-1]) + k + 2 * window - 1


def _chain(k: int, window: int, min_words: int):
    """Packed matches sorted by bucket: a request for each chain of two documents, and the document's zones.

    And with a0 -1 the places of a document's shared seeds, and which don't meet everywhere, if a chain in ``min_words`` words may hold one of these.
    """

    def request(doc: int, other: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        for path in chains(a, b):
            x, y = a[path], b[path]
            yield doc, other, int(x[0]), int(x[-1]) + k, int(y[0]), int(y[-1]) + k, x.astype(np.int32).tobytes(), y.astype(np.int32).tobytes()

    def given(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "other", "a0", "a1", "b0", "b1", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for pair, a, b in _pairs(batches):
            n = len(out)
            if pair[0] == pair[1]:
                starts, _ = _ends(a)
                places, partly = a[starts], np.maximum.reduceat(b, starts) >= 0
                if partly.any():
                    out += [(*pair, low, high, low, high, None, None) for low, high in zones(places[partly], k, window, min_words)]
                    if (partly & _thirds(places, min_words - k)).any():
                        out.append((*pair, -1, -1, -1, -1, places.astype(np.int32).tobytes(), partly.tobytes()))
            else:
                out.extend(request(*pair, a, b))
            size += sum(len(x[6] or b"") + len(x[7] or b"") for x in out[n:])
            if len(out) >= REQUESTS or size >= REQUEST_BYTES:
                yield given(out)
                out, size = [], 0
        if out:
            yield given(out)

    return run


def _thirds(places: np.ndarray, reach: int) -> np.ndarray:
    """Which of sorted places have two others within a stretch of ``reach``."""
    near = np.zeros(len(places), bool)
    at = np.flatnonzero(places[2:] - places[:-2] <= reach)
    for step in range(3):
        near[at + step] = True
    return near


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    for _, _, ready in _by_bucket(batches):
        doc, other, a, b = _unpacked(ready, MATCH)
        order = np.lexsort((b, a, other, doc))
        doc, other, a, b = doc[order], other[order], a[order], b[order]
        cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]), [True])))
        some = (np.diff(cuts) > 1) | (doc[cuts[:-1]] == other[cuts[:-1]])  # one match is no chain
        for s, e in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist(), strict=True):
            yield (int(doc[s]), int(other[s])), a[s:e], b[s:e]


def _spans(margin: int):
    """(id, bounds, start, words from there) for rows of id, bounds and text, with ``margin`` words on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            data, bounds = bytes_of(batch.column(3))
            starts, found = [], []
            for first, last in blocks(bounds):
                hashes, ends = words(data, bounds[first : last + 1])
                for i in range(first, last):
                    a, b = int(ends[i - first]), int(ends[i - first + 1])
                    start = max(0, low[i] - margin)
                    starts.append(start)
                    found.append((hashes[a + start : min(b, a + high[i] + margin)] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(starts, pa.int32()), pa.array(found, pa.binary())], ["id", "low", "high", "start", "words"])

    return run


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, w in enumerate(y):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(y)) - 1
    row = full
    for w in x:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(y) - row.bit_count()


def _beginnings(same: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of each two beginnings."""
    common = np.zeros((same.shape[0] + 1, same.shape[1] + 1), np.int32)
    for i, row in enumerate(same):
        np.maximum.accumulate(np.maximum(common[i, 1:], common[i, :-1] + row), out=common[i + 1, 1:])
    return common


def _beyond(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """How far an alignment may go on into ``x`` and ``y``, and the words that agree there; the likeliest end first.

    An end is a pair of equal words. The first end has the most words that agree less those that differ,
    the second counts the latter half; the longest of equals. The last is where the first words differ.
    """
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    n = int(differ[0]) if len(differ) else n
    plain = (n, n, n)
    same = x[n:, None] == y[None, n:]
    if not same.any():
        return [plain]
    common = _beginnings(same)
    i, j = np.nonzero(same)
    agree, longest = common[i, j] + 1, np.maximum(i, j) + 1
    found = []
    for differing in (2, 1):
        score = 2 * agree - differing * (longest - agree)
        best = np.lexsort((longest, score))[-1]
        if score[best] >= 0:
            found.append((n + int(i[best]) + 1, n + int(j[best]) + 1, n + int(agree[best])))
    return [*dict.fromkeys(found), plain]


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int, int, int]:
    """Bounds in ``x`` and ``y`` of the alignment along matches (a, b) of k words, and the words that agree.

    Of the ends beyond the matches, the likeliest with which the whole is long and alike enough.
    """
    i, j = int(a[0]), int(b[0])
    before, agree = _beyond(x[:i][::-1], y[:j][::-1]), 0
    for s, t in zip(a.tolist(), b.tolist(), strict=True):
        if s >= i and t >= j:
            if s > i and t > j:
                left, right = x[i:s], y[j:t]
                agree += int((left == right).sum()) if len(left) == len(right) else _common(left.tolist(), right.tolist())
            agree += k
        else:  # overlaps the match before; where the shift is odd, only what is new in both counts
            agree += max(0, min(s + k - i, t + k - j))
        i, j = max(i, s + k), max(j, t + k)
    after = _beyond(x[i:], y[j:])
    out = [(int(a[0]) - p, i + u, int(b[0]) - q, j + v, agree + n + m) for p, q, n in before for u, v, m in after]
    for x0, x1, y0, y1, n in out:
        if min(x1 - x0, y1 - y0) >= min_words and n >= min_identity * max(x1 - x0, y1 - y0):
            return x0, x1, y0, y1, n
    return out[0]


def passages(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> Iterator[tuple[int, int, int, int, int]]:
    """Alignments long and alike enough along a chain; one that isn't is cut at its widest gap, and so on."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        # Ends are looked for within ``min_words`` of the matches.
        i, j = max(0, int(a[0]) - min_words), max(0, int(b[0]) - min_words)
        x0, x1, y0, y1, agree = align(x[i : a[-1] + k + min_words], y[j : b[-1] + k + min_words], a - i, b - j, k, min_words, min_identity)
        x0, x1, y0, y1 = x0 + i, x1 + i, y0 + j, y1 + j
        if min(x1 - x0, y1 - y0) < min_words:
            continue
        if agree >= min_identity * max(x1 - x0, y1 - y0):
            yield x0, x1, y0, y1, agree
        elif len(a) > 2:
            at = int((np.diff(a) + np.diff(b)).argmax()) + 1
            todo += [(u, v) for u, v in ((a[:at], b[:at]), (a[at:], b[at:])) if len(u) > 1]


def _aligned(k: int, min_words: int, min_identity: float):
    """Rows sorted by request: the request's own row (side 0), then its two spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        key = None
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != key:
                    key, held = row[0], {}
                held[row[1]] = row
                if len(held) == 3:
                    _, _, doc, other, a, b, _, _ = held[0]
                    (xs, xw), (ys, yw) = held[1][6:], held[2][6:]
                    x, y = np.frombuffer(xw, np.uint32), np.frombuffer(yw, np.uint32)
                    held = {}
                    for x0, x1, y0, y1, agree in passages(x, y, np.frombuffer(a, np.int32) - xs, np.frombuffer(b, np.int32) - ys, k, min_words, min_identity):
                        out.append((doc, x0 + xs, x1 - x0, other, y0 + ys, y1 - y0, agree / max(x1 - x0, y1 - y0)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "start", "n_words", "other", "other_start", "other_words", "identity"])

    return run


def _uncovered(min_words: int):
    """(id, bounds, places of the zone's runs that no passage covers) for rows of id, bounds, and starts and ends of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high, passages in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                free = np.ones(max(0, high - min_words + 1 - low), bool)
                for p in passages or ():
                    free[max(0, p["start"] - low) : max(0, p["stop"] - min_words + 1 - low)] = False
                found.append(np.packbits(free).tobytes() if free.any() else None)
            yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.binary())], ["id", "low", "high", "free"])

    return run


def _whole(min_words: int, frequent: int):
    """Runs of ``min_words`` words, from rows of id, bounds, uncovered places and text: (run, document, place, whether uncovered, 0, -1).

    Runs that are frequent in a batch are matched there: (anything, document, place, true, other, its place);
    only their first occurrence and the first in another document go on, as covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, low, high, free = (batch.column(i).to_pylist() for i in range(4))
            data, bounds = bytes_of(batch.column(4))
            out: list[tuple[np.ndarray, ...]] = []
            for first, last in blocks(bounds):
                hashes, ends = words(data, bounds[first : last + 1])
                for i in range(first, last):
                    a, b = int(ends[i - first]), int(ends[i - first + 1])
                    runs = grams(hashes[a + low[i] : min(b, a + high[i])], min_words)
                    if len(runs):
                        mark = np.unpackbits(np.frombuffer(free[i], np.uint8))[: len(runs)].astype(bool) if free[i] else np.zeros(len(runs), bool)
                        out.append((runs.view(np.int64), np.full(len(runs), ids[i], np.int64), (low[i] + np.arange(len(runs))).astype(np.int32), mark))
            if not out:
                continue
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            order = np.lexsort((cols[2], cols[1], cols[0]))
            whole, doc, place, mark = (x[order] for x in cols)
            starts, ends = _ends(whole)
            hot = np.repeat((ends - starts > frequent) & (doc[starts] != doc[ends - 1]), ends - starts)
            here, there, x, y = _equals(whole[hot], doc[hot], place[hot], mark[hot])
            new = np.concatenate(([True], (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])))
            nth = np.cumsum(new) - np.repeat(np.cumsum(new)[starts], ends - starts)  # of the run's documents
            go, mark = ~hot | (new & (nth < 2)), mark & ~hot
            deal = mix(here.view(np.uint64) * np.uint64(31) + x.astype(np.uint64)).view(np.int64)
            n = int(go.sum())
            columns = [(whole[go], deal), (doc[go], here), (place[go], x), (mark[go], np.ones(len(here), bool)), (np.zeros(n, np.int64), there), (np.full(n, -1, np.int32), y)]
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], ["run", "doc", "place", "free", "other", "b"])

    return run


def _equals(whole: np.ndarray, doc: np.ndarray, place: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, other, place, other's place) of rows sorted by run, document and place: each uncovered one with the run's first document, this one with the next."""
    n = len(whole)
    if not n:
        return doc, doc, place, place
    starts, ends = _ends(whole)
    head = np.repeat(starts, ends - starts)
    other = np.where(doc != doc[head], np.arange(n), n)
    second = np.repeat(np.minimum.reduceat(other, starts), ends - starts)
    at = np.flatnonzero(free & (second < n))
    to = np.where(doc[at] != doc[head[at]], head[at], second[at])
    return doc[at], doc[to], place[at], place[to]


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches, of rows of :func:`_whole` sorted by run, document and place."""
    names = ["doc", "other", "a", "b"]
    for whole, doc, place, free, other, b in _runs(batches):
        own = b < 0
        yield pa.record_batch([pa.array(x) for x in _equals(whole[own], doc[own], place[own], free[own].astype(bool))], names)
        if not own.all():
            yield pa.record_batch([pa.array(x[~own]) for x in (doc, other, place, b)], names)


def _joined(min_words: int):
    """Rows sorted by document, other and place: runs that follow one another as one passage.

    A run that the other document has several times is given with one of these places, so what follows
    one another here may jump there; the other passage is all that lies between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, other, a, b in _runs(batches):
            new = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (a[1:] > a[:-1] + 1) | (np.abs(b[1:] - b[:-1]) > 4 * min_words)
            first = np.flatnonzero(np.concatenate(([True], new)))
            last = np.append(first[1:], len(doc)) - 1
            low, high = np.minimum.reduceat(b, first), np.maximum.reduceat(b, first)
            cols = [doc[first], a[first], (a[last] - a[first] + min_words).astype(np.int32), other[first], low, (high - low + min_words).astype(np.int32), np.ones(len(first))]
            yield pa.record_batch([pa.array(x) for x in cols], ["doc", "start", "n_words", "other", "other_start", "other_words", "identity"])

    return run


def _covered(out: DataFrame) -> DataFrame:
    """The passages of each document (id, passages)."""
    sides = out.select(F.col("doc").alias("id"), "start", "n_words").union(out.select("other", "other_start", "other_words")).distinct()
    return sides.groupBy("id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("stop"))).alias("passages"))


def _rest(rows: DataFrame, held: DataFrame, out: DataFrame, min_words: int) -> DataFrame:
    """Exact passages that ``out`` doesn't cover, from the zones ``held`` (id, low, high) of all documents."""
    spark = rows.sparkSession
    parts = n_parts(spark)
    held = cut(held.join(_covered(out).hint("merge"), "id", "left").select("id", "low", "high", "passages").mapInArrow(_uncovered(min_words), "id long, low int, high int, free binary"))
    if held.filter("free is not null").isEmpty():
        return out
    how = "broadcast" if held.count() <= MOST_SENT else "merge"
    runs = rows.join(held.hint(how), "id").select("id", "low", "high", "free", "text").mapInArrow(_whole(min_words, FREQUENT), "run long, doc long, place int, free boolean, other long, b int")
    pairs = runs.repartition(parts, "run").sortWithinPartitions("run", "doc", "place").mapInArrow(_equal, "doc long, other long, a int, b int")
    found = pairs.repartition(parts, "doc", "other").sortWithinPartitions("doc", "other", "a").mapInArrow(_joined(min_words), out.schema)
    return out.union(found)


def _askers(places: np.ndarray, partly: np.ndarray, covered: np.ndarray, reach: int) -> np.ndarray:
    """Which places must ask so that each three within a stretch of ``reach``, with one that doesn't meet everywhere and isn't covered, have one that asks.

    A place may be left out if there is one other place at most, within ``reach`` on either side, that doesn't ask.
    """
    ask = partly & ~covered & _thirds(places, reach)
    low, high = np.searchsorted(places, places - reach), np.searchsorted(places, places + reach, "right")
    silent = ~ask
    for i in np.flatnonzero(ask).tolist():
        if silent[low[i] : high[i]].sum() <= 1:
            ask[i], silent[i] = False, True
    return ask


def _asking(k: int, reach: int):
    """(id, places that ask) for rows of id, places of shared seeds, which don't meet everywhere, and passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, places, partly, passages in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                places, partly = np.frombuffer(places, np.int32), np.frombuffer(partly, bool)
                covered = np.zeros(len(places), bool)
                for p in passages or ():
                    covered |= (places >= p["start"]) & (places + k <= p["stop"])
                ask = _askers(places, partly, covered, reach)
                if ask.any():
                    ids.append(doc)
                    found.append(places[ask].tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "at"])

    return run


def _around(k: int, window: int, before: int, after: int, wanted=None):
    """(seed, document, place, first word, words from there, whether it asks): the places of rows of id, text and places, or the first and last of each seed in the map ``wanted``.

    Of a run of equal seeds, the first and the last ask for all of it.
    """

    def asked(own: np.ndarray, places: bytes, start: int) -> list[int]:
        at = np.frombuffer(places, np.int32)
        starts, stops = _ends(own)  # of one word said again and again
        run = np.searchsorted(starts, at[at < len(own)], "right") - 1
        return (start + np.unique(np.concatenate((starts[run], stops[run] - 1)))).tolist() if len(own) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            given = None if wanted else batch.column(2).to_pylist()
            data, bounds = bytes_of(batch.column(1))
            for first, last in blocks(bounds):
                out = []
                hashes, ends = words(data, bounds[first : last + 1])
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                runs = grams(hashes, k)
                if wanted:
                    at, text = _placed(runs, ends, k, window)
                    cells = runs[at] & np.uint64(SEED_BITS - 1)
                    ok = (wanted.value[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    at, text = at[ok], text[ok]
                    order = np.lexsort((at, runs[at], text))
                    at, text, seed = at[order], text[order], runs[at[order]]
                    new = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
                    at = np.sort(at[np.concatenate(([True], new)) | np.concatenate((new, [True]))]) if len(at) else at
                    chosen = zip((np.searchsorted(ends, at, "right") - 1).tolist(), at.tolist(), strict=True)
                else:
                    chosen = ((i, p) for i in range(last - first) for p in asked(runs[ends[i] : max(ends[i], ends[i + 1] - k + 1)], given[first + i], int(ends[i])))
                for i, p in chosen:
                    if ids[first + i] is not None:
                        a, b = int(ends[i]), int(ends[i + 1])
                        low = max(a, p - before)
                        out.append((int(runs[p].view(np.int64)), ids[first + i], p - a, low - a, short[low : min(b, p + after)].tobytes(), wanted is None))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["seed", "doc", "place", "start", "words", "asks"])

    return run


def _sides(rows: list[tuple], k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after the seeds of rows (document, place, first word, words), ``most`` at most, from the seed on; -1 where there are no more."""
    out = np.full((2, len(rows), most), -1, np.int64)
    for i, (_, place, start, found) in enumerate(rows):
        x = np.frombuffer(found, np.uint32)
        before, after = x[: place - start][::-1][:most], x[place - start + k :][:most]
        out[0, i, : len(before)], out[1, i, : len(after)] = before, after
    return out[0], out[1]


def _bitmaps(sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row a bitmap of its words, those of a side and the nth of equal words apart, and how many of them share a bit with another."""
    x = np.stack(sides, 1)
    n = len(x)
    row, side, at = np.nonzero(x >= 0)
    word, group = x[row, side, at], row * 2 + side
    order = np.lexsort((word, group))
    row, group, word = row[order], group[order], word[order]
    starts, ends = _ends(group << 32 | word)
    nth = np.arange(len(word)) - np.repeat(starts, ends - starts)
    bits = np.zeros((n, BITS), np.uint8)
    bits[row, (mix((word | (nth * 2 + group % 2) << 32).astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64), np.bincount(row, minlength=n) - bits.sum(1, dtype=np.int64)


def _common_up_to(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of each beginning of ``x`` with each row of ``ys`` (64 at most); bit-parallel over all rows."""
    same = np.zeros((len(x), len(ys), 64), bool)
    same[:, :, : ys.shape[1]] = (x[:, None, None] == ys) & (x >= 0)[:, None, None]
    where = np.packbits(same, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    rows = np.full((len(x) + 1, len(ys)), ~np.uint64(0))
    for i, has in enumerate(where):
        row = rows[i]
        hit = row & has
        rows[i + 1] = (row + hit) | (row - hit)
    return np.bitwise_count(~rows).astype(np.int16)


def _equal_grams(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of equal values."""
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
    a = np.repeat(np.arange(len(x)), high - low)
    nth = np.arange(len(a)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return a, order[low[a] + nth]


def _alike(mine: list[np.ndarray], their: list[np.ndarray], k: int, min_words: int, min_identity: float) -> tuple[int, int, int, float] | None:
    """How many words before the seed, on this side and on the other, and how many words there, of the passage of ``min_words`` words here that is most alike; and its identity."""
    before, after = (_beginnings(x[x >= 0][:, None] == y[y >= 0][None, :]) for x, y in zip(mine, their, strict=True))
    n = min_words - k
    first, last = max(0, n + 1 - len(after)), min(n, len(before) - 1)
    if first > last:
        return None
    agree = k + before[first : last + 1, :, None] + after[n - last : n - first + 1][::-1, None, :]
    span = k + np.arange(before.shape[1])[:, None] + np.arange(after.shape[1])
    over = np.where(span >= min_words, agree - min_identity * span, -1.0)
    at, left, right = np.unravel_index(over.argmax(), over.shape)
    if over[at, left, right] < -1e-9:
        return None
    return first + int(at), int(left), int(span[left, right]), float(agree[at, left, right] / span[left, right])


def _telling(sides: tuple[np.ndarray, np.ndarray], often: np.ndarray, spare: int) -> np.ndarray:
    """Which words of rows (side, row, word), so that each stretch around the seed of a side's length has ``spare`` + 1 of them, those of low ``often``.

    If all but ``spare`` words of a stretch are in another document, so is one of these.
    """
    before, after = ((x >= 0).sum(1) for x in sides)
    _, n, most = often.shape
    chosen = np.zeros(often.shape, bool)
    rows, at = np.arange(n)[:, None], np.arange(most)
    for left in range(most + 1):
        whole = (before >= left) & (after >= most - left)  # stretches that the document has
        if whole.any():
            stretch = np.concatenate((often[0][whole, :left], often[1][whole, : most - left]), axis=1)
            least = np.argpartition(stretch, spare, axis=1)[:, : spare + 1]
            side, which = (least >= left).astype(np.int64), rows[whole]
            chosen[side, np.broadcast_to(which, side.shape), np.where(side > 0, least - left, least)] = True
    return chosen


def _words_of(sides: tuple[np.ndarray, np.ndarray], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of rows, those of either side apart, as hashes, and their rows."""
    x = np.stack(sides)
    side, row, at = np.nonzero(x >= 0 if chosen is None else chosen)
    return mix((x[side, row, at] | side << 32).astype(np.uint64)), row


class _Asked:
    """Occurrences of a seed that ask, and those of them that have found no partner yet.

    A stretch of ``min_words`` words that is alike has all but few of its words in the other document. So each asker
    has an index entry for its rarest words only, enough for each stretch; only offers that have one of them are compared with it.
    """

    def __init__(self, k: int, min_words: int, min_identity: float) -> None:
        self.how = k, min_words, min_identity
        self.least = int(np.ceil(min_identity * min_words - 1e-9))
        self.rows: list[tuple] = []
        self.at: dict[tuple[int, int], int] = {}

    def add(self, rows: list[tuple]) -> None:
        for row in rows:
            self.at[row[:2]] = len(self.rows)
            self.rows.append(row)
        self.open = np.ones(len(self.rows), bool)
        self.docs = None

    def index(self, theirs: tuple[np.ndarray, np.ndarray]) -> None:
        """Rare are words that few askers and few of the first offers have."""
        k, min_words, _ = self.how
        self.docs = np.array([x[0] for x in self.rows])
        maps = [_bitmaps(_sides(self.rows[first : first + OFFERS], k, min_words - k)) for first in range(0, len(self.rows), OFFERS)]
        self.bits, self.lost = (np.concatenate(x) for x in zip(*maps, strict=True))
        self.indexed = len(self.rows) > ASKERS and self.least > k  # few are compared with all offers, as are all if the seed is enough
        if not self.indexed:
            return
        some = [_words_of(_sides(self.rows[first : first + OFFERS], k, min_words - k)) for first in range(0, len(self.rows), OFFERS)]
        seen = []
        for word, row in [*some, _words_of(theirs)]:
            order = np.lexsort((row, word))
            word, row = word[order], row[order]
            new = np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])))
            seen.append(word[new])
        known, times = np.unique(np.concatenate(seen), return_counts=True)
        entries, whose = [], []
        for first in range(0, len(self.rows), OFFERS):
            sides = _sides(self.rows[first : first + OFFERS], k, min_words - k)
            x = np.stack(sides)
            word = mix((x | np.arange(2)[:, None, None] << 32).astype(np.uint64))
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            often = np.where(known[at] == word, times[at], 0) if len(known) else np.zeros(x.shape, np.int64)
            word, row = _words_of(sides, _telling(sides, often, min_words - self.least))
            entries.append(word)
            whose.append(first + row)
        word, whose = np.concatenate(entries), np.concatenate(whose)
        order = np.lexsort((whose, word))
        self.words, self.whose = word[order], whose[order]

    def near(self, theirs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an open asker and an offer that has one of its words, about ``HITS`` at once."""
        n = len(theirs[0])
        if not self.indexed:
            still = np.flatnonzero(self.open)
            for first in range(0, len(still), ASKERS):
                some = still[first : first + ASKERS]
                yield np.repeat(some, n), np.tile(np.arange(n), len(some))
            return
        word, row = _words_of(theirs)
        low, high = np.searchsorted(self.words, word), np.searchsorted(self.words, word, "right")
        has = np.flatnonzero(high > low)
        has = has[np.argsort(row[has], kind="stable")]
        low, many, row = low[has], (high - low)[has], row[has]
        upto, start = np.cumsum(many), 0
        while start < len(low):  # offers with about so many hits together
            stop = int(np.searchsorted(upto, upto[start] - many[start] + HITS, "right"))
            stop = int(np.searchsorted(row, row[stop])) if stop < len(row) else len(row)
            stop = stop if stop > start else int(np.searchsorted(row, row[start], "right"))
            each = many[start:stop]
            asker = self.whose[np.repeat(low[start:stop] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            ok = self.open[asker]
            pairs = np.unique(asker[ok] * n + np.repeat(row[start:stop], each)[ok])
            start = stop
            yield pairs // n, pairs % n

    def likely(self, rows: list[tuple], theirs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the pairs that are near those that may be alike and the words they have in common at most, asker by asker; all together, if they are few enough."""
        docs = np.array([x[0] for x in rows])
        bits, lost = _bitmaps(theirs)
        held: list[tuple[np.ndarray, ...]] = []
        for askers, offers in self.near(theirs):
            for first in range(0, len(askers), ASKERS * OFFERS):
                asker, offer = askers[first : first + ASKERS * OFFERS], offers[first : first + ASKERS * OFFERS]
                # What two lists have in common is at most the bits in common and what shares a bit in either.
                common = np.bitwise_count(self.bits[asker] & bits[offer]).sum(1, dtype=np.int64) + np.minimum(self.lost[asker], lost[offer])
                ok = (common + self.how[0] >= self.least) & (self.docs[asker] != docs[offer])
                held.append((asker[ok], offer[ok], common[ok]))
            if not self.indexed or sum(len(x[0]) for x in held) > HITS:
                yield self.sorted(held)
                held = []
        if held:
            yield self.sorted(held)

    @staticmethod
    def sorted(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        asker, offer, common = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((offer, asker))
        return asker[order], offer[order], common[order]

    def offer(self, rows: list[tuple]) -> Iterator[tuple]:
        """Passages with ``rows`` (document, place, first word, words), one at most for each that asks."""
        k, min_words, min_identity = self.how
        wide, narrow = int(min_words / min_identity + 1e-9) - k, min_words - k
        if self.docs is not None and not self.open.any():
            return
        theirs = _sides(rows, k, wide)
        if self.docs is None:
            self.index(theirs)
        for asker, offer, common in self.likely(rows, theirs):
            for s, e in zip(*(x.tolist() for x in _ends(asker)), strict=True):
                q, near, likely = int(asker[s]), offer[s:e], common[s:e]
                if not self.open[q]:
                    continue
                mine = [x[0] for x in _sides([self.rows[q]], k, narrow)]
                if wide <= 64:  # of the words of a stretch that holds the seed, so many at most agree in order
                    before, after = (_common_up_to(x, y[near]) for x, y in zip(mine, theirs, strict=True))
                    likely = (before + after[::-1]).max(0)
                    near, likely = near[likely + k >= self.least], likely[likely + k >= self.least]
                yield from self.settle(q, mine, rows, theirs, near[np.argsort(-likely, kind="stable")].tolist())

    def settle(self, q: int, mine: list[np.ndarray], rows: list[tuple], theirs: tuple[np.ndarray, np.ndarray], likely: list[int]) -> Iterator[tuple]:
        doc, place = self.rows[q][:2]
        for t in likely:
            if hit := _alike(mine, [y[t] for y in theirs], *self.how):
                other, there = rows[t][:2]
                self.open[q] = False
                if (other, there) in self.at:
                    self.open[self.at[other, there]] = False
                yield doc, place - hit[0], self.how[1], other, there - hit[1], hit[2], hit[3]
                return


def _partners(k: int, min_words: int, min_identity: float):
    """Passages, of rows of :func:`_around` sorted by seed, those that ask first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, None
        for batch in batches:
            seeds, asks = batch.column(0).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            out = []
            for s, e in zip(*(x.tolist() for x in _ends(seeds)), strict=True):
                if seeds[s] != key:
                    key, asked = seeds[s], _Asked(k, min_words, min_identity)
                rows = list(zip(*(batch.column(c)[s:e].to_pylist() for c in (1, 2, 3, 4)), strict=True)) if asks[s] or asked.rows else []
                n = int(asks[s:e].sum())
                if n:
                    asked.add(rows[:n])
                if asked.rows:
                    for first in range(n, len(rows), OFFERS):
                        out.extend(asked.offer(rows[first : first + OFFERS]))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "start", "n_words", "other", "other_start", "other_words", "identity"])

    return run


def _compared(k: int, window: int, min_words: int, min_identity: float):
    """All passages of two documents, from rows sorted by request: the passages known (side 0), then both documents' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        key = None
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != key:
                    key, held = row[0], {}
                held[row[1]] = row
                if len(held) < 3:
                    continue
                _, _, doc, other, known, _ = held[0]
                x, y = (np.frombuffer(held[side][5], np.uint32) for side in (1, 2))
                held = {}
                seeds = [grams(z.astype(np.uint64), k) for z in (x, y)]
                places = [minimizers(z, window) for z in seeds]
                # As where seeds meet: each place meets the first and the last place of the other document.
                there, first = np.unique(seeds[1][places[1]], return_index=True)
                last = len(places[1]) - 1 - np.unique(seeds[1][places[1]][::-1], return_index=True)[1]
                i, j = _equal_grams(seeds[0][places[0]], there)
                met = np.unique(np.stack((np.tile(places[0][i], 2), np.concatenate((places[1][first[j]], places[1][last[j]])))), axis=1)
                found = [p for path in chains(*met) for p in passages(x, y, met[0][path], met[1][path], k, min_words, min_identity)]
                out.extend((doc, x0, x1 - x0, other, y0, y1 - y0, agree / max(x1 - x0, y1 - y0)) for x0, x1, y0, y1, agree in found)
                for p in known:
                    p = tuple(p.values())
                    if not any(x0 <= p[0] and p[0] + p[1] <= x1 and y0 <= p[2] and p[2] + p[3] <= y1 for x0, x1, y0, y1, _ in found):
                        out.append((doc, p[0], p[1], other, *p[2:]))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "start", "n_words", "other", "other_start", "other_words", "identity"])

    return run


def _seed_map(seeds: DataFrame):
    """A map of bits, sent to all executors, of the lowest bits of ``seeds`` (seed)."""
    spark = seeds.sparkSession
    # These functions count from 1.
    placed = seeds.select((F.col("seed").bitwiseAND(F.lit(SEED_BITS - 1)) + 1).alias("cell")).select("cell", F.bitmap_bucket_number("cell").alias("bucket"))
    bits = np.zeros(SEED_BITS // 8, np.uint8)
    for bucket, part in placed.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell"))).collect():
        bits[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(bits)


def _all_meet(rows: DataFrame, shared: DataFrame, out: DataFrame, k: int, window: int, min_words: int, min_identity: float) -> DataFrame:
    """``out``, and passages with seeds that don't meet everywhere and that it doesn't cover, of documents' ``shared`` seeds (id, places, partly)."""
    parts = n_parts(rows.sparkSession)
    asking = cut(shared.join(_covered(out).hint("merge"), "id", "left").select("id", "places", "partly", "passages").mapInArrow(_asking(k, min_words - k), "id long, at binary"))
    n = asking.count()
    if not n:
        return out
    kind = "seed long, doc long, place int, start int, words binary, asks boolean"
    # A passage of ``min_words`` words that holds the seed, on this side; on the other it may be longer by what differs.
    longest = int(min_words / min_identity + 1e-9)
    texts = rows.join(asking.hint("broadcast" if n <= MOST_SENT else "merge"), "id").select("id", "text", "at")
    asks = cut(texts.mapInArrow(_around(k, window, min_words - k, min_words), kind))
    offers = rows.mapInArrow(_around(k, window, longest - k, longest, _seed_map(asks.select("seed"))), kind)
    met = asks.union(offers).repartition(parts, "seed").sortWithinPartitions("seed", F.desc("asks"), "doc", "place")
    met = cut(met.mapInArrow(_partners(k, min_words, min_identity), out.schema))
    pairs = met.groupBy("doc", "other").agg(F.collect_list(F.struct("start", "n_words", "other_start", "other_words", "identity")).alias("known"))
    pairs = cut(pairs.withColumn("request", F.xxhash64("doc", "other")))
    sides = pairs.select("request", F.lit(1).alias("side"), F.col("doc").alias("id")).union(pairs.select("request", F.lit(2), "other"))
    wanted = cut(sides.select("id").distinct())
    how = "broadcast" if wanted.count() <= MOST_SENT else "merge"
    spans = rows.join(wanted.hint(how), "id").select("id", F.lit(0).alias("low"), F.lit(1 << 30).alias("high"), "text").mapInArrow(_spans(0), "id long, low int, high int, start int, words binary")
    spans = sides.join(spans, "id").select("request", "side", "words").dropDuplicates(["request", "side"])
    nothing = F.lit(None)
    both = pairs.select("request", F.lit(0).alias("side"), "doc", "other", "known", nothing.cast("binary").alias("words"))
    both = both.unionByName(spans, allowMissingColumns=True).repartition(parts, "request").sortWithinPartitions("request", "side")
    return out.union(cut(both.mapInArrow(_compared(k, window, min_words, min_identity), out.schema)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages of ``min_words`` words or more that another document has too, with ``min_identity`` of words agreeing.

    Returns, in both directions: ``id_col``, start and n_words (of the passage, in words), other_id,
    other_start, other_words and identity. A passage in many documents links each with some others, not
    all, but every document that has it word for word is returned; and every one that has it edited, if a
    stretch of ``min_words`` words of it is alike enough and holds seeds that chain, however many documents have
    these seeds too. Documents without such a passage have no row.
    Words are lower-cased (A-Z).

    Null, empty and short texts: no rows. Null id: takes no part. Rows that repeat an id: passages are
    looked for in other ids only. Empty table: no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    parts = n_parts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = _buckets(spark)
    seeds = rows.mapInArrow(_seeds(k, window, FREQUENT, buckets), PACKED)
    met = seeds.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(buckets), PACKED)
    found = met.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_chain(k, window, min_words), "doc long, other long, a0 int, a1 int, b0 int, b1 int, a binary, b binary")
    found = cut(found.withColumn("request", F.xxhash64("doc", "other", "a0", "a1", "b0", "b1")))
    asked = found.filter("doc <> other")
    held = found.filter("doc = other and a0 >= 0").select(F.col("doc").alias("id"), F.col("a0").alias("low"), F.col("a1").alias("high"))
    sides = asked.select("request", F.lit(1).alias("side"), F.col("doc").alias("id"), F.col("a0").alias("low"), F.col("a1").alias("high"))
    sides = sides.union(asked.select("request", F.lit(2), "other", "b0", "b1"))
    # A span that many ask for is read once. Few enough go to the texts; else both meet by id.
    wanted = cut(sides.select("id", "low", "high").distinct())
    how = "broadcast" if wanted.count() <= MOST_SENT else "merge"
    spans = rows.join(wanted.hint(how), "id").select("id", "low", "high", "text").mapInArrow(_spans(min_words), "id long, low int, high int, start int, words binary")
    spans = sides.join(spans, ["id", "low", "high"]).dropDuplicates(["request", "side"])
    nothing = F.lit(None)
    both = asked.select("request", F.lit(0).alias("side"), "doc", "other", "a", "b", nothing.cast("int").alias("start"), nothing.cast("binary").alias("words"))
    both = both.union(spans.select("request", "side", nothing.cast("long"), nothing.cast("long"), nothing.cast("binary"), nothing.cast("binary"), "start", "words"))
    out = both.repartition(parts, "request").sortWithinPartitions("request", "side").mapInArrow(_aligned(k, min_words, min_identity), "doc long, start int, n_words int, other long, other_start int, other_words int, identity double")
    out = cut(_rest(rows, held, cut(out), min_words))
    shared = found.filter("doc = other and a0 < 0").select(F.col("doc").alias("id"), F.col("a").alias("places"), F.col("b").alias("partly"))
    out = _all_meet(rows, shared, out, k, window, min_words, min_identity)
    there = out.select(F.col("doc").alias(id_col), "start", "n_words", F.col("other").alias("other_id"), "other_start", "other_words", "identity")
    back = out.select("other", "other_start", "other_words", "doc", "start", "n_words", "identity")
    return there.union(back).distinct()
