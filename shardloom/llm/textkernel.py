"""Hashes of the words and word n-grams of many texts at once, in numpy.

A word's hash is a polynomial over its bytes, summed for all words of a block in one pass. Blocks are
small (half a megabyte, or one text if that is longer), so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240501))
_value = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_value[_space] = 0
_lower = _value.copy()
_lower[65:91] = _lower[97:123]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the information of 64-bit numbers over all their bits; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = (made[0], made[1])
    return _powers


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the bounds of its texts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that follow one another, and the bounds of each text's words."""
    base, end = int(bounds[0]), int(bounds[-1])
    part, inner = data[base:end], bounds - base
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    blank = _space[part]
    begins = ~blank
    begins[1:] &= blank[:-1]
    heads = inner[:-1][inner[:-1] < len(part)]
    begins[heads] = ~blank[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    power, inverse = _power(len(part))
    sums = np.add.reduceat((_lower if lower else _value)[part] * power[: len(part)], starts)
    return mix(sums * inverse[starts]), np.searchsorted(starts, inner)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at each word, so far as n words are left."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_STEP[k % len(_STEP)]) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text, its distinct n-word shingles as sorted hashes.

    A text of fewer words is one shingle, the whole of it; one without words has none.
    """
    data, bounds = bytes_of(texts)
    for first, last in blocks(bounds):
        hashes, ends = words(data, bounds[first : last + 1], lower)
        runs = grams(hashes, n)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= n:
                found = np.sort(runs[a : b - n + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield grams(hashes[a:b], b - a)
            else:
                yield hashes[:0]


_apart = np.ones(256, bool)
_apart[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def stems(data: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...] = (4, 5, 6, 7)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that follow one another, and of their first 4, 5, 6 and 7 bytes.

    Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z. Second:
    the text of each hash. A stem is no word: "cat" as a word and as a stem have different hashes.
    """
    base, end = int(bounds[0]), int(bounds[-1])
    part, inner = data[base:end], bounds - base
    blank = _apart[part]
    begins = ~blank
    begins[1:] &= blank[:-1]
    heads = inner[:-1][inner[:-1] < len(part)]
    begins[heads] = ~blank[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    breaks = np.zeros(len(part) + 1, bool)
    breaks[:-1] = blank
    breaks[inner] = True
    stops = np.flatnonzero(breaks)
    stops = stops[np.searchsorted(stops, starts, "right")]
    power, inverse = _power(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_lower[part] * power[: len(part)], out=sums[1:])
    doc = np.searchsorted(inner, starts, "right") - 1
    found, of = [mix((sums[stops] - sums[starts]) * inverse[starts])], [doc]
    for n in lengths:
        ok = stops - starts >= n
        at = starts[ok]
        found.append(mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)))
        of.append(doc[ok])
    return np.concatenate(found), np.concatenate(of)
