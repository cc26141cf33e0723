"""Language identification by Bayesian evidence fusion.

Four pieces of evidence: the likelihood of the visible text under byte-trigram models of each
language, the language that the markup declares, the suffix of the address, and what is known of the
host. The models come from labelled documents; how far declarations and suffixes can be trusted, and
the priors of hosts, come from all pages by grouped aggregation. A host's prior is smoothed towards
its domain's, and that towards the prior of all pages; the suffix is a factor of its own. What a page's
own text has added to such sums is taken off before they are used for it, so no text counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import cut, prepare
from shardloom.llm.textkernel import blocks, bytes_of

TABLE_BITS = 16
#: Rows of each level that the level above counts for, in smoothing.
SMOOTH = 5.0
#: A trigram's share of the evidence: neighbours aren't independent.
TEMPER = 0.25
#: No text says more than this, in nats a language.
MOST_NATS = 30.0
UNKNOWN = "und"


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all byte trigrams that lie in one text, and each one's text. ASCII case and non-letters are folded."""
    base, end = int(bounds[0]), int(bounds[-1])
    part = _fold[data[base:end]]
    if len(part) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = part.astype(np.uint32)
    cell = ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA77 + x[2:] * 0xC2B2AE3D) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - TABLE_BITS)
    of = np.searchsorted(bounds - base, np.arange(len(cell)), "right") - 1
    ok = np.arange(len(cell)) + 2 < (bounds - base)[of + 1]
    ok &= ~((part[:-2] == 32) & (part[1:-1] == 32))
    return cell[ok].astype(np.int64), of[ok]


_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] = np.arange(97, 123)
_fold[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def _count(langs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << TABLE_BITS), np.int64)
        place = {x: k for k, x in enumerate(langs)}
        for batch in batches:
            own = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            data, bounds = bytes_of(batch.column(1))
            for first, last in blocks(bounds):
                cell, of = _trigrams(data, bounds[first : last + 1])
                total += np.bincount((own[first:last][of] << TABLE_BITS) + cell, minlength=total.size).reshape(total.shape)
        yield pa.record_batch([pa.array(range(len(langs)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["lang", "counts"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[lang] = total.get(lang, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])


def fit_text(docs: DataFrame, langs: tuple[str, ...], text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Log likelihoods (language, cell) from all documents whose language is one of ``langs``; its size is fixed."""
    rows = docs.filter(F.col(lang_col).isin(*langs)).select(F.col(lang_col), F.col(text_col))
    counts = rows.mapInArrow(_count(langs), "lang int, counts binary")
    few = counts.coalesce(64).mapInArrow(_sum, counts.schema)
    total = np.ones((len(langs), 1 << TABLE_BITS))
    for lang, raw in few.repartition(len(langs), "lang").mapInArrow(_sum, counts.schema).collect():  # a table a language
        total[lang] += np.frombuffer(raw, np.int64)
    return np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


def _blank(data: np.ndarray, low: np.ndarray, first: bytes, last: bytes, own: bool = True) -> None:
    """Blanks what lies from each ``first`` to the next ``last``, and that too if it is its ``own``; a ``first`` without one stays."""
    begins, ends = _places(low, first), _places(low, last)
    if not len(begins) or not len(ends):
        return
    at = np.searchsorted(ends, begins + len(first))
    begins, at = begins[at < len(ends)], at[at < len(ends)]
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends[at] + (len(last) if own else 0), -1)
    inside = np.cumsum(change[:-1]) > 0
    data[inside] = low[inside] = 32


def _places(low: np.ndarray, what: bytes) -> np.ndarray:
    n = len(low) - len(what) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(low[:n] == what[0])
    for k, c in enumerate(what[1:], 1):
        found = found[low[found + k] == c]
    return found


def visible(html: bytes) -> bytes:
    """The text of a page: no comments, scripts, styles, tags or entities; each leaves blanks. In time of its length.

    A comment, script, style or tag that doesn't end stays.
    """
    data = np.frombuffer(html, np.uint8).copy()
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    _blank(data, low, b"<!--", b"-->")
    for tag in (b"script", b"style"):
        _blank(data, low, b"<" + tag, b"</" + tag, own=False)
    _blank(data, low, b"<", b">")
    for first in _places(low, b"&").tolist():
        end = html.find(b";", first, first + 34)
        if end > first + 1 and html[first + 1 : end].lstrip(b"#").isalnum():
            data[first : end + 1] = 32
    return data.tobytes()


def declared(html: Column) -> Column:
    """The language that <html lang> declares, or a content-language; '' if none. Region tags are dropped."""
    html = F.coalesce(html, F.lit(""))
    own = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.when(own != "", own).otherwise(meta))


def host(url: Column) -> Column:
    """The host of an address, in lower case, without port and user; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _likelihood(table, n_langs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value
        for batch in batches:
            texts = pa.array([visible(x.as_buffer().to_pybytes()) if x.is_valid else b"" for x in batch.column(4)], pa.large_binary())
            data, bounds = bytes_of(texts)
            out = np.zeros((batch.num_rows, n_langs))
            for first, last in blocks(bounds):
                cell, of = _trigrams(data, bounds[first : last + 1])
                for k in range(n_langs):
                    out[first:last, k] = np.bincount(of, logs[k][cell], last - first)
            out = np.maximum(TEMPER * (out - out.max(1, keepdims=True)), -MOST_NATS) if n_langs else out
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n_langs, pa.int32()), pa.array(out.ravel()))
            yield pa.record_batch([*batch.columns[:4], lists], ["id", "declared", "suffix", "host", "logs"])

    return run


def identify(pages: DataFrame, docs: DataFrame, langs: tuple[str, ...] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", most_langs: int = 200) -> DataFrame:
    """The language of each page.

    Returns one row per row of ``pages``: ``id_col``, lang, posterior (of that language), text_lang (by
    text alone), declared, suffix and host. Languages are those of ``docs``, ``most_langs`` at most
    (ValueError beyond, as the models' size must be bounded), or ``langs``.

    Null or empty html: the rest of the evidence decides; with none, the prior of all pages. Null or odd
    address: no host, so no suffix or host prior. A declaration that is no known language: no evidence.
    Null id, repeated rows: like any other row. No documents with a language: lang 'und', posterior null.
    Ties go to the language that is first in the alphabet.
    """
    spark = prepare(pages.sparkSession)
    if langs is None:
        found = docs.select(lang_col).filter(f"`{lang_col}` is not null").distinct().limit(most_langs + 1).collect()
        if len(found) > most_langs:
            raise ValueError("too many languages")
        langs = tuple(sorted(r[0] for r in found))
    at = host(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), declared(F.col(html_col)).alias("declared"), F.regexp_extract(at, r"\.([a-z][a-z0-9\-]*)$", 1).alias("suffix"), at.alias("host"), F.col(html_col).cast("binary").alias("html"))
    if not langs:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(UNKNOWN).alias("text_lang"), "declared", "suffix", "host")
    table = spark.sparkContext.broadcast(fit_text(docs, langs, text_col, lang_col))
    kind = pages.schema[id_col].dataType.simpleString()
    rows = cut(rows.mapInArrow(_likelihood(table, len(langs)), f"id {kind}, declared string, suffix string, host string, logs array<double>"))
    every = range(len(langs))

    def over_total(values: list[Column]) -> list[Column]:
        total = sum(values[1:], values[0])
        return [v / total for v in values]

    # What the text alone says of each page; its sums are what everything else is learned from.
    soft = over_total([F.exp(F.col("logs")[k]) for k in every])
    rows = rows.select("*", *[x.alias(f"t{k}") for k, x in zip(every, soft, strict=True)])
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    all_ = rows.agg(*[F.coalesce(F.sum(f"t{k}"), F.lit(0.0)) for k in every], F.count("*")).first()

    # Sums of each host, domain, suffix and declaration; rows without one match nothing, each in a part of its own.
    out = rows.withColumn("spread", F.concat(F.lit("/"), F.pmod(F.xxhash64("id", "logs"), F.lit(4096)).cast("string")))
    for name in ("declared", "suffix", "domain", "host"):
        sums = rows.filter(F.col(name) != "").groupBy(F.col(name).alias("key")).agg(F.array(*[F.sum(f"t{k}") for k in every]).alias(f"n_{name}"))
        out = out.withColumn("key", F.when(F.col(name) != "", F.col(name)).otherwise(F.col("spread"))).join(sums, "key", "left").drop("key")

    def others(name: str) -> list[Column]:
        """What pages of the same key but this one have said of each language."""
        return [F.greatest(F.coalesce(F.col(f"n_{name}")[k], F.lit(0.0)) - F.when(F.col(name) != "", F.col(f"t{k}")).otherwise(0.0), F.lit(0.0)) for k in every]

    total = [F.greatest(F.lit(all_[k]) - F.col(f"t{k}"), F.lit(0.0)) for k in every]
    base = over_total([x + 1 for x in total])
    prior = base
    for name in ("domain", "host"):
        out = out.withColumn(name + "_p", F.array(*over_total([x + SMOOTH * p for x, p in zip(others(name), prior, strict=True)])))
        prior = [F.col(name + "_p")[k] for k in every]
    # What a suffix and a declaration say: the share of each language among pages that have it, to that among all pages.
    factors = []
    for name in ("suffix", "declared"):
        said, known = others(name), F.col(name) != ""
        known = known & F.col("declared").isin(*langs) if name == "declared" else known
        sum_ = sum(said[1:], said[0])
        ratio = [(said[k] + SMOOTH * base[k]) / (sum_ + SMOOTH) / base[k] for k in every]
        factors.append([F.when(known, F.log(r)).otherwise(0.0) for r in ratio])
    scores = [F.col("logs")[k] + F.log(prior[k]) + factors[0][k] + factors[1][k] for k in every]
    out = out.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    out = out.withColumn("mass", F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    names = F.array(*map(F.lit, langs))
    return out.select(
        F.col("id").alias(id_col),
        F.element_at(names, F.array_position("scores", F.col("top")).cast("int")).alias("lang"),
        (1 / F.col("mass")).alias("posterior"),
        F.element_at(names, F.array_position("logs", F.array_max("logs")).cast("int")).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
