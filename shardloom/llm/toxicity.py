"""Toxicity by weak supervision.

Many voters look for insults, threats, shouting and the like, by lexicons of four languages and by
patterns; others use stems that labelled documents made stand out; a human label, where there is one,
is one more voter, of bounded weight. A generative label model (EM over the votes of labelled and
unlabelled documents) estimates how accurate each voter is and how far voters err together, and turns
votes into posterior labels: where the voters outweigh a human label, they decide. A linear classifier
over words and stems is trained on the posteriors; it alone scores texts, so it carries over to
documents on which no voter says anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import cut, held_out, prepare
from shardloom.llm.textkernel import blocks, bytes_of, stems

#: Labelled documents that the model is fitted on at most, and as many without a label: those of the lowest MD5 of their id.
SAMPLE = 20_000
#: Words and stems that the classifier has a weight for at most, and those it may choose from.
FEATURES, CANDIDATES = 4096, 65_536
#: A feature that fewer documents have isn't learned.
LEAST = 4
#: What a human label says, and what all other voters together can say at most, in nats.
HUMAN_NATS, MOST_NATS = 6.0, 9.0

#: What a document without a human label counts for in training.
UNSAID = 0.1

LEXICON = {
    "nouns en": "idiot idiots moron morons fool loser losers scum clown trash garbage bastard imbecile jerk freak vermin",
    "nouns de": "trottel schwachkopf abschaum versager dummkopf",
    "nouns fr": "imbécile crétin ordure abruti",
    "nouns es": "basura escoria imbécil payaso perdedor",
    "adjectives en": "stupid worthless pathetic disgusting dumb ugly filthy useless vile repulsive",
    "adjectives de": "dämlich wertlos erbärmlich widerlich",
    "adjectives fr": "stupide minable dégoûtant pathétique",
    "adjectives es": "estúpido inútil patético asqueroso",
}
THREATS = "kill die hang hurt destroy töten sterben tuer mourir matar morir"
_INSULTS = " ".join(LEXICON.values()).split()
_ADDRESS = re.compile(rf"\b(?:you|this|that|such an?|du|dieser|ce|cette|este|esta)\W+(?:\w+\W+)?(?:{'|'.join(_INSULTS)})\b", re.I)
_SILENCE = re.compile(r"\b(?:shut up|get lost|go away|halt die klappe|verschwinde|tais-toi|la ferme|cállate|lárgate)\b", re.I)
_FOLDS = 3
_VOTERS = (*LEXICON, "many insults", "address", "threats", "silence", "shouting", "exclaiming", "no insult")


def hash_of(word: str, stem: bool = False) -> int:
    data, bounds = bytes_of(pa.array([word]))
    n = len(word.encode())
    return int(stems(data, bounds, (n,) if stem else ())[0][-1])


def pattern_votes(text: str) -> list[int]:
    """Of each of ``_VOTERS``: 1 toxic, -1 clean, 0 no opinion."""
    words = re.findall(r"\w+", text.lower())
    found = [sum(w in x for w in words) for x in _LISTS]
    n = sum(found)
    letters = sum(map(str.isalpha, text))
    loud = letters > 20 and sum(map(str.isupper, text)) > 0.5 * letters
    threat = n > 0 and any(w in _THREATS for w in words)
    return [*(int(x > 0) for x in found), int(n > 1), int(n > 0 and bool(_ADDRESS.search(text))), int(threat), int(bool(_SILENCE.search(text))), int(loud), int("!!!" in text), -int(n == 0)]


_THREATS = frozenset(THREATS.split())
_LISTS = [frozenset(x.split()) for x in LEXICON.values()]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Distinct words and stems of each text in the last column, batch by batch."""
    for batch in batches:
        data, bounds = bytes_of(batch.column(batch.num_columns - 1))
        found = []
        for first, last in blocks(bounds):
            hashes, of = stems(data, bounds[first : last + 1])
            order = np.argsort(of, kind="stable")
            found += [np.unique(x) for x in np.split(hashes[order], np.searchsorted(of[order], np.arange(1, last - first)))]
        yield found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, documents) of rows of label and text, summed over some rows at a time."""
    for batch in batches:
        label = np.array(batch.column(0).to_pylist(), np.int64) > 0
        found = next(_features(iter([batch])))
        step = 2000
        for k in range(0, len(found), step):
            flat = np.concatenate(found[k : k + step])
            rows = np.repeat(label[k : k + step], [len(x) for x in found[k : k + step]])
            known, at = np.unique(flat, return_inverse=True)
            toxic, all_ = np.bincount(at, rows, len(known)).astype(np.int64), np.bincount(at, minlength=len(known))
            yield pa.record_batch([pa.array(known.view(np.int64)), pa.array(toxic), pa.array(all_)], ["feature", "toxic", "n"])


def _sampled(candidates: np.ndarray):
    """(id, label, votes, places of the text's features in ``candidates``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [bytes(x + 1 for x in pattern_votes(text or "")) for text in batch.column(2).to_pylist()]
            places = []
            for found in next(_features(iter([batch]))):
                at = np.searchsorted(candidates, found).clip(0, len(candidates) - 1)
                places.append(at[candidates[at] == found].astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(votes, pa.binary()), pa.array(places, pa.binary())], ["id", "label", "votes", "features"])

    return run


def telling(features: list[np.ndarray], weight: np.ndarray, least: int = LEAST, most: int = FEATURES) -> np.ndarray:
    """Features that speak for label 1, by the weight (0 to 1) that documents have of it; sorted."""
    if not sum(map(len, features)):
        return np.zeros(0, np.int64)
    flat = np.concatenate(features)
    rows = np.repeat(weight, [len(x) for x in features])
    known, at = np.unique(flat, return_inverse=True)
    one, all_ = np.bincount(at, rows, len(known)), np.bincount(at, minlength=len(known))
    total, n = weight.sum(), len(weight)
    odds = np.log((one + 0.5) / (total + 1)) - np.log((all_ - one + 0.5) / (n - total + 1))
    strength = np.where((all_ >= least) & (odds > 2.5), odds * np.sqrt(one), -1.0)
    best = np.argsort(-strength, kind="stable")[:most]
    return np.sort(known[best[strength[best] > 3.0]])


def _has(features: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    return np.array([bool(len(known)) and bool(np.isin(x, known, assume_unique=True).any()) for x in features], bool)


def label_model(votes: np.ndarray, human: int | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes (-1, 0, 1), each voter's accuracy, and their correlations.

    EM for P(vote | label). It begins with the majority, in which near copies of a voter count as one,
    or, if there is a ``human`` voter, with the rows that this one speaks on. Voters that agree beyond
    what the label explains share their say: a voter counts with 1 / (1 + its positive residual
    correlations with others). What the human voter says anchors the accuracies of the others. In a
    posterior it counts ``HUMAN_NATS``, and all others up to ``MOST_NATS``, so they may overrule it.
    """
    n, m = votes.shape
    spread = votes - votes.mean(0)
    scale = np.sqrt((spread**2).mean(0)) + 1e-9
    alike = np.maximum((spread.T @ spread) / max(1, n) / np.outer(scale, scale), 0) ** 4  # near 1 for copies only
    rest = [k for k in range(m) if k != human]
    alone = 1 / np.maximum(1, alike[:, rest].sum(1))
    say, corr = alone.copy(), np.eye(m)
    p = np.clip(0.5 + 0.5 * (votes * say).sum(1) / np.maximum(1e-9, (np.abs(votes) * say).sum(1)), 0.02, 0.98)
    weight, spoken = np.ones(n), np.zeros(n, bool)
    if human is not None and votes[:, human].any():
        spoken = votes[:, human] != 0
        anchor = 1 / (1 + np.exp(-HUMAN_NATS * votes[:, human]))
        weight = spoken.astype(float)  # in the first round
    for turn in range(rounds):
        if spoken.any():  # accuracies are measured against human labels where there are some
            p = np.where(spoken, anchor, p)
        prior = np.clip((p * weight).sum() / weight.sum(), 0.01, 0.5)
        table = np.stack([[((votes == v) * (y * weight)[:, None]).sum(0) + 0.5 for v in (-1, 0, 1)] for y in (1 - p, p)])  # label, vote, voter
        table /= table.sum(1, keepdims=True)
        if turn % 5 == 4:
            expect = np.outer(1 - p, table[0, 2] - table[0, 0]) + np.outer(p, table[1, 2] - table[1, 0])
            off = votes - expect
            scale = np.sqrt((off**2).mean(0)) + 1e-9
            corr = (off.T @ off) / n / np.outer(scale, scale)
            say = np.minimum(alone, 1 / (1 + np.maximum(corr - np.eye(m), 0)[:, rest].sum(1).clip(0)))
        logs = np.log(table[1]) - np.log(table[0])
        each = logs[votes + 1, np.arange(m)] * say
        score = each[:, rest].sum(1).clip(-MOST_NATS, MOST_NATS)
        if human is not None:
            score = score + votes[:, human] * HUMAN_NATS
        p = 1 / (1 + np.exp(-np.clip(score + np.log(prior / (1 - prior)), -30, 30)))
        weight = np.ones(n)
    right = ((votes == 1) * p[:, None] + (votes == -1) * (1 - p)[:, None]).sum(0) / np.maximum(1, (votes != 0).sum(0))
    return p, right, corr


def train_linear(features: list[np.ndarray], target: np.ndarray, known: np.ndarray, prior: np.ndarray, counts: np.ndarray | None = None, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the features ``known`` (sorted) and a bias, by logistic regression on soft labels, drawn towards ``prior``.

    A row counts as ``counts`` says, by default 1.
    """
    weight, bias = prior.copy(), -3.0
    if not features:
        return weight, bias
    place = [np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]) for x in features]
    counts = np.ones(len(place)) if counts is None else counts
    counts = counts / counts.sum()
    rows, cols = np.repeat(np.arange(len(place)), [len(x) for x in place]), np.concatenate(place).astype(np.int64)
    m = np.zeros((2, len(known) + 1))
    v = np.zeros((2, len(known) + 1))
    for turn in range(1, rounds + 1):
        score = bias + np.bincount(rows, weight[cols], len(place))
        wrong = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) * counts
        slope = np.append(np.bincount(cols, wrong[rows], len(known)) + 1e-4 * (weight - prior), wrong.sum())
        m[0] = 0.9 * m[0] + 0.1 * slope
        v[0] = 0.999 * v[0] + 0.001 * slope**2
        move = 0.05 * (m[0] / (1 - 0.9**turn)) / (np.sqrt(v[0] / (1 - 0.999**turn)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """The classifier (hashes, weights, bias) and what the label model found.

    That is each voter's accuracy, their correlations, and ``overruled``: the share of human labels whose
    posterior is on the other side. Only rows of ``labels`` that are not held out are read, and at most
    ``sample`` of them; as many documents without a label, none of them held out, take part in the votes.
    Null labels and ids are left out; an id with several labels counts as toxic if one says so. Without
    labelled rows, the built-in word lists are the classifier.
    """
    prepare(docs.sparkSession)
    words = [hash_of(w) for w in _INSULTS]
    by_hash = [F.md5(F.col("id").cast("string")), F.col("id")]
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    chosen = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")).orderBy(*by_hash).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    others = texts.select("id").filter(~held_out(F.col("id"))).join(known.select("id").distinct(), "id", "left_anti").distinct().orderBy(*by_hash).limit(sample)
    chosen = chosen.union(others.select("id", F.lit(None).cast("int")))
    sampled = cut(texts.join(F.broadcast(chosen), "id").select("id", "label", "text"))
    listed = np.unique(np.array(words, np.uint64))
    labelled = sampled.filter("label is not null").select("label", "text")
    n_toxic, n = labelled.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    # Features that toxic documents have more often, over all labelled documents of the sample.
    counts = labelled.mapInArrow(_counted, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - n_toxic + 1))
    telling_ = counts.filter(F.col("toxic") >= LEAST).withColumn("odds", odds).filter("odds > 1").orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "feature").limit(CANDIDATES)
    candidates = np.union1d(np.array([r.feature for r in telling_.select("feature").collect()], np.int64).view(np.uint64), listed)
    rows = sampled.mapInArrow(_sampled(candidates), "id long, label int, votes binary, features binary")
    rows = sorted(rows.collect(), key=lambda r: (r.id, r.features))[: 2 * sample]
    features = [np.frombuffer(r.features, np.int32) for r in rows]
    human = np.array([0 if r.label is None else 1 if r.label > 0 else -1 for r in rows], np.int64)
    report: dict = {"voters": [*_VOTERS, *(f"stems {k}" for k in range(_FOLDS)), "human"], "n": len(rows), "overruled": 0.0}
    target = np.zeros(0)
    if human.any():
        votes = np.array([list(r.votes) for r in rows], np.int64) - 1
        induced = []
        spoken = np.flatnonzero(human)
        for k in range(_FOLDS):  # each from a part of the labelled rows
            part = spoken[k::_FOLDS]
            has = _has(features, telling([features[i] for i in part], (human[part] > 0).astype(float), most=512))
            induced.append(np.where(has, 1, -1))
        target, report["accuracy"], report["correlation"] = label_model(np.column_stack([votes, *induced, human]), human=len(_VOTERS) + _FOLDS)
        report["overruled"] = float(((target > 0.5) != (human > 0))[spoken].mean())
    else:
        features = []
    spoken = np.flatnonzero(human) if len(target) else np.zeros(0, np.int64)
    found = [telling([features[i] for i in part], target[part]) for part in (spoken, np.arange(len(target)))]
    known_features = np.union1d(np.union1d(*found), np.searchsorted(candidates, listed))
    prior = np.where(np.isin(candidates[known_features], listed), 4.0, 0.0)
    if len(target):
        weight, bias = train_linear(features, target, known_features, prior, np.where(human == 0, UNSAID, 1.0))
    else:
        weight, bias = train_linear([], target, known_features, prior)
    return report | {"hashes": candidates[known_features], "weights": weight, "bias": bias, "posterior": target, "human": human}


def _scorer(hashes: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)
        maybe[hashes >> np.uint64(44)] = True
        for batch in batches:
            data, bounds = bytes_of(batch.column(1))
            scores = np.full(len(bounds) - 1, bias)
            for first, last in blocks(bounds):
                found, of = stems(data, bounds[first : last + 1])
                ok = maybe[found >> np.uint64(44)]
                found, of = found[ok], of[ok]
                at = np.searchsorted(hashes, found).clip(0, len(hashes) - 1)
                ok = hashes[at] == found
                if ok.any():
                    once = np.unique(of[ok] * len(hashes) + at[ok])
                    scores[first:last] += np.bincount(once // len(hashes), weights[once % len(hashes)], last - first)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(scores, -30, 30))))], ["id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 if score >= 0.5) for each row of ``docs``.

    Null text counts as empty; an empty text gets the score of a text without any known word. Null id:
    scored, not held out. Repeated rows: each is scored. Empty tables: see :func:`fit`; no rows.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_scorer(model["hashes"], model["weights"], model["bias"]), "id long, score double")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all their columns as they are."""
    model = fit(docs, labels, id_col, text_col, **how)
    verdict = _keeper(model, docs.columns.index(text_col))
    prepare(docs.sparkSession)
    return docs.mapInArrow(verdict, docs.schema)


def _keeper(model: dict, at: int):
    inner = _scorer(model["hashes"], model["weights"], model["bias"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["id", "text"])
            for scored in inner(iter([rows])):
                yield batch.filter(pa.array(scored.column(1).to_numpy() < 0.5))

    return run
