import math
import random
import zlib

import numpy as np

from shardloom.llm import toxicity
from tests.llm import edge


def corpus(n=900):
    """A fifth is toxic: by known insults, or by stems that only labels tell of."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(n):
        words = edge.prose(i, rng.randint(30, 120)).split()
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,"]) if i % 10 else "zorku" + edge.prose(rng.random(), 1))
        docs.append(edge.row(i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def run(spark, docs, labels):
    return toxicity.score(edge.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in run(spark, docs, labels).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    apart = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in apart]) > 0.97
    assert not any(got[i].predicted for i in apart if i % 5)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (sorted((r.doc_id, r.score) for r in run(spark, docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_edges(spark):
    got = run(spark, edge.texts(), [(1, 0), (2, None), (None, 1), (11, 1), (11, 0)]).collect()
    assert len(got) == len(edge.texts())
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1


def test_without_labels_word_lists_decide(spark):
    docs = [edge.row(1, "you are a worthless idiot and scum"), edge.row(2, "a quiet day by the sea"), edge.row(3, None)]
    got = {r.doc_id: r.predicted for r in run(spark, docs, []).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_empty_and_drop(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(edge.empty(spark), labels).collect() == []
    docs = edge.frame(spark, [*edge.texts(), edge.row(50, "worthless idiot scum")])
    got = toxicity.drop_toxic(docs, labels)
    assert got.columns == docs.columns and got.count() == len(edge.texts())


def test_label_model_finds_good_and_copied_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(len(y)) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair, poor = vote(0.95), vote(0.8), vote(0.6)
    votes = np.column_stack([good, fair, poor, poor, np.zeros(len(y), int)])
    p, right, corr = toxicity.label_model(votes)
    assert right[0] > right[1] > right[2]
    assert corr[2, 3] > 0.9 > corr[0, 1]
    assert ((p > 0.5) == y).mean() > 0.9


def test_shouting_counts_the_whole_text():
    calm = "a " * 60_000
    assert toxicity.pattern_votes(calm + "B " * 300_000) != toxicity.pattern_votes(calm + "b " * 300_000)


def plain_model(votes, human, rounds):
    """The label model, row by row and voter by voter; without residual correlations, which come after four rounds."""
    n, m = len(votes), len(votes[0])
    mean = [sum(r[j] for r in votes) / n for j in range(m)]
    cov = lambda j, k: sum((r[j] - mean[j]) * (r[k] - mean[k]) for r in votes) / n
    dev = [cov(j, j) ** 0.5 + 1e-9 for j in range(m)]
    rest = [j for j in range(m) if j != human]
    say = [1 / max(1, sum(max(cov(j, k) / dev[j] / dev[k], 0) ** 4 for k in rest)) for j in range(m)]
    p, weight = [0.0] * n, [float(r[human] != 0) for r in votes]
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-toxicity.HUMAN_NATS * r[human])) if r[human] else x for r, x in zip(votes, p)]
        prior = min(0.5, max(0.01, sum(x * w for x, w in zip(p, weight)) / sum(weight)))
        logs = []
        for j in range(m):
            toxic = {v: 0.5 + sum(x * w for r, x, w in zip(votes, p, weight) if r[j] == v) for v in (-1, 0, 1)}
            clean = {v: 0.5 + sum((1 - x) * w for r, x, w in zip(votes, p, weight) if r[j] == v) for v in (-1, 0, 1)}
            logs.append({v: math.log(toxic[v] / sum(toxic.values())) - math.log(clean[v] / sum(clean.values())) for v in (-1, 0, 1)})
        p = []
        for r in votes:
            score = sum(logs[j][r[j]] * say[j] for j in rest)
            score = max(-toxicity.MOST_NATS, min(toxicity.MOST_NATS, score)) + toxicity.HUMAN_NATS * r[human] + math.log(prior / (1 - prior))
            p.append(1 / (1 + math.exp(-score)))
        weight = [1.0] * n
    return p


def noisy_votes(n=400):
    rng = np.random.default_rng(5)
    y = rng.random(n) < 0.25
    cols = [np.where(rng.random(n) < 0.7, np.where(rng.random(n) < right, y, ~y) * 2 - 1, 0) for right in (0.9, 0.92, 0.85, 0.9, 0.95, 0.9, 0.93, 0.88, 0.9, 0.92, 0.95, 0.9)]
    human = np.where(rng.random(n) < 0.6, np.where(rng.random(n) < 0.97, y, ~y) * 2 - 1, 0)
    return y, np.column_stack([*cols, human])


def test_label_model_against_plain_em():
    _, votes = noisy_votes()
    got = toxicity.label_model(votes, human=12, rounds=4)[0]
    assert np.allclose(got, plain_model(votes.tolist(), 12, 4))


def test_voters_overrule_wrong_human_labels():
    y, votes = noisy_votes(4000)
    p = toxicity.label_model(votes, human=12)[0]
    spoken = votes[:, 12] != 0
    wrong = spoken & ((votes[:, 12] > 0) != y)
    turned = spoken & ((p > 0.5) != (votes[:, 12] > 0))
    assert turned[wrong].mean() > 0.3 and turned[spoken & ~wrong].mean() < 0.02
    assert ((p > 0.5) == y)[~spoken].mean() > 0.9
