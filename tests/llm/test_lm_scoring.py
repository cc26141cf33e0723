import math
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import lm_scoring
from tests.llm import edge


def expected(rows, leave_out, order=3, a=0.4):
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    docs = [edge.words(r[1]) for r in rows]
    total = Counter(g for w in docs for n in range(1, order + 1) for g in grams(w, n))
    tokens, out = sum(map(len, docs)), []
    for r, w in zip(rows, docs, strict=True):
        own = Counter(g for n in range(1, order + 1) for g in grams(w, n)) if leave_out else Counter()
        score = 0.0
        for i in range(len(w)):
            back = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = total[g] - own[g]
                if n == 1:
                    score += back * math.log(a) + math.log(max(c, 1) / max(1, tokens - (len(w) if leave_out else 0)))
                elif c > 0:
                    score += back * math.log(a) + math.log(c / (total[g[:-1]] - own[g[:-1]]))
                    break
                back += 1
        out.append((r[0], len(w), round(score, 6), round(score / len(w), 6) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("leave_out", [True, False])
def test_against_brute_force(spark, leave_out):
    rows = edge.texts() + [edge.row(100 + i, edge.prose(i % 9, 30 + i)) for i in range(40)] + [edge.row(200 + i, "the cat sat on the mat") for i in range(5)]
    got = lm_scoring.score(edge.frame(spark, rows), leave_out=leave_out, chunk_rows=7).collect()
    assert sorted(((r.doc_id, r.n_tokens, round(r.log_score, 6), None if r.mean_score is None else round(r.mean_score, 6)) for r in got), key=str) == expected(rows, leave_out)


def test_empty(spark):
    assert lm_scoring.score(edge.empty(spark)).collect() == []


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        x = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (lm_scoring._expand(lm_scoring._squeeze(x)) == x).all()
        assert (lm_scoring._read_counts(lm_scoring._counts(x % 1000)) == (x % 1000).astype(np.int64)).all()


def test_exchange_is_made_once(spark):
    plan = lm_scoring.score(edge.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") <= 4
