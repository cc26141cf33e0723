import math
import random
import re
import time
from collections import defaultdict

import numpy as np

from shardloom.llm import langid

WORDS = {"en": "the of and that with from this have which there".split(), "de": "der die und nicht mit ein sich auch werden zwischen".split(), "fr": "le les dans pour une qui avec être cette nous".split()}
PAGES = "page_id long, url string, html string, host string, text string"


def say(lang, seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def docs(spark):
    return spark.createDataFrame([(i, say(x, i, 60), x) for i, x in enumerate(list(WORDS) * 20)] + [(100, None, "en"), (101, "x", None)], "doc_id long, text string, lang string")


def run(spark, rows):
    return langid.identify(spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES), docs(spark)).collect()


def test_text_wins_where_there_is_text(spark):
    rows = [(i, f"http://h{i % 5}.example.com/{i}", f"<html lang='{'en' if i % 4 else x}'><script>the the the</script><p>{say(x, 900 + i, 40)}</p></html>") for i, x in enumerate(list(WORDS) * 20)]
    got = {r.page_id: r for r in run(spark, rows)}
    assert all(got[i].lang == x for i, x in enumerate(list(WORDS) * 20))
    assert all(0.9 < r.posterior <= 1 + 1e-9 for r in got.values())


def test_hosts_and_declarations_decide_where_there_is_none(spark):
    rows = [(i, f"https://www.seite{i % 3}.de/{i}", f"<html lang=de-AT><p>{say('de', i, 40)}") for i in range(40)]
    rows += [(100 + i, f"https://www.page{i % 3}.fr/{i}", f"<html lang='fr'><p>{say('fr', i, 40)}") for i in range(40)]
    rows += [(200, "https://www.seite1.de/x", ""), (201, "https://other.fr/x", None), (202, None, "<html lang=fr></html>"), (203, "https://u:p@WWW.seite2.de:80/", "<p></p>")]
    got = {r.page_id: r for r in run(spark, rows)}
    assert [got[i].lang for i in (200, 201, 202, 203)] == ["de", "fr", "fr", "de"]
    assert got[203].host == "www.seite2.de" and got[203].suffix == "de" and got[0].declared == "de"


def test_edges(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "no address", "<html lang=xx>" + "word " * 50_000), (3, "http://a.b", "<" * 1000)]
    got = run(spark, rows)
    assert len(got) == 5 and all(r.lang in WORDS and 0 < r.posterior <= 1 for r in got)
    assert run(spark, []) == []
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    page = spark.createDataFrame([(1, "http://a.b", "x", "h", "t")], PAGES)
    assert [(r.lang, r.posterior) for r in langid.identify(page, none).collect()] == [("und", None)]


def test_against_brute_force(spark):
    """All but the counting of trigrams, page by page in plain Python."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        url = rng.choice([None, "", f"http://{rng.choice('ab')}.site{rng.randrange(5)}.{rng.choice(['de', 'fr', 'com'])}/{i}", "https://only.fr/x"])
        mark = rng.choice(["", f" lang={lang}", " lang='en'", " lang=xx"])
        rows.append((rng.choice([i, i, None]), url, None if i % 17 == 0 else f"<html{mark}><!-- the of --><p>{say(lang, i, rng.choice([0, 1, 2, 3, 20]))}</p>&amp;"))
    langs = tuple(sorted(WORDS))
    table = langid.fit_text(docs(spark), langs)
    pages = []
    for doc, url, html in rows:
        text = langid.visible((html or "").encode())
        cell, _ = langid._trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        logs = [float(table[k][cell].sum(dtype=np.float64)) for k in range(3)]
        logs = [max(langid.TEMPER * (x - max(logs)), -langid.MOST_NATS) for x in logs]
        soft = [math.exp(x) / sum(map(math.exp, logs)) for x in logs]
        m = re.match(r"https?://([^/]+)", url or "")
        host = m[1] if m else ""
        d = re.search(r"lang='?([a-z]+)", html or "")
        pages.append({"id": doc, "logs": logs, "soft": soft, "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.rpartition(".")[2], "declared": d[1] if d else ""})
    share = lambda x: [y / sum(x) for y in x]
    want = []
    for p in pages:
        others = [q for q in pages if q is not p]
        said = lambda name: [sum(q["soft"][k] for q in others if p[name] and q[name] == p[name]) for k in range(3)]  # noqa: E731,B023
        base = share([sum(q["soft"][k] for q in others) + 1 for k in range(3)])
        prior = base
        for name in ("domain", "host"):
            prior = share([n + langid.SMOOTH * x for n, x in zip(said(name), prior)])
        scores = [x + math.log(y) for x, y in zip(p["logs"], prior)]
        for name in ("suffix", "declared"):
            if p[name] and (name == "suffix" or p[name] in langs):
                n = said(name)
                scores = [x + math.log((n[k] + langid.SMOOTH * base[k]) / (sum(n) + langid.SMOOTH) / base[k]) for k, x in enumerate(scores)]
        mass = share([math.exp(x - max(scores)) for x in scores])
        want.append((p["id"], langs[scores.index(max(scores))], round(max(mass), 6), langs[p["logs"].index(max(p["logs"]))], p["declared"], p["suffix"], p["host"]))
    got = [(r.page_id, r.lang, round(r.posterior, 6), r.text_lang, r.declared, r.suffix, r.host) for r in run(spark, rows)]
    near = lambda x: defaultdict(list, {k: x[k] for k in range(len(x))})
    assert near(sorted(got, key=str)) == near(sorted(want, key=str))


def test_a_page_does_not_vouch_for_itself(spark):
    rows = [(i, f"http://h{i}.com/", f"<p>{say('de', i, 30)}") for i in range(20)] + [(99, "http://alone.org/", "<p>the der le")]
    alone, without = (next(r for r in run(spark, x) if r.page_id == 99) for x in (rows, [*rows[:-1], (99, None, "<p>the der le")]))
    assert abs(alone.posterior - without.posterior) < 1e-9


def test_visible_takes_time_of_the_length_only():
    for what in (b"<!-- ", b"<script ", b"< ", b"& ", b"<style><script><!--"):
        began = time.time()
        assert len(langid.visible(what * (4_000_000 // len(what)))) > 3_999_000
        assert time.time() - began < 20
    assert langid.visible(b"<p>a<!-- <b> -->b<SCRIPT>x</script >c<style>y</style>&eacute;d &x<").split() == [b"a", b"b", b"c", b"d", b"&x<"]
