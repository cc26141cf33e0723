"""A small corpus with every odd case, and what tests share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns beyond those of documents, with names that operators might use inside.
CLASHING = ("id", "size", "node", "token", "sha", "bytes", "copies", "times", "kept", "nth", "no_id", "rows", "each", "gone", "slot", "shard", "score", "bin", "root", "block", "__id", "__of", "__nth", "__sha", "__copies", "__rows", "__each", "__gone", "__slot", "__shard")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), *(f"{c} of {doc_id}" for c in CLASHING))


def texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        row(1, base),
        row(2, base, "t"),
        row(3, " ".join(near), None),
        row(4, None),
        row(5, "", None),
        row(6, " \t\n "),
        row(7, "one two"),
        row(8, "one two", "u"),
        row(9, "One TWO"),
        row(10, prose(2, 9000), "t"),
        row(11, prose(3, 200), "u"),
        row(11, prose(3, 200), "u"),
        row(None, prose(4, 80)),
        row(None, None, None),
        row(12, "ä " + prose(5, 60)),
        row(13, prose(6, 60) + " x"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)


def empty(spark):
    return frame(spark, [])
