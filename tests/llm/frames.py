"""Small tables with awkward rows, shared by the tests of the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "kept boolean, cls string, tkey string, size string, score string, component_id string, uid long, kind int, _w string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


BASE = prose(1, 80)
TEXTS = [
    (1, BASE),
    (2, BASE),  # copy
    (2, BASE),  # repeated row
    (3, BASE.replace("w", "W", 3) + " end"),  # near copy
    (4, prose(2, 120)),
    (4, prose(3, 60)),  # same id, another text
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "one two three"),
    (9, "ONE two three"),
    (None, prose(4, 70)),
    (None, None),
    (10, "x" * 200_000),
    (11, prose(5, 30_000, 50)),
    (12, ("same words here again. " * 40 + "\n") * 3),
    (13, "é日本 👍 ▁ <s> \x00 \r\n tab\tend"),
    (14, "1 2 3 4 5 6 7 8 9 " * 3000 + "+" * 500 + "a@" * 500 + "1.2." * 500),
]


def edge_docs(spark, rows=None):
    """doc_id, text, lang, source, n_chars and columns whose names clash with those the operators use."""
    rows = TEXTS if rows is None else rows
    data = [
        (i, t, "en", None if k % 5 == 0 else f"src{k % 3}", len(t or ""), True, "c", "t", "s", "x", "z", 1, 2, "w")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def empty_docs(spark):
    return edge_docs(spark).limit(0)
