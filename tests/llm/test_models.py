"""The trained classifiers: folds, held-out accuracy, edge rows and gradients."""

import zlib

import numpy as np

from noteloom.llm import queries
from noteloom.llm.quality_model import score_quality, tokens
from noteloom.llm.toxicity import HIDDEN, INPUTS, Recurrent, score_toxicity, split_words, windows
from tests.llm.frames import TEXTS, edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


def check(spark, query, label, parts, part, least):
    rows = query(spark, SF).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) >= least


def test_quality(spark):
    check(spark, queries.op8_quality_classifier, "quality", 4, 2, 0.95)


def test_toxicity(spark):
    check(spark, queries.op9_toxicity, "toxic", 5, 0, 0.9)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (8, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for score, column in ((score_quality, "quality"), (score_toxicity, "toxic")):
        got = score(edge_docs(spark), labels).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in TEXTS) and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in score(edge_docs(spark), none).collect()} == {0.5 if column == "quality" else 0.0}
        assert score(empty_docs(spark), labels).count() == 0


def test_tokens():
    data = np.frombuffer("ab,, é!x y".encode() + b"" + b"z", np.uint8)
    ids, at = tokens(data, np.array([0, 11, 11, 12]))
    assert np.diff(at).tolist() == [6, 0, 1] and len(ids) == 7  # ab ,, é ! x y | nothing | z


def test_words_and_windows():
    data, starts, ends, at = split_words(np.frombuffer(b"Ab cD;eF", np.uint8), np.array([0, 2, 2, 8]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ef"] and at.tolist() == [0, 1, 1, 3]
    first, size, row = windows(np.array([0, 100, 100, 148, 149]))
    assert row.tolist() == [0, 0, 0, 1, 2, 3] and first.tolist() == [0, 32, 64, 100, 100, 148] and size.tolist() == [48, 48, 36, 0, 48, 1]


def test_network_learns_a_word_in_context():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((48, 400, INPUTS)) * 0.3
    y = (np.arange(400) % 2).astype(float)
    x[rng.integers(0, 48, 400)[y == 1], np.flatnonzero(y == 1), 0] = 3.0
    net = Recurrent()
    net.train(x, np.ones((48, 400)), y)
    flat = x.transpose(1, 0, 2).reshape(-1, INPUTS).astype(np.float32)
    scores = net.score(flat, np.arange(401) * 48)
    assert ((scores > 0.5) == (y == 1)).mean() > 0.95 and HIDDEN >= 2
