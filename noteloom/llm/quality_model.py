"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Every word cell has a sparse random index vector. A cell's word vector is the sum of the index vectors of its
neighbours over the whole corpus; sums are whole numbers, so they do not depend on the order of tasks. A
document is the mean of its words' vectors. A network with one hidden layer is trained in numpy on a
bounded sample of labelled documents and its probabilities are calibrated by a temperature that is
fitted on a part of the sample it was not trained on.

Corpus passes are single scans; only the table of cells (CELLS * WIDTH numbers) and the sample's vectors come
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_rows, pieces_of, staged, word_hashes

CELLS, WIDTH, NONZERO, REACH, LAGS = 8192, 64, 4, 2, 3
SAMPLE = 8000  # labelled documents that the network is trained on, at most
HIDDEN = 32
THRESHOLD = 0.7
_SEED = 11
# byte classes: 0 white, 1 part of a word (letters, digits, bytes of longer characters), 2 other signs
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, offsets: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all runs of word bytes or of other signs, and the n + 1 offsets of the rows."""
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return (word_hashes(data, starts, ends) % np.uint64(cells)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each cell's index vector."""
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, WIDTH, (CELLS, NONZERO)), rng.choice([-1.0, 1.0], (CELLS, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    position, sign = index_vectors()
    total, count = np.zeros(CELLS * WIDTH), np.zeros(CELLS, np.int64)
    for part in pieces_of(batches, "text", 1 << 20):
        ids, at = tokens(*byte_rows(part.column("text")))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        count += np.bincount(ids, minlength=CELLS)
        for d in range(1, REACH + 1):
            near = np.flatnonzero(row[d:] == row[:-d])
            for a, b in ((ids[near], ids[near + d]), (ids[near + d], ids[near])):
                for k in range(NONZERO):
                    total += np.bincount(a * WIDTH + position[b, k], weights=sign[b, k], minlength=CELLS * WIDTH)
    full = np.flatnonzero(count)
    table = np.rint(total.reshape(CELLS, WIDTH)[full]).astype(np.int64)
    columns = [pa.array(full, pa.int32()), pa.array(count[full]), *[pa.array(table[:, k]) for k in range(WIDTH)]]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", *[f"c{k}" for k in range(WIDTH)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of length 1 of all cells, from every document; a cell that never occurs is 0."""
    schema = "cell int, n long, " + ", ".join(f"c{k} long" for k in range(WIDTH))
    sums = docs.selectExpr("cast(text as binary) as text").mapInArrow(_contexts, schema)
    sums = sums.groupBy("cell").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(WIDTH)])
    table = np.zeros((CELLS, WIDTH))
    for row in sums.collect():  # one row per cell
        table[row[0]] = row[1:]
    return (table / np.sqrt((table * table).sum(1, keepdims=True)).clip(1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each row, and the shares of words equal to one of their next LAGS neighbours.

    The shares are what the mean cannot tell: how often words follow themselves. A row without words is 0.
    """
    ids, at = tokens(data, offsets)
    out = np.zeros((len(at) - 1, WIDTH + LAGS), np.float32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        n = np.diff(at)[full, None]
        out[full, :WIDTH] = np.add.reduceat(vectors[ids], at[full], axis=0) / n
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for d in range(1, LAGS + 1):
            same = row[d:][(ids[d:] == ids[:-d]) & (row[d:] == row[:-d])]
            out[:, WIDTH + d - 1] = np.bincount(same, minlength=len(at) - 1) / np.diff(at).clip(1)
    return out


class Network:
    """One hidden layer, a logistic output and a temperature; inputs are standardised first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 1500, seed: int = _SEED) -> None:
        rng = np.random.default_rng(seed)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (0.0, 1.0)
        self.weights, self.temperature = None, 1.0
        if len(set(y.tolist())) < 2:
            return
        z = ((x - self.mean) / self.scale).astype(np.float64)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        if len(set(y[train].tolist())) < 2:
            held, train = order[:0], order
        w = [rng.standard_normal((z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, steps + 1):
            rows = train[rng.integers(0, len(train), 256)]
            h = np.tanh(z[rows] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
            d = (p - y[rows]) / len(rows)
            dh = d[:, None] * w[2] * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= 0.003 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(held) and len(set(y[held].tolist())) > 1:
            logits = np.tanh(z[held] @ w[0] + w[1]) @ w[2] + w[3]
            tried = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, -(2 * y[held] - 1) * logits / t).mean() for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        a, b, c, d = self.weights
        logits = np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -40, 40)))


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True for the fold of ids that no model learns from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    known = known.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).dropDuplicates(["_id"])
    chosen = staged(known.orderBy(F.xxhash64("_id"), "_id").limit(limit))  # bounded, so it can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.selectExpr("doc_id", "cast(text as binary) as text", "y")


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    ``labels`` has doc_id and quality (0 or 1); rows of the held-out fold are not learned from. A null or
    empty text has the zero vector and gets the network's score for it. Without labels of both classes
    every score is the share of good labels (0.5 without any). Only the text enters a score.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 20):
            rows = pooled(*byte_rows(part.column("text")), vectors.value)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH + LAGS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("doc_id"), lists], names=["y", "doc_id", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fitted = training_rows(docs, labels, "quality", 4, 2, sample).mapInArrow(pool, f"y int, doc_id {kind}, v array<float>")
    rows = sorted(fitted.collect(), key=lambda r: (r["doc_id"], r["v"]))[: 2 * sample]  # ids may repeat in docs
    x = np.array([r["v"] for r in rows], np.float32).reshape(-1, WIDTH + LAGS)
    network = spark.sparkContext.broadcast(Network(x, np.array([r["y"] for r in rows], np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 20):
            scores = network.value.scores(pooled(*byte_rows(part.column("text")), vectors.value))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(score, f"doc_id {kind}, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", predicted.alias("predicted"))
