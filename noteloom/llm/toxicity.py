"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

A word enters the network as a vector of word inputs (how much more often its cell occurs in toxic than in
clean training documents, and fixed signs of its hash) and character inputs (the same for its byte 4-grams:
largest and mean value). Two gated recurrent layers read a window forwards and backwards; attention
weighs their states and a logistic unit scores the window. All overlapping windows of a document
are scored; its score is that of the worst window, so a toxic sentence in a long text is not diluted.

The network is trained in numpy on a bounded sample of labelled documents, on their most suspicious windows.
For training documents the counts leave out the document itself. Scoring is one scan of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_rows, pieces_of, word_hashes
from noteloom.llm.quality_model import _CLASS, held_out, training_rows

CELLS = 1 << 16
WINDOW, STRIDE = 48, 32
INPUTS, HIDDEN = 8, 8
SAMPLE = 3000  # labelled documents of each class that the network is trained on, at most
PRIOR = 2.0  # documents of either class that are added to the counts of every cell
STEPS, BATCH = 400, 128
THRESHOLD = 0.5
_SEED = 5


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in small letters with every other sign blank and a blank before each row; word starts, ends, row offsets."""
    data = np.insert(data, offsets[:-1], 32)
    rows = offsets + np.arange(len(offsets))
    rows[-1] = len(data)
    upper = (data >= 65) & (data <= 90)
    data = np.where(_CLASS[data] == 1, data + upper.astype(np.uint8) * np.uint8(32), np.uint8(32))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    return data, starts, ends, np.searchsorted(starts, rows)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all 4-grams by position, and the first and last + 1 position of each word's; the blank before counts."""
    d = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    code = d[:-4] | d[1:-3] << np.uint32(8) | d[2:-2] << np.uint32(16) | d[3:-1] << np.uint32(24)
    cells = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return cells, starts - 1, np.maximum(ends - 3, starts)


def _word_cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(data, starts, ends)
    return (h % np.uint64(CELLS)).astype(np.int64), h


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of clean and toxic documents of each word cell (below CELLS) and 4-gram cell."""
    seen = np.zeros((2, 2 * CELLS), np.int64)
    for part in pieces_of(batches, "text", 1 << 20):
        data, starts, ends, at = split_words(*byte_rows(part.column("text")))
        cells, lo, hi = _grams(data, starts, ends)
        words = _word_cells(data, starts, ends)[0]
        for k, y in enumerate(part.column("y").to_pylist()):
            a, b = at[k], at[k + 1]
            if b > a:
                grams = cells[lo[a] : hi[b - 1]].astype(np.int64) + CELLS
                seen[y, np.unique(np.concatenate([words[a:b], grams]))] += 1
    full = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(full), pa.array(seen[0, full]), pa.array(seen[1, full])], names=["cell", "clean", "toxic"]
    )


class Inputs:
    """The log odds of all cells, also without one document of either class, and the inputs of words."""

    def __init__(self, clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> None:
        def odds(c: np.ndarray, t: np.ndarray, n0: int, n1: int) -> np.ndarray:
            p1 = (np.maximum(t, 0) + PRIOR) / (max(n1, 0) + 2 * PRIOR)
            p0 = (np.maximum(c, 0) + PRIOR) / (max(n0, 0) + 2 * PRIOR)
            return np.log(p1 / p0).astype(np.float32)

        self.odds = {
            None: odds(clean, toxic, n_clean, n_toxic),
            0: odds(clean - 1, toxic, n_clean - 1, n_toxic),
            1: odds(clean, toxic - 1, n_clean, n_toxic - 1),
        }

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, without: int | None = None) -> np.ndarray:
        odds = self.odds[without]
        words, hashes = _word_cells(data, starts, ends)
        x = np.zeros((len(starts), INPUTS), np.float32)
        if len(starts):
            x[:, 0] = odds[words]
            cells, lo, hi = _grams(data, starts, ends)
            value = np.append(odds[CELLS + cells.astype(np.int64)], np.float32(0))
            cuts = np.stack([lo, hi], 1).ravel()
            x[:, 1] = np.maximum.reduceat(value, cuts)[::2]
            x[:, 2] = np.add.reduceat(value, cuts)[::2] / (hi - lo)
            x[:, 3] = np.minimum(ends - starts, 20) / 10
            for k in range(4, INPUTS):
                x[:, k] = ((hashes >> np.uint64(20 + k)) & np.uint64(1)).astype(np.float32) * 0.5 - 0.25
        return x


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of all overlapping windows; a row without words has one empty window."""
    n = np.diff(at)
    many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = at[:-1][row] + nth * STRIDE
    return first, np.minimum(at[1:][row] - first, WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Recurrent:
    """Weights of the network; inputs are (time, window, INPUTS), ``mask`` (time, window) is 0 after a window's end."""

    def __init__(self, seed: int = _SEED) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = rng.standard_normal((INPUTS, 3 * h)) * 0.4
            self.w["h" + d] = rng.standard_normal((h, 3 * h)) * 0.3
            self.w["b" + d] = np.zeros(3 * h)
        self.w["query"], self.w["out"], self.w["bias"] = rng.standard_normal(2 * h) * 0.3, rng.standard_normal(2 * h) * 0.3, np.zeros(1)
        self.rate: float | None = None

    def run(self, direction: str, inputs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction from inputs that are already multiplied by its input weights."""
        u, h = self.w["h" + direction], HIDDEN
        state = np.zeros((inputs.shape[1], h), inputs.dtype)
        out = np.empty((*inputs.shape[:2], h), inputs.dtype)
        order = range(len(inputs)) if direction == "f" else range(len(inputs) - 1, -1, -1)
        for t in order:
            v = state @ u
            gates = _sigmoid(inputs[t, :, : 2 * h] + v[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = 2 * _sigmoid(2 * (inputs[t, :, 2 * h :] + r * v[:, 2 * h :])) - 1
            if keep is not None:
                keep.append((t, state, z, r, new, v[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def attend(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        energy = np.where(mask > 0, states @ self.w["query"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(0)) * mask
        weight /= weight.sum(0).clip(1e-9)
        return np.einsum("tn,tnh->nh", weight, states), weight

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> None:
        """Adam on the log loss, with both classes equally often in a batch; a fixed number of steps."""
        rng = np.random.default_rng(_SEED)
        groups = [np.flatnonzero(y == k) for k in (0, 1)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        h = HIDDEN
        for step in range(1, STEPS + 1):
            rows = np.concatenate([g[rng.integers(0, len(g), BATCH // 2)] for g in groups])
            xb, mb, yb = x[:, rows], mask[:, rows], y[rows]
            kept: dict[str, list] = {"f": [], "b": []}
            states = np.concatenate([self.run(d, xb @ self.w["x" + d] + self.w["b" + d], kept[d]) for d in "fb"], 2)
            pooled, weight = self.attend(states, mb)
            p = _sigmoid(pooled @ self.w["out"] + self.w["bias"])
            d_logit = (p - yb) / len(rows)
            grads = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
            d_pooled = d_logit[:, None] * self.w["out"]
            d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
            d_energy = weight * (d_weight - (weight * d_weight).sum(0))
            grads["query"] = np.einsum("tn,tnh->h", d_energy, states)
            d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * self.w["query"]
            for k, d in enumerate("fb"):
                u, carry = self.w["h" + d], 0.0
                gx, gu = np.zeros((len(xb), len(rows), 3 * h)), np.zeros_like(u)
                for t, before, z, r, new, v in reversed(kept[d]):
                    ds = d_states[t, :, k * h : (k + 1) * h] + carry
                    d_new = ds * (1 - z) * (1 - new * new)
                    d_z = ds * (before - new) * z * (1 - z)
                    d_r = d_new * v * r * (1 - r)
                    gx[t] = np.concatenate([d_z, d_r, d_new], 1)
                    inner = np.concatenate([d_z, d_r, d_new * r], 1)
                    gu += before.T @ inner
                    carry = ds * z + inner @ u.T
                grads["x" + d] = np.einsum("tni,tnj->ij", xb, gx)
                grads["h" + d], grads["b" + d] = gu, gx.sum((0, 1))
            rate = 0.01 * min(1.0, 2 - 2 * step / STEPS)
            for k, g in grads.items():
                g = g + 1e-4 * self.w[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.w[k] = self.w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def score(self, x: np.ndarray, at: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """The largest window score of each row of words."""
        if self.rate is not None:
            return np.full(len(at) - 1, self.rate)
        first, size, row = windows(at)
        x = np.concatenate([x, np.zeros((1, INPUTS), np.float32)])
        inputs = {d: (x @ self.w["x" + d] + self.w["b" + d]).astype(np.float32) for d in "fb"}
        out = np.zeros(len(at) - 1)
        steps = np.arange(WINDOW)[:, None]
        for a in range(0, len(first), chunk):
            f, n = first[a : a + chunk], size[a : a + chunk]
            mask = (steps < n).astype(np.float32)
            spot = np.where(steps < n, f + steps, len(x) - 1)
            states = np.concatenate([self.run(d, inputs[d][spot]) for d in "fb"], 2)
            pooled, _ = self.attend(states, mask)
            p = _sigmoid((pooled @ self.w["out"] + self.w["bias"]).astype(np.float64))
            np.maximum.at(out, row[a : a + chunk], p)
        return out


def _training_windows(inputs):
    """The most suspicious window of every training document, and another one of a clean document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 20):
            data, starts, ends, at = split_words(*byte_rows(part.column("text")))
            y = np.array(part.column("y").to_pylist())
            x = {k: inputs.value.rows(data, starts, ends, k) for k in (0, 1)}
            first, size, row = windows(at)
            rows, labels = [], []
            for k in range(len(y)):
                mine = np.flatnonzero(row == k)
                own = x[int(y[k])]
                worth = [own[first[i] : first[i] + size[i], :2].max(1, initial=-9).max(initial=-9) for i in mine]
                picked = [mine[int(np.argmax(worth))]]
                if y[k] == 0 and len(mine) > 1:
                    picked.append(mine[len(mine) // 2])
                for i in picked:
                    rows.append(own[first[i] : first[i] + size[i]].ravel().tobytes())
                    labels.append(int(y[k]))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.binary())], names=["y", "x"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    ``labels`` has doc_id and toxic (0 or 1); rows of the held-out fold are not learned from. A null or
    empty text is one empty window. Without labels of both classes every score is the share of toxic labels
    (0 without any). Only the text enters a score; every window of a text is scored, whatever its length.
    """
    spark = docs.sparkSession
    halves = [training_rows(docs, labels.where(F.col("toxic") == y), "toxic", 5, 0, sample) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1]).select("text", "y")
    clean, toxic = np.zeros(2 * CELLS, np.int64), np.zeros(2 * CELLS, np.int64)
    counts = chosen.mapInArrow(_count_cells, "cell long, clean long, toxic long")
    for cell, c, t in counts.groupBy("cell").agg(F.sum("clean"), F.sum("toxic")).collect():  # one row per cell
        clean[cell], toxic[cell] = c, t
    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    inputs = spark.sparkContext.broadcast(Inputs(clean, toxic, n.get(0, 0), n.get(1, 0)))
    network = Recurrent()
    if len(n) < 2:
        network.rate = float(1 in n)
    else:
        rows = sorted((r["y"], bytes(r["x"])) for r in chosen.mapInArrow(_training_windows(inputs), "y int, x binary").collect())
        x, mask = np.zeros((WINDOW, len(rows), INPUTS)), np.zeros((WINDOW, len(rows)))
        for k, (_, raw) in enumerate(rows):
            one = np.frombuffer(raw, np.float32).reshape(-1, INPUTS)
            x[: len(one), k], mask[: len(one), k] = one, 1
        network.train(x, mask, np.array([y for y, _ in rows], np.float64))
    shared = spark.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 20):
            data, starts, ends, at = split_words(*byte_rows(part.column("text")))
            scores = shared.value.score(inputs.value.rows(data, starts, ends), at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(score, f"doc_id {kind}, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", predicted.alias("predicted"))
