"""Cosine scores and the best rows of a block of them, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCORE_BLOCK = 256  # queries scored at once: 256 x 10,000 scores are 20 MB
_EXACT = 16_384  # pairs worked out in full at once
_HELD = 1 << 20  # and kept until they are merged


def matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to one width, and their lengths."""
    arrays = [np.asarray(v, dtype=np.float64) for v in vectors]
    lengths = np.array([len(a) for a in arrays], dtype=np.int64)
    if len(arrays) and (lengths == lengths[0]).all():
        return np.vstack(arrays) if lengths[0] else np.zeros((len(arrays), 0)), lengths
    out = np.zeros((len(arrays), int(lengths.max()) if len(arrays) else 0))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out, lengths


def cosines(queries: np.ndarray, q_len: np.ndarray, vectors: np.ndarray, v_len: np.ndarray) -> np.ndarray:
    """Scores (queries x vectors). Vectors of different length are compared on the common prefix:
    the query norm uses its full length, the vector norm the prefix; a zero norm scores 0."""
    width = min(queries.shape[1], vectors.shape[1])
    dot = queries[:, :width] @ vectors[:, :width].T
    q_norm = np.sqrt((queries * queries).sum(axis=1))
    if len(q_len) == 0 or len(v_len) == 0 or v_len.max() <= q_len.min():
        v_norm = np.broadcast_to(np.sqrt((vectors * vectors).sum(axis=1)), dot.shape)
    else:
        squares = np.concatenate([np.zeros((len(vectors), 1)), np.cumsum(vectors * vectors, axis=1)], axis=1)
        v_norm = np.sqrt(squares[:, np.minimum(q_len, vectors.shape[1])]).T
    norm = q_norm[:, None] * v_norm
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.where(norm > 0, dot / norm, 0.0)
    return np.round(scores, 9) + 0.0


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the positions of the k best, ties by key; everything tied with the k-th counts."""
    order = np.argsort(keys, kind="stable")
    picks = []
    for row in scores:
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            candidates = order[row[order] >= floor]
        else:
            candidates = order
        picks.append(candidates[np.argsort(-row[candidates], kind="stable")][:k])
    return picks


def best_rows(query_ids, scores, keys, k, key) -> pd.DataFrame:
    picks = _best(scores, keys, k)
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, [len(p) for p in picks]),
            key: np.concatenate([keys[p] for p in picks]) if picks else keys[:0],
            "score": np.concatenate([scores[i, p] for i, p in enumerate(picks)]) if picks else np.zeros(0),
        }
    )


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in single precision (zero rows stay zero), and their lengths."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    return (rows / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32), norm


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few hits, eight cells at a glance."""
    flat = np.ascontiguousarray(mask).ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.concatenate([(some[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return np.divmod(at[flat[at]], mask.shape[1])


class Best:
    """The k best (score, key) of each query so far, ties by key. ``floor`` is what a score must reach to count."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, k: int, keys: np.dtype):
        self.queries, self.k = queries, k
        self.unit, self.norm = units(queries)
        self.floor = floor.copy()
        self.scores = np.full((len(queries), k), -np.inf)
        self.keys = np.zeros((len(queries), k), keys)

    def add(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> None:
        """Compare the queries ``rows`` with ``vectors``: what single precision cannot rule out is worked out in full."""
        dim, width = self.queries.shape[1], vectors.shape[1]
        found, held = [], 0
        if dim == width:
            unit, norm = units(vectors)
            slack = 1e-6 + 4 * (dim + 8) * 2.0**-24  # more than products of unit rows can be off
            for a in range(0, len(rows), SCORE_BLOCK):
                part = rows[a : a + SCORE_BLOCK]
                who, what = _places(self.unit[part] @ unit.T >= (self.floor[part] - slack).astype(np.float32)[:, None])
                for b in range(0, len(who), _EXACT):
                    r, c = part[who[b : b + _EXACT]], what[b : b + _EXACT]
                    scale = self.norm[r] * norm[c]
                    dot = np.einsum("ij,ij->i", self.queries[r], vectors[c])
                    score = np.round(np.where(scale > 0, dot / np.where(scale > 0, scale, 1.0), 0.0), 9) + 0.0
                    good = score >= self.floor[r]
                    found.append((r[good], score[good], c[good]))
                    held += len(found[-1][0])
                if held > _HELD:
                    self._merge(*(np.concatenate(x) for x in zip(*found)), keys)
                    found, held = [], 0
        else:
            for a in range(0, len(rows), SCORE_BLOCK):
                part = rows[a : a + SCORE_BLOCK]
                score = cosines(self.queries[part], np.full(len(part), dim), vectors, lengths)
                who, what = np.nonzero(score >= self.floor[part][:, None])
                self._merge(part[who], score[who, what], what, keys)
        if found:
            self._merge(*(np.concatenate(x) for x in zip(*found)), keys)

    def _merge(self, row: np.ndarray, score: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        score = np.concatenate([self.scores[touched].ravel(), score])
        key = np.concatenate([self.keys[touched].ravel(), keys[at]])
        real = np.isfinite(score)
        row, score, key = row[real], score[real], key[real]
        order = np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], -score, row))
        row, score, key = row[order], score[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        row, place = row[kept], place[kept]
        self.scores[touched] = -np.inf
        self.scores[row, place], self.keys[row, place] = score[kept], key[kept]
        self.floor[touched] = np.maximum(self.floor[touched], self.scores[touched, -1])
