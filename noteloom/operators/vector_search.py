"""Exact cosine top-k of a batch of query vectors over a large vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.operators.text_search import top_k
from noteloom.operators.vector_index import VectorIndex
from noteloom.operators.vector_math import SCORE_BLOCK, best_rows, cosines, matrix
from noteloom.runtime import bounded_rows

# Query vectors shipped to every task: 2,048 x 3,072 doubles are 48 MB.
QUERY_BLOCK = 2048


def _keep_best(frames: list[pd.DataFrame], key: str, k: int) -> pd.DataFrame:
    """A task's k best rows per query over the batches seen so far."""
    rows = pd.concat(frames, ignore_index=True).sort_values(["query_id", "score", key], ascending=[True, False, True])
    return rows.groupby("query_id", sort=False).head(k)


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    key: str,
    k: int,
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors of each query, exactly.

    A query batch within ``query_block`` rows is shipped to the vector scan; each Arrow batch is one
    matrix product and emits at most k rows per query. For a longer batch the vectors are indexed around pivots
    (:class:`VectorIndex`) and each query visits only the blocks that can hold one of its neighbours.
    """
    q = queries.select("query_id", F.col(vector).alias("qv")).where(
        F.exists("qv", lambda x: x != 0)  # a zero query has no neighbours
    )
    v = vectors.select(key, F.col(vector).alias("v"))
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField(key, v.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    rows = bounded_rows(q, query_block)
    if rows is not None:
        ids = np.array([r["query_id"] for r in rows])
        rows_matrix, lengths = matrix(pd.Series([r["qv"] for r in rows], dtype=object))
        shipped = queries.sparkSession.sparkContext.broadcast((ids, rows_matrix, lengths))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q_matrix, q_lengths = shipped.value
            held: list[pd.DataFrame] = []
            for batch in batches:
                if not len(batch):
                    continue
                m, n = matrix(batch["v"])
                keys = batch[key].to_numpy()
                for at in range(0, len(q_ids), SCORE_BLOCK):
                    part = slice(at, at + SCORE_BLOCK)
                    scores = cosines(q_matrix[part], q_lengths[part], m, n)
                    held.append(best_rows(q_ids[part], scores, keys, k, key))
                if sum(map(len, held)) > 16 * k * len(q_ids):
                    held = [_keep_best(held, key, k)]
            if held:
                yield _keep_best(held, key, k)

        local = v.mapInPandas(scan, schema)
    else:
        return VectorIndex.build(v, key, "v").search(q, k, "qv")[0]
    return top_k(local, k, [key]).select("query_id", key, "score", F.col("rank").cast("int").alias("rank"))
