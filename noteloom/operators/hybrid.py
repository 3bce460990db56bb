"""Reciprocal rank fusion of the text and the vector list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import rounded

RRF_K = 60  # fixed value of the fusion formula


def pool_size(k: int) -> int:
    """Candidates each list contributes before fusion."""
    return max(2 * k, 50)


def fuse(text_hits: DataFrame, vector_hits: DataFrame, key: str, k: int, known: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, match_type, rank) from two ranked lists (query_id, key, score, rank).

    A query without vector hits keeps its plain text list and scores. Both lists hold at most
    ``pool_size(k)`` rows per query, so the union and the one shuffle by query stay small. Ids that
    are not in ``known`` are dropped before ranking.
    """
    if known is not None:
        vector_hits = vector_hits.join(known.select(key), key, "left_semi")
        w = Window.partitionBy("query_id").orderBy("rank")
        vector_hits = vector_hits.withColumn("rank", F.row_number().over(w))
    lists = text_hits.select(
        "query_id", key, F.col("score").alias("t_score"), F.col("rank").alias("t_rank"), F.lit(None).cast("int").alias("v_rank")
    ).unionByName(
        vector_hits.select(
            "query_id", key, F.lit(None).cast("double").alias("t_score"), F.lit(None).cast("int").alias("t_rank"), F.col("rank").alias("v_rank")
        )
    )
    merged = lists.groupBy("query_id", key).agg(
        F.max("t_score").alias("t_score"), F.max("t_rank").alias("t_rank"), F.max("v_rank").alias("v_rank")
    )
    by_query = Window.partitionBy("query_id")
    part = lambda r: F.coalesce(1.0 / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    scored = merged.withColumn("_semantic", F.max("v_rank").over(by_query).isNotNull()).select(
        "query_id",
        key,
        "t_rank",
        "v_rank",
        F.when(F.col("_semantic"), rounded(part("t_rank") + part("v_rank"))).otherwise(F.col("t_score")).alias("score"),
        F.when(F.col("v_rank").isNull(), "text").when(F.col("t_rank").isNull(), "semantic").otherwise("hybrid").alias("match_type"),
    )
    order = by_query.orderBy(F.desc("score"), F.asc_nulls_last("t_rank"), F.asc("v_rank"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", key, "score", "match_type", F.col("rank").cast("int").alias("rank"))
    )
