"""Greedy budget packing with skip: per request, in order, take what still fits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINKED_BUDGET, LINKED_MAX = 20_000, 5
ATTACH_LIMIT = 100_000


def pack(
    items: DataFrame, request: str, order: list, budget: int, max_items: int | None = None, key: str = "path", tokens: str = "tokens"
) -> DataFrame:
    """Picked rows (request, key, tokens, position). Duplicates of a key count once, at their first place.

    A picked item implies that every earlier item of the same size was picked as well, so of each
    size ``v`` only the first ``budget / v`` (and at most ``max_items``) can matter. That filter is
    a per-(request, size) group limit, applied before anything is gathered: what reaches the
    sequential fold is bounded by the budget alone, however many items a request has.
    """
    first_place = Window.partitionBy(request, key).orderBy(*order)
    unique = items.withColumn("_dup", F.row_number().over(first_place)).where(F.col("_dup") == 1).drop("_dup")
    size = F.col(tokens)
    unique = unique.where(size <= budget)
    cap = min(max_items or budget, budget)
    same_size = Window.partitionBy(request, tokens).orderBy(*order)
    fits = F.floor(F.lit(budget) / F.greatest(size, F.lit(1)))
    able = unique.withColumn("_rn", F.row_number().over(same_size)).where(F.col("_rn") <= cap)
    if max_items is None:
        # Empty items always fit; they bypass the fold.
        free = unique.where(size == 0)
        able = able.where((size > 0) & (F.col("_rn") <= fits))
    else:
        able = able.where((size == 0) | (F.col("_rn") <= fits))
    if max_items is None:
        return _take_in_order(able, request, order, budget, key, tokens).unionByName(
            free.select(request, key, size.cast("long").alias(tokens))
        )
    placed = able.withColumn("_at", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    gathered = placed.groupBy(request).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(key).alias("k"), size.cast("long").alias("t")))).alias("_all")
    )
    entry = "array<struct<k:string,t:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(entry).alias("picked"))

    def step(acc, x):
        ok = (acc["used"] + x["t"] <= budget) & (F.size(acc["picked"]) < max_items) & (acc["used"] < budget)
        taken = F.array_append(acc["picked"], F.struct(x["k"].alias("k"), x["t"].alias("t")))
        return F.struct(
            F.when(ok, acc["used"] + x["t"]).otherwise(acc["used"]).alias("used"),
            F.when(ok, taken).otherwise(acc["picked"]).alias("picked"),
        )

    picked = gathered.select(request, F.explode_outer(F.aggregate("_all", start, step, lambda a: a["picked"])).alias("p")).where(
        F.col("p").isNotNull()
    )
    return picked.select(request, F.col("p.k").alias(key), F.col("p.t").alias(tokens))


def _take_in_order(able: DataFrame, request: str, order: list, budget: int, key: str, tokens: str) -> DataFrame:
    """Stream each request's rows in order and keep what fits; only the running total is held."""
    rows = able.withColumn(tokens, F.col(tokens).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, 0
        for batch in batches:
            keep = []
            for r, t in zip(batch[request], batch[tokens]):
                if r != current:
                    current, used = r, 0
                keep.append(used + t <= budget)
                used += t if keep[-1] else 0
            yield batch.loc[keep, [request, key, tokens]]

    ordered = rows.repartition(request).sortWithinPartitions(request, *order)
    return ordered.mapInPandas(run, rows.select(request, key, tokens).schema)


def omitted_counts(items: DataFrame, picked: DataFrame, request: str, key: str = "path") -> DataFrame:
    """(request, omitted): distinct candidates that were not picked."""
    total = items.groupBy(request, key).agg(F.lit(1).alias("n")).groupBy(request).agg(F.sum("n").alias("total"))
    taken = picked.groupBy(request).agg(F.count("*").alias("taken"))
    return total.join(taken, request, "left").select(request, (F.col("total") - F.coalesce("taken", F.lit(0))).alias("omitted"))
