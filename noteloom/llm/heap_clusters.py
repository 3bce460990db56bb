"""Centroid clustering with heap-ordered bounds: a vector is rescanned only when its gap has expired.

For every vector the distance to its own centroid (upper bound) and to the second nearest one (lower bound)
are known when it is scanned. As long as the centroids have drifted by less than the gap between the two,
the vector cannot change its cluster. Each cluster has an offset, the drift added up since the start, and a
heap of its members ordered by gap plus the offset at the time of their scan. A round pops the members whose
key the offset has reached, compares them with all centroids, and pushes them back; nobody else is touched.

Vectors are dealt once into blocks of a bounded size, in a table bucketed by block. A round's heaps, one for each
block and cluster, are a table with the same buckets, so vectors and heaps meet without a shuffle. What
travels is the change of the sums of each cluster, k times the number of components. Components, sums and
distances are integers, so the result does not depend on the order of work.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import staged
from noteloom.runtime import stage_bucketed

BLOCK = 4096  # vectors in a block
BUCKET_BLOCKS = 64  # blocks in a bucket of a large table
SLACK = 1e-12  # relative, for the rounding of square roots and sums
_STATE = "block long, keys array<double>, slots array<int>, sizes array<int>, delta array<long>, expired long, moved long"


@dataclass(frozen=True)
class Clustering:
    """``assigned`` (vec_id, cluster, distance), the final centroids, and (expired, moved) of every assignment."""

    assigned: DataFrame
    centroids: list[list[int]]
    rounds: list[tuple[int, int]]


def whole_numbers(vector: str | Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component; what lies beyond ``limit`` is set to it."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(float(-limit)))))


def all_finite(vector: str | Column) -> Column:
    """True if the vector is there and every component is a finite number."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _pack(size: int):
    """Rows of a partition as blocks: (block, ids, x), x being the 32-bit components row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                flat = np.asarray(piece.column("x").flatten()).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("vec_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), ids, pa.array([flat.tobytes()], pa.binary())], names=["block", "ids", "x"]
                )
                number += 1

    return run


def _vectors(raw: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to all centroids."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the gap between second nearest and nearest.

    The gap is rounded down by more than floating point can lose.
    """
    d = squared_distances(x, centroids)
    now, row = d.argmin(1), np.arange(len(d))
    upper = np.sqrt(d[row, now].astype(np.float64))
    if len(centroids) == 1:
        return now, np.full(len(d), np.inf)
    d[row, now] = np.iinfo(np.int64).max
    return now, np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) - upper * (1 + SLACK)


def pop_expired(heap: list[tuple[float, int]], offset: float) -> list[int]:
    """Take the members whose key the offset has reached from the top of the heap."""
    out = []
    while heap and heap[0][0] <= offset:
        out.append(heapq.heappop(heap)[1])
    return out


def _advance(centroids: list[list[int]], offsets: list[float], first: bool):
    """One assignment of all blocks: pop, rescan, push; without heaps (``first``) every vector is scanned."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, offset = np.array(centroids, np.int64), np.array(offsets)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _vectors(batch.column("x")[i], dim)
                heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
                delta = np.zeros((k, dim + 1), np.int64)  # components and, last, the number of vectors
                if first:
                    due, was = np.arange(len(x)), np.full(len(x), -1)
                else:
                    keys, slots = batch.column("keys")[i].as_py(), batch.column("slots")[i].as_py()
                    gone, a = [], 0
                    for c, n in enumerate(batch.column("sizes")[i].as_py()):
                        heaps[c] = list(zip(keys[a : a + n], slots[a : a + n]))
                        a += n
                        gone.append(pop_expired(heaps[c], offsets[c]))
                    due = np.array([s for g in gone for s in g], np.int64)
                    was = np.repeat(np.arange(k), [len(g) for g in gone])
                now, gap = scan(x[due], centers) if len(due) else (np.zeros(0, np.int64), np.zeros(0))
                for key, slot, c in zip((gap + offset[now]).tolist(), due.tolist(), now.tolist()):
                    heapq.heappush(heaps[c], (key, slot))
                other = now != was
                changed = np.concatenate([x[due[other]], np.ones((int(other.sum()), 1), np.int64)], 1)
                np.add.at(delta, now[other], changed)
                if not first:
                    np.subtract.at(delta, was[other], changed)
                flat = [entry for heap in heaps for entry in heap]
                row = {
                    "block": batch.column("block")[i].as_py(),
                    "keys": [key for key, _ in flat],
                    "slots": [slot for _, slot in flat],
                    "sizes": [len(heap) for heap in heaps],
                    "delta": delta.ravel().tolist(),
                    "expired": len(due),
                    "moved": int(other.sum()),
                }
                schema = pa.schema(
                    [("block", pa.int64()), ("keys", pa.list_(pa.float64())), ("slots", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))]
                    + [("delta", pa.list_(pa.int64())), ("expired", pa.int64()), ("moved", pa.int64())]
                )
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _members(centroids: list[list[int]]):
    """(vec_id, cluster, distance) of all members of a block's heaps."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = np.array(centroids, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                slots = np.array(batch.column("slots")[i].as_py(), np.int64)
                cluster = np.repeat(np.arange(len(centers)), batch.column("sizes")[i].as_py())
                d = _vectors(batch.column("x")[i], dim)[slots] - centers[cluster]
                ids = batch.column("ids")[i].values.take(pa.array(slots))
                columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def component_limit(dim: int) -> int:
    """Components up to this size have squared distances that fit 63 bits."""
    return min(math.isqrt((1 << 62) // dim) // 2, (1 << 31) - 1)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3", block: int = BLOCK
) -> Clustering:
    """Cluster the rows of ``vectors`` (vec_id, embedding, ...) that have exactly ``dim`` finite components.

    A component x becomes floor(scale * x); sizes beyond :func:`component_limit` (2^27 at 64 components), whose
    squared distances no long can hold, are set to that limit. The first centroids are the ``k`` kept vectors
    with the smallest SHA-256 of ``salt:vec_id`` (null ids last, equal ids by components); with fewer kept
    vectors there are fewer clusters. ``rounds`` times all vectors are assigned and every centroid that has vectors
    moves to the floor of their mean; then they are assigned once more. Rows that repeat are separate
    vectors; a null id stays null. An empty table, or one without a vector to keep, gives an empty result. Other columns are
    ignored. When no centroid moves, the remaining rounds could change nothing and are left out.
    """
    spark = vectors.sparkSession
    limit = component_limit(dim)
    good = (F.size("embedding") == dim) & all_finite("embedding")
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding", scale, limit).alias("x")
    )
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(order.asc_nulls_last(), "x").limit(k).collect()  # k rows
    if not seeds:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    centroids = [list(r["x"]) for r in seeds]
    k = len(centroids)

    n_blocks = 1 + rows.count() // block
    buckets = max(min(n_blocks, spark.sparkContext.defaultParallelism), -(-n_blocks // BUCKET_BLOCKS))
    kind = "block long, ids array<long>, x binary"
    blocks = stage_bucketed(rows.mapInArrow(_pack(block), kind), "block", buckets)
    offsets = [0.0] * k
    sums = [[0] * (dim + 1) for _ in range(k)]
    state, report = None, []
    for turn in range(rounds + 1):
        joined = blocks if state is None else blocks.join(state, "block")
        state = stage_bucketed(joined.mapInArrow(_advance(centroids, offsets, state is None), _STATE), "block", buckets)
        expired, moved = state.agg(F.sum("expired"), F.sum("moved")).first()
        report.append((expired, moved))
        if turn == rounds:
            break
        if moved:
            change = state.where("moved > 0").select(F.posexplode("delta").alias("at", "by"))
            for row in change.groupBy("at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by")).collect():  # k * (dim + 1) rows
                sums[row["at"] // (dim + 1)][row["at"] % (dim + 1)] += int(row["by"])
        before = centroids
        centroids = [[s // total[-1] for s in total[:-1]] if total[-1] else old for total, old in zip(sums, before)]
        drift = [math.dist(a, b) for a, b in zip(before, centroids)]
        if not any(drift):
            break
        for c in range(k):
            others = max((drift[j] for j in range(k) if j != c), default=0.0)
            offsets[c] += (drift[c] + others) * (1 + SLACK)
    assigned = blocks.join(state, "block").mapInArrow(_members(centroids), "vec_id long, cluster int, distance long")
    return Clustering(assigned, centroids, report)


def clusters_with_inertia(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Inertia is the squared distance summed over the cluster and over all; null where a long cannot hold it.
    """
    found = cluster_vectors(vectors, **options)
    assigned = staged(found.assigned)
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    of = {r["cluster"]: int(r["s"]) for r in summed}
    fit = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    by_cluster = lambda items, kind: F.get(F.array(*items).cast(f"array<{kind}>"), F.col("cluster"))
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([fit(of.get(c, 0)) for c in range(len(digests))], "long").alias("cluster_inertia"),
        fit(sum(of.values())).alias("inertia"),
        by_cluster([F.lit(h) for h in digests], "string").alias("centroid_sha256"),
    )
