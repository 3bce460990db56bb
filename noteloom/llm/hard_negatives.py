"""Hard negatives by inner product, found with coordinate pruning in buckets of similar length.

Rows are ordered by label and falling length and cut into buckets. A bucket knows its longest vector and holds, for
each coordinate, the list of its normalised vectors sorted by that coordinate. An anchor looks for the best rows of
one or more ranges of scores. Whole buckets are skipped if their longest vector cannot reach the
lowest score that still counts. In the others that score is a least cosine, and a vector within that angle of the
anchor can differ only so much from it in any coordinate: for the anchor's focus coordinates (its largest) the
feasible values are an interval, cut from the sorted lists and intersected. Only what is in all intervals is verified
by the exact integer inner product. The lowest score rises as rows are found.

Positives are the best rows of the anchor's own label, negatives the best rows of other labels between two shares
of a positive's score. Both are this search, with different ranges. Anchors are a stated part of the rows; their blocks
meet the buckets by broadcast, as many at a time as the byte bound allows, and each pair of blocks returns
a few rows per anchor, ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import BROADCAST_BYTES, staged
from noteloom.llm.heap_clusters import all_finite

BUCKET = 1024  # vectors in a length bucket
ANCHORS = 256  # anchors in a block
FOCUS = 4  # coordinates an anchor is filtered by
LOWEST, HIGHEST = -(1 << 62), 1 << 62
NO_ID = (1 << 63) - 1  # stands for a null id, which comes last
_WIDER = 1e-9  # more than floating point can lose in a cosine
_BUCKET_ROW = "bucket long, dim int, longest double, lo_label long, hi_label long, ids array<long>, labels array<long>, anchor array<boolean>, x binary"
_ANCHOR_ROW = "aid long, anchor_id long, label long, dim int, x binary, low long"
_BLOCK_ROW = (
    "dim int, a_lo long, a_hi long, reach double, aids array<long>, anchor_ids array<long>, a_labels array<long>, a_x binary, "
    "ranges array<array<struct<tag:long,lo:long,hi:long>>>"
)
_FOUND_ROW = "aid long, anchor_id long, tag long, id long, score long"


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat row type that is written as DDL."""
    of = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    of["array<long>"], of["array<boolean>"] = pa.list_(pa.int64()), pa.list_(pa.bool_())
    of["array<array<struct<tag:long,lo:long,hi:long>>>"] = pa.list_(pa.list_(pa.struct([(n, pa.int64()) for n in ("tag", "lo", "hi")])))
    return pa.schema([(name, of[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _runs(size: int, *keys: list) -> Iterator[tuple[int, int]]:
    """Slices of at most ``size`` rows in which the keys do not change."""
    start, n = 0, len(keys[0])
    for i in range(1, n + 1):
        if i == n or i - start == size or any(k[i] != k[start] for k in keys):
            yield start, i
            start = i


def _to_buckets(size: int):
    """Sorted rows of a partition as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            dims, lengths = batch.column("dim").to_pylist(), batch.column("length").to_pylist()
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            anchor, x = batch.column("anchor").to_pylist(), batch.column("x")
            for a, b in _runs(size, dims):
                raw = np.asarray(x.slice(a, b - a).flatten()).astype(np.int32).tobytes()
                row = [number, dims[a], max(lengths[a:b]), min(labels[a:b]), max(labels[a:b]), ids[a:b], labels[a:b], anchor[a:b], raw]
                schema = _arrow(_BUCKET_ROW)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)
                number += 1

    return run


def exact_products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows with a whole-number vector; in doubles only where those are exact."""
    if rows.size == 0:
        return np.zeros(len(rows), np.int64)
    largest = float(np.abs(rows).max()) * float(np.abs(vector).max()) * rows.shape[1]
    if largest < 1 << 53:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ vector.astype(np.int64)


def _own_bucket(k: int):
    """The anchors of each bucket, with the k-th best score inside it as the least score their k best rows can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_ANCHOR_ROW)
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.flatnonzero(np.array(batch.column("anchor")[i].as_py(), bool))
                dim, bucket = batch.column("dim")[i].as_py(), batch.column("bucket")[i].as_py()
                ids, labels = batch.column("ids")[i].as_py(), np.array(batch.column("labels")[i].as_py(), np.int64)
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(len(ids), dim)
                out = []
                for slot in at.tolist():
                    others = np.flatnonzero((labels == labels[slot]) & (np.arange(len(labels)) != slot))
                    scores = exact_products(x[others], x[slot])
                    low = int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else LOWEST
                    out.append(dict(zip(schema.names, [bucket << 16 | slot, ids[slot], int(labels[slot]), dim, x[slot].tobytes(), low])))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _to_blocks(size: int):
    """Anchors (aid, anchor_id, label, dim, x, ranges) as blocks of one length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_BLOCK_ROW)
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["dim"], r["label"], r["aid"]))
            for a, b in _runs(size, [r["dim"] for r in rows]):
                part = rows[a:b]
                x = np.frombuffer(b"".join(r["x"] for r in part), np.int32).reshape(b - a, part[0]["dim"]).astype(np.float64)
                low = np.array([min(s["lo"] for s in r["ranges"]) for r in part], np.float64)
                length = np.sqrt((x * x).sum(1))
                reach = np.where(low > 0, low / np.maximum(length, 1e-300), 0.0).min()
                names = ("aid", "anchor_id", "label")
                lists = [[r[name] for r in part] for name in names]
                raw = b"".join(r["x"] for r in part)
                row = [part[0]["dim"], part[0]["label"], part[-1]["label"], float(reach), *lists, raw, [r["ranges"] for r in part]]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    return run


class _Bucket:
    """A length bucket in a task: exact rows, normalised rows and their sorted coordinate lists."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.number, self.longest = batch.column("bucket")[i].as_py(), batch.column("longest")[i].as_py()
        self.ids = np.array(batch.column("ids")[i].as_py(), np.int64)
        self.labels = np.array(batch.column("labels")[i].as_py(), np.int64)
        self.rows = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(len(self.ids), -1)
        x = self.rows.astype(np.float64)
        self.unit = x / np.sqrt((x * x).sum(1, keepdims=True)).clip(1e-300)
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, 0)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Slots whose focus coordinates allow at least this cosine with ``unit``."""
        beta = math.acos(min(1.0, cosine))
        spans = []
        for f in focus.tolist():
            alpha = math.acos(max(-1.0, min(1.0, unit[f])))
            lo, hi = math.cos(min(math.pi, alpha + beta)) - _WIDER, math.cos(max(0.0, alpha - beta)) + _WIDER
            values = self.lists[:, f]
            spans.append((int(values.searchsorted(lo)), int(values.searchsorted(hi, "right")), f, lo, hi))
        spans.sort(key=lambda s: s[1] - s[0])
        a, b, f, _, _ = spans[0]
        slots = self.order[a:b, f]
        for a, b, f, lo, hi in spans[1:]:
            if b - a == len(self.order):
                break
            values = self.unit[slots, f]
            slots = slots[(values >= lo) & (values <= hi)]
        return slots


class _Anchors:
    """A block of anchors in a task and the best rows found so far in each of their ranges."""

    def __init__(self, batch: pa.RecordBatch, i: int, k: int):
        self.aids, self.anchor_ids = batch.column("aids")[i].as_py(), batch.column("anchor_ids")[i].as_py()
        self.labels = batch.column("a_labels")[i].as_py()
        self.rows = np.frombuffer(batch.column("a_x")[i].as_buffer(), np.int32).reshape(len(self.aids), -1)
        x = self.rows.astype(np.float64)
        self.length = np.sqrt((x * x).sum(1))
        self.unit = x / self.length.clip(1e-300)[:, None]
        n = min(FOCUS, x.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), 1, kind="stable")[:, :n]
        self.ranges = [[(s["tag"], s["lo"], s["hi"]) for s in r] for r in batch.column("ranges")[i].as_py()]
        self.low = np.array([min(lo for _, lo, _ in r) for r in self.ranges], np.int64)
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(r) for r in self.ranges]
        self.k = k

    def reachable(self, longest: float) -> np.ndarray:
        return np.flatnonzero((self.low <= 0) | (self.length * longest * (1 + _WIDER) >= self.low))

    def take(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge verified rows into the ranges of an anchor and raise the least score that still counts."""
        low = HIGHEST
        for j, (_, lo, hi) in enumerate(self.ranges[at]):
            fits = (scores >= lo) & (scores <= hi)
            s, n = self.best[at][j]
            if fits.any():
                s, n = np.concatenate([s, scores[fits]]), np.concatenate([n, ids[fits]])
                order = np.lexsort((n, -s))[: self.k]
                self.best[at][j] = s, n = s[order], n[order]
            low = min(low, int(s[-1]) if len(s) == self.k else lo)
        self.low[at] = max(self.low[at], low)

    def found(self) -> pa.RecordBatch:
        out = []
        for aid, anchor_id, ranges, best in zip(self.aids, self.anchor_ids, self.ranges, self.best):
            for (tag, _, _), (scores, ids) in zip(ranges, best):
                out += [(aid, anchor_id, tag, n, s) for n, s in zip(ids.tolist(), scores.tolist())]
        schema = _arrow(_FOUND_ROW)
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def _search(k: int, same_label: bool):
    """The best rows of every range among the buckets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Anchors] = {}  # at most what was broadcast
        bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                if bucket is None or bucket.number != batch.column("bucket")[i].as_py():
                    bucket = _Bucket(batch, i)
                name = batch.column("aids")[i][0].as_py()
                if name not in blocks:
                    blocks[name] = _Anchors(batch, i, k)
                anchors = blocks[name]
                for at in anchors.reachable(bucket.longest).tolist():
                    low, product = int(anchors.low[at]), anchors.length[at] * bucket.longest
                    if low > 0:
                        slots = bucket.candidates(anchors.unit[at], anchors.focus[at], low / product)
                    else:  # every angle is feasible
                        slots = np.arange(len(bucket.ids))
                    slots = slots[(bucket.labels[slots] == anchors.labels[at]) == same_label]
                    aid = anchors.aids[at]
                    if same_label and aid >> 16 == bucket.number:
                        slots = slots[slots != (aid & 0xFFFF)]
                    scores = exact_products(bucket.rows[slots], anchors.rows[at])
                    near = scores >= low
                    if near.any():
                        anchors.take(at, scores[near], bucket.ids[slots[near]])
        for anchors in blocks.values():
            yield anchors.found()

    return run


def _best_rows(buckets: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(aid, anchor_id, tag, id, score, rank) of the k best rows in each range of ``anchors``.

    ``anchors`` meet the buckets in turns, each with at most BROADCAST_BYTES of them by counted rows.
    """
    n, widest, most = anchors.agg(F.count("*"), F.max(F.length("x")), F.max(F.size("ranges"))).first()
    turns = max(1, -(-n * ((widest or 0) + 48 * (most or 0) + 64) // BROADCAST_BYTES))
    kept = None
    for turn in range(turns):
        some = anchors.where(F.pmod(F.xxhash64("aid"), F.lit(turns)) == turn).drop("low")
        blocks = staged(some.mapInArrow(_to_blocks(ANCHORS), _BLOCK_ROW)).withColumnRenamed("dim", "a_dim")
        meet = (F.col("dim") == F.col("a_dim")) & (F.col("longest") * (1 + _WIDER) >= F.col("reach"))
        if same_label:
            meet &= (F.col("lo_label") <= F.col("a_hi")) & (F.col("a_lo") <= F.col("hi_label"))
        else:
            meet &= ~((F.col("lo_label") == F.col("hi_label")) & (F.col("a_lo") == F.col("a_hi")) & (F.col("lo_label") == F.col("a_lo")))
        pairs = buckets.drop("anchor").join(F.broadcast(blocks), meet)
        found = staged(pairs.mapInArrow(_search(k, same_label), _FOUND_ROW))
        kept = found if kept is None else kept.unionByName(found)
    order = Window.partitionBy("aid", "tag").orderBy(F.col("score").desc(), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    bucket: int = BUCKET,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``vectors``.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on it. A component x becomes floor(scale * x),
    a score is the integer inner product, higher scores come first, ties by smaller vec_id (null last). An anchor's
    positives are its first ``positives`` other rows of the same label. For each of them, the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned.

    Rows with a null label, a null vector, or a null or non-finite component take no part; vectors meet only
    those of their own length, and empty ones meet none. A null ``is_anchor`` is false. Rows that repeat are rows of their own: a copy of an anchor is
    one of its positives and an anchor as well. Whole numbers beyond sqrt(2^55 / components) (92,681 for 64
    components) are set to that limit, so that 100 times a score fits a long. The id 2^63 - 1 is not told from null. An empty table, or one without
    anchors, gives an empty result; other columns are ignored.
    """
    dim = F.size("embedding")
    cap = F.least(F.floor(F.sqrt(F.lit(float(1 << 55)) / dim)), F.lit((1 << 31) - 1)).cast("double")
    rows = vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.where(F.col("label").isNotNull() & all_finite("embedding") & (dim > 0))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, cap), -cap)).cast("int"))
    rows = rows.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("_anchor").alias("anchor"),
        dim.alias("dim"),
        x.alias("x"),
    )
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    rows = rows.withColumn("length", length)
    parts = 1 + rows.count() // (8 * bucket)
    order = ["dim", "label", F.col("length").desc(), "id"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    buckets = staged(ordered.mapInArrow(_to_buckets(bucket), _BUCKET_ROW))
    anchors = staged(buckets.mapInArrow(_own_bucket(positives), _ANCHOR_ROW))

    one = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.col("low").alias("lo"), F.lit(HIGHEST).alias("hi")))
    best = _best_rows(buckets, anchors.withColumn("ranges", one), positives, True)
    best = staged(best.select("aid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))

    floor_100 = lambda c: F.floor(c / F.lit(100).cast("decimal(20,0)")).cast("long")
    p = F.col("positive_score").cast("decimal(20,0)")
    span = F.struct(F.col("positive_score").alias("tag"), (-floor_100(-p * low)).alias("lo"), floor_100(p * high).alias("hi"))
    spans = best.select("aid", span.alias("span")).where("span.lo <= span.hi")
    spans = spans.groupBy("aid").agg(F.array_sort(F.collect_set("span")).alias("ranges"))  # one per positive at most
    found = _best_rows(buckets, staged(anchors.join(spans, "aid")), negatives, False)
    found = found.select("aid", F.col("tag").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    null_id = lambda name: F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
    return best.join(found, ["aid", "positive_score"]).select(
        null_id("anchor_id"), null_id("positive_id"), "rank", null_id("negative_id"), "positive_score", "negative_score"
    )
