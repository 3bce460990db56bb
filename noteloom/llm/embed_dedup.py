"""Near-duplicate vectors by sorted projection passes and bounded neighbour windows.

Each pass draws random hyperplanes and orders the vectors of a label lexicographically by their concatenated signs. Vectors
that share the leading signs of a pass form a run; a window over the order compares each vector with the next
WINDOW ones. Two vectors share a sign with a probability that depends on their angle alone, so a pair at the
threshold shares the first d signs with a known chance; if its run is no longer than the window, the window sees it. How many
leading signs a label needs for that, and with it the number of passes, follows from runs that are counted over all vectors on
trial projections. Runs that stay longer than the window (a dense cluster) are compared in full, in pairs of blocks:
no pair is lost by the shape of the data. A label that fits one window has runs of its own length and needs one pass.

Passes move a number, the signs and a short signature of each vector, never the vector. Pairs of a window whose signatures are
too different for the threshold are dropped (SIGNATURE signs; a pair at the threshold passes with probability
above 1 - 10^-5), the rest is united across passes and verified exactly. Links found connect the components; afterwards
the links of each vector are counted against its whole component, in blocks. Equal vectors are one class before the first pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import small, staged
from noteloom.llm.graph import components
from noteloom.runtime import lookup_join

WINDOW = 48  # neighbours in a pass's order that a vector is compared with
MISS = 0.0005  # chance that a pair exactly at the threshold is in no window
DEEPEST = 24  # signs of a pass
DEPTHS = range(0, DEEPEST + 1, 2)  # leading signs that are tried
SIGNATURE = 128  # signs of the signature
SHIPPING = 2048  # moving a vector counts as so many comparisons
TRIALS = 2
BLOCK = 2048
_ENTRY = "nid long, grp long, pass int, key int, run long, s0 long, s1 long"
_FOUND = "kind int, a long, b long, part int, at long, grp long, pass int, run long, s0 long, s1 long, long boolean"
_PAIR, _RIM, _COUNT = 0, 1, 2


def passes_at(depth: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at ``threshold`` has shared no run of ``depth`` signs with probability ``miss`` at most.

    Two vectors share one sign with probability 1 - angle / pi.
    """
    found = (1 - math.acos(threshold) / math.pi) ** depth
    return 1 if depth == 0 else max(2, math.ceil(math.log(miss) / math.log1p(-found)))


def most_differences(threshold: float, bits: int = SIGNATURE) -> int:
    """Signs in which the signatures of a pair at the threshold differ at most, but for a chance below 10^-5."""
    p = math.acos(min(1.0, threshold)) / math.pi
    total, chance = 0.0, (1 - p) ** bits
    for k in range(bits):
        total += chance
        if total >= 1 - 1e-5:
            return k
        chance *= (bits - k) / (k + 1) * p / max(1 - p, 1e-300)
    return bits


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of norm 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    rows = rows / np.abs(rows).max(1, initial=0, keepdims=True).clip(1e-300)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True)).clip(1e-300)


def _signs(unit: np.ndarray, stream: int, seed: int, bits: int) -> np.ndarray:
    """The first ``bits`` signs of a stream of random hyperplanes, as 0 and 1."""
    planes = np.random.default_rng([seed, unit.shape[1], stream]).standard_normal((unit.shape[1], bits))
    return (unit @ planes > 0).astype(np.int64)


def _numbers(signs: np.ndarray) -> np.ndarray:
    return signs @ (np.int64(1) << np.arange(signs.shape[1] - 1, -1, -1, dtype=np.int64))


def _same_length(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    for batch in batches:
        kinds = np.stack([np.asarray(batch.column(n)) for n in names], 1) if batch.num_rows else np.zeros((0, 1))
        for kind in np.unique(kinds, axis=0):
            yield tuple(int(k) for k in kind), batch.filter(pa.array((kinds == kind).all(1)))


def _trial_keys(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _same_length(batches, "dim"):
            unit = unit_rows(part.column("vector"))
            for trial in range(TRIALS):
                key = _numbers(_signs(unit, 1000 + trial, seed, DEEPEST)).astype(np.int32)
                columns = [part.column("grp"), pa.array(np.full(len(key), trial, np.int32)), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "trial", "key"])

    return run


def _planned(classes: DataFrame, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """(grp, depth, passes) of every group of one label and one length of vector.

    The work of a depth is its passes times what they compare, as counted over all vectors: a window for each vector
    of a short run; all pairs, and the moving of the vectors, in longer ones.
    """
    tried = classes.select("grp", "dim", "vector").mapInArrow(_trial_keys(seed), "grp long, trial int, key int")
    tried = tried.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in DEPTHS])))
    prefix = F.expr(f"shiftright(key, {DEEPEST} - depth)")
    counts = tried.groupBy("grp", "trial", "depth", prefix.alias("prefix")).agg(F.count("*").cast("double").alias("c"))
    compared = F.when(F.col("c") <= window, F.col("c") * window).otherwise(F.col("c") * F.col("c") + F.col("c") * SHIPPING)
    of = {d: passes_at(d, threshold, miss) for d in DEPTHS}
    passes = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("depth"))
    work = counts.groupBy("grp", "depth").agg((F.sum(compared) * passes).alias("work"))
    best = work.groupBy("grp").agg(F.min_by("depth", F.struct("work", "depth")).alias("depth"))
    return staged(best.select("grp", "depth", passes.alias("passes")))


def _entries(seed: int):
    """A row for each vector and pass: its signs, the run of its leading ones, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, depth, passes), part in _same_length(batches, "dim", "depth", "passes"):
            unit = unit_rows(part.column("vector"))
            half = SIGNATURE // 2
            bits = _signs(unit, 2000, seed, SIGNATURE)
            s0, s1 = (pa.array(_numbers(b)) for b in (bits[:, :half], bits[:, half:]))
            for turn in range(passes):
                key = _numbers(_signs(unit, turn, seed, DEEPEST))
                start = pa.array(key >> (DEEPEST - depth))
                columns = [part.column("nid"), part.column("grp"), pa.array(np.full(len(key), turn, np.int32)), pa.array(key.astype(np.int32)), start, s0, s1]
                yield pa.RecordBatch.from_arrays(columns, names=["nid", "grp", "pass", "key", "run", "s0", "s1"])

    return run


def window_pairs(rows: dict[str, np.ndarray], window: int, most: int, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows at most ``window`` apart in one pass and group whose signatures may belong to a pair.

    The first ``old`` rows have met each other already. Pairs inside a long run are left to the full comparison.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(rows["nid"])
    for step in range(1, min(window, n - 1) + 1):
        i = np.arange(max(0, old - step), n - step)
        j = i + step
        same = (rows["grp"][i] == rows["grp"][j]) & (rows["pass"][i] == rows["pass"][j])
        i, j = i[same], j[same]
        i, j = (x[~(rows["long"][i] & (rows["run"][i] == rows["run"][j]))] for x in (i, j))
        apart = sum(np.bitwise_count((rows[s][i] ^ rows[s][j]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
        a.append(i[apart <= most])
        b.append(j[apart <= most])
    return np.concatenate(a), np.concatenate(b)


_FIELDS = {"nid": "a", "grp": "grp", "pass": "pass", "run": "run", "s0": "s0", "s1": "s1", "long": "long"}


def _found(kind: int, n: int, part: int, **columns: np.ndarray) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "part": pa.int32(), "pass": pa.int32(), "long": pa.bool_()}
    names = [c.split(" ")[0] for c in _FOUND.split(", ")]
    given = {"kind": np.full(n, kind), "part": np.full(n, part)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given.get(c, np.zeros(n, np.int64)), types.get(c, pa.int64()), safe=False) if c != "long" else pa.array(given.get(c, np.zeros(n, bool))) for c in names], names=names)


def _windows(window: int, most: int):
    """Over the sorted rows of a partition: pairs of its windows, its first and last rows, and its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), None, 0
        tail: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = {name: np.asarray(batch.column(name)) for name in _FIELDS}
            if not batch.num_rows:
                continue
            if n < window:
                m = min(window - n, batch.num_rows)
                yield _found(_RIM, m, part, at=np.arange(n, n + m), **{_FIELDS[f]: v[:m] for f, v in rows.items()})
            old = 0 if held is None else len(held["nid"])
            both = rows if held is None else {f: np.concatenate([held[f], v]) for f, v in rows.items()}
            i, j = window_pairs(both, window, most, old)
            yield _found(_PAIR, len(i), part, a=np.minimum(both["nid"][i], both["nid"][j]), b=np.maximum(both["nid"][i], both["nid"][j]))
            n += batch.num_rows
            held = tail = {f: v[-window:] for f, v in both.items()}
        if n > window:  # otherwise all rows are first rows
            m = min(window, n - window)
            yield _found(_RIM, m, part, at=np.arange(n - m, n), **{_FIELDS[f]: v[-m:] for f, v in tail.items()})
        if n:
            yield _found(_COUNT, 1, part, at=np.array([n]))

    return run


def _across(window: int, most: int):
    """Pairs of the rows around one border between partitions, dealt with their places in the whole order."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("place")))
        rows = {f: np.asarray(table.column(c).combine_chunks())[order] for f, c in _FIELDS.items()}
        i, j = window_pairs(rows, window, most)
        a, b = rows["nid"][i], rows["nid"][j]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _window_candidates(entries: DataFrame, n: int, window: int, most: int) -> DataFrame:
    """(a, b): distinct pairs that are neighbours in some pass among ``n`` entries; the order goes through all partitions."""
    parts = 1 + n // 200_000
    order = ["grp", "pass", "key", "nid"]
    ordered = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = staged(ordered.mapInArrow(_windows(window, most), _FOUND))
    sizes = {r["part"]: r["at"] for r in found.where(F.col("kind") == _COUNT).select("part", "at").collect()}  # one row a partition
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    pairs = found.where(F.col("kind") == _PAIR).select("a", "b")
    borders = sorted(first.values())[1:]
    if borders:
        literal = F.array(*[F.lit(x).cast("long") for x in borders])
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("part")).cast("long")
        rims = found.where(F.col("kind") == _RIM).withColumn("place", offset + F.col("at"))
        near = F.filter(literal, lambda x: (x - F.col("place") <= window) & (F.col("place") - x < window))
        dealt = rims.withColumn("border", F.explode(near)).drop("kind", "b", "part", "at")
        pairs = pairs.unionByName(dealt.groupBy("border").applyInArrow(_across(window, most), "a long, b long"))
    return pairs.distinct()


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose vectors reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), part in _same_length(batches, "dim"):
            cosine = (unit_rows(part.column("v")) * unit_rows(part.column("w"))).sum(1)
            yield part.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    one = classes.select(F.col("nid").alias("a"), F.col("vector").alias("v"))
    two = classes.select(F.col("nid").alias("b"), F.col("vector").alias("w"), "dim")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "v", "w", "dim").mapInArrow(run, "a long, b long")


def _forest(close: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links of a square matrix, or of those between rows and columns if ``cross``.

    Columns are numbered after the rows.
    """
    n, out = len(close), []
    if not cross:
        np.fill_diagonal(close, False)
    back = close.T if cross else close
    fresh = [np.ones(n, bool), np.ones(close.shape[1], bool)] if cross else [np.ones(n, bool)] * 2
    for first in np.flatnonzero(close.any(1)).tolist():
        if not fresh[0][first]:
            continue
        fresh[0][first] = False
        todo = [(first, 0)]
        while todo:
            x, side = todo.pop()
            links, other = (close, 1) if side == 0 else (back, 0)
            near = np.flatnonzero(links[x] & fresh[other])
            fresh[other][near] = False
            for y in near.tolist():
                out.append((x + n * side, y + n * other) if cross else (x, y))
                todo.append((y, other if cross else 0))
    return out


def _link(threshold: float):
    """For one task: a spanning forest of the links inside a block or between two blocks of a run."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        part = np.asarray(table.column("part"))
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(rows) < 2:
                continue
            piece = table.take(pa.array(rows))
            unit = unit_rows(piece.column("vector"))
            side = np.asarray(piece.column("side"))
            cross = bool(side[0] != 2)
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else [np.arange(len(side))] * 2
            close = np.zeros((len(left), len(right)), bool)
            for k in range(0, len(left), 256):
                close[k : k + 256] = unit[left[k : k + 256]] @ unit[right].T >= threshold
            at = np.concatenate([left, right])
            names = np.asarray(piece.column("nid"))
            for x, y in _forest(close, cross):
                a.append(int(names[at[x]]))
                b.append(int(names[at[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _run_links(crowded: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): links that connect what is connected inside long runs, which are compared in full, in pairs of blocks."""
    members = staged(crowded.select("nid", F.xxhash64("grp", "pass", "run").alias("leaf")))
    sizes = members.groupBy("leaf").agg(F.count("*").alias("n"))
    sizes = staged(sizes.select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    tasks = 1 + members.count() * 2 // block
    large = small(staged(sizes.where("blocks > 1")), 16)
    dealt = members.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("nid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.xxhash64("leaf", F.least("at", "other"), F.greatest("at", "other"))
    dealt = dealt.select(
        "nid",
        F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1).alias("side"),
        own.alias("part"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("leaf"), F.lit(tasks))).otherwise(own).alias("task"),
    )
    dealt = dealt.join(classes.select("nid", "vector"), "nid")
    return dealt.groupBy("task").applyInArrow(_link(threshold), "a long, b long")


def _near_links(classes: DataFrame, threshold: float, window: int, miss: float, block: int, seed: int) -> DataFrame:
    """(a, b): links that connect all classes that some pass brings together and that reach the threshold."""
    plan = _planned(classes, threshold, window, miss, seed)
    planned = classes.select("nid", "grp", "dim", "vector").join(small(plan, 32), "grp")
    entries = staged(planned.mapInArrow(_entries(seed), _ENTRY))
    runs = entries.groupBy("grp", "pass", "run").agg(F.count("*").alias("n")).where(F.col("n") > window)
    runs = small(staged(runs.select("grp", "pass", "run", F.lit(True).alias("long"))), 32)
    marked = entries.join(runs, ["grp", "pass", "run"], "left").withColumn("long", F.coalesce("long", F.lit(False)))
    candidates = _window_candidates(marked, entries.count(), window, most_differences(threshold))
    crowded = entries.join(runs, ["grp", "pass", "run"])
    return staged(_verified(candidates, classes, threshold).unionByName(_run_links(crowded, classes, threshold, block)))


def _count_links(threshold: float):
    """For one task: how many rows each class is linked with, inside a block or between two blocks."""

    def run(table: pa.Table) -> pa.Table:
        nid, links = [], []
        part = np.asarray(table.column("part"))
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            piece = table.take(pa.array(rows))
            unit = unit_rows(piece.column("vector"))
            side, copies = np.asarray(piece.column("side")), np.asarray(piece.column("copies"))
            names = piece.column("nid").to_pylist()
            cross = side[0] != 2
            left = np.flatnonzero(side == 0) if cross else np.arange(len(side))
            right = np.flatnonzero(side == 1) if cross else left
            seen = np.zeros(len(side), np.int64)
            for a in range(0, len(left), 256):
                i = left[a : a + 256]
                close = unit[i] @ unit[right].T >= threshold
                if not cross:
                    close[np.arange(len(i)), i] = False
                seen[i] += close @ copies[right]
                if cross:
                    seen[right] += close.T @ copies[i]
            nid += names
            links += seen.tolist()
        return pa.table({"nid": pa.array(nid, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def is_vector(v: str | Column) -> Column:
    """True if every component is a finite number and one of them is not zero."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label, ...).

    Only vectors with equal, non-null labels and equal length are compared. A vector that is null, zero or
    empty or has null or non-finite components links with nothing (0 links, its own component). Equal
    rows count as links of each other. Null ids take part, but name no component that has another id.
    An empty table gives an empty result; other columns are ignored.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), vector.alias("vector"))
    good = F.col("label").isNotNull() & is_vector("vector")
    cid = F.format_string("%016x%016x", F.xxhash64("label", "vector"), F.xxhash64(F.lit("second"), "vector", "label"))
    rows = staged(rows.withColumn("cid", F.when(good, cid)))
    classes = staged(
        rows.where(F.col("cid").isNotNull())
        .groupBy("cid")
        .agg(
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
            F.min("vec_id").alias("first_id"),
            F.count("*").alias("copies"),
        )
        .withColumn("dim", F.size("vector"))
        .withColumn("grp", F.xxhash64("label", "dim"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    linked = components(_near_links(classes, threshold, window, miss, block, seed))

    members = linked.withColumnRenamed("node", "nid").join(classes, "nid")
    members = staged(members.select("nid", "cid", "root", "vector", "copies", "first_id"))
    sizes = members.groupBy("root").agg(F.count("*").alias("n_sets"), F.min("first_id").alias("lowest"))
    sizes = staged(sizes.withColumn("blocks", F.ceil(F.col("n_sets") / block).cast("int")))
    small_sets = sizes.where("blocks = 1").agg(F.sum("n_sets")).first()[0] or 0
    tasks = 1 + int(small_sets * 2 // block)
    # a root may stand for very many members: such roots are joined by broadcast
    n_roots = sizes.count()
    dealt = lookup_join(members, sizes, ["root"], weight="n_sets", dim_rows=n_roots).withColumn("at", F.pmod(F.xxhash64("nid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.xxhash64("root", F.least("at", "other"), F.greatest("at", "other"))
    dealt = dealt.select(
        "nid",
        "vector",
        "copies",
        F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1).alias("side"),
        own.alias("part"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(own).alias("task"),
    )
    links = dealt.groupBy("task").applyInArrow(_count_links(threshold), "nid long, links long")
    links = links.groupBy("nid").agg(F.sum("links").alias("links"))
    named = lookup_join(members.select("cid", "nid", "root"), sizes.select("root", "lowest", "n_sets"), ["root"], weight="n_sets", dim_rows=n_roots)
    result = named.join(links, "nid", "left")
    result = classes.select("cid", "copies", "first_id").join(result, "cid", "left")
    result = staged(
        result.select(
            "cid",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("lowest", "first_id").alias("component_id"),
        )
    )
    out = rows.select("vec_id", "cid").join(result, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
