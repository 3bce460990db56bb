"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

A document is the set of its distinct word shingles; documents whose sets have a Jaccard similarity of
at least the threshold are linked, and links are followed to components.

1. One pass over the texts gives each row a 128-bit digest of its set, a signature of 8-bit minima and
   band keys. Rows with equal sets form a class; everything that follows compares classes, so copies
   are never expanded into pairs.
2. Classes that share a band key are connected to the smallest class of that bucket. The components of
   these candidate edges are the groups inside which comparisons happen. A group is dealt to tasks by
   size: many small groups share a task, a large one is cut into blocks and every pair of blocks
   becomes a task of its own, so no task holds more than two blocks.
3. In a task, pairs that share a band are compared batch by batch of their signatures; after each batch
   a pair whose posterior probability of reaching the threshold is below the chosen miss probability
   is dropped. Survivors are confirmed on their full sets. Pairs already connected by confirmed links
   are skipped, so a task returns a spanning forest of its links and not the links themselves.

Sets are sets of 64-bit hashes of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_rows, mix, pieces_of, small, staged, text_key, word_bounds, word_hashes
from noteloom.llm.graph import components
from noteloom.runtime import lookup_join

BANDS, ROWS = 20, 6
BATCH = 12  # signature positions compared between two looks at the posterior
MISS = 1e-4  # a pair is dropped when it reaches the threshold with less than this probability
BLOCK_SETS, BLOCK_SHINGLES = 2048, 2_000_000
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the n + 1 offsets of the rows in them."""
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = int(at[-1])
    row = np.repeat(np.arange(len(counts)), sizes)
    begin = first[:-1][row] + (np.arange(total) - at[:-1][row])
    stop = first[1:][row]
    out = np.minimum(counts, width)[row].astype(_U)
    padded = np.concatenate([hashes, np.zeros(width, _U)])
    for k in range(width):
        factor = _U(pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64))
        out += np.where(begin + k < stop, padded[begin + k] * factor, _U(0))
    out = mix(out)
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(total, bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, dtype=_U)


def minima(sets: np.ndarray, at: np.ndarray, n_hashes: int) -> np.ndarray:
    """The smallest value of each hash function over each row's set; empty rows get the largest value."""
    out = np.full((len(at) - 1, n_hashes), np.iinfo(_U).max, _U)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        a, b = _multipliers(n_hashes)
        for k in range(n_hashes):
            out[full, k] = np.minimum.reduceat(sets * a[k] + b[k], at[full])
    return out


def set_digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes per row that depend on the set alone."""
    out = np.zeros((len(at) - 1, 2), _U)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[full, k] = np.add.reduceat(mix((sets ^ _U(salt)) * _U(salt)), at[full])
    return out.view(np.uint8).reshape(-1, 16)


def fixed_binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A two-dimensional byte array as a binary column."""
    n, width = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [mask, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 19):
            sets, at = shingle_sets(*byte_rows(part.column("text")), width)
            low = minima(sets, at, bands * rows)
            keys = np.repeat(np.arange(1, bands + 1, dtype=_U)[None, :], len(low), 0)
            for k in range(rows):
                keys = mix(keys * _U(0x9E3779B97F4A7C15) + low[:, k::rows])
            sizes = np.diff(at)
            filled = sizes > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(low) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("tkey"),
                    pa.array(sizes, pa.int64()),
                    fixed_binary(set_digests(sets, at), filled),
                    fixed_binary((low >> _U(40)).astype(np.uint8)),
                    lists,
                ],
                names=["doc_id", "tkey", "n_shingles", "cls", "sig", "bands"],
            )

    return run


def _sets_of_members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 21):
            sets, at = shingle_sets(*byte_rows(part.column("text")), width)
            same = [c == d.tobytes() for c, d in zip(part.column("cls").to_pylist(), set_digests(sets, at))]
            column = pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            keep = [n for n in part.schema.names if n != "text"]
            out = pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [column], names=[*keep, "shingles"])
            yield out.filter(pa.array(same))

    return run


@lru_cache
def least_matches(n_hashes: int, batch: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """For each look: positions seen, and the fewest matches with which a pair stays.

    The posterior of the similarity starts from a uniform prior; two different minima agree in their
    8 bits once in 256, which the likelihood takes into account.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 256
    looks = []
    for seen in [*range(batch, n_hashes, batch), n_hashes]:
        least = seen + 1
        for k in range(seen, -1, -1):
            log = k * np.log(agree) + (seen - k) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= percent / 100].sum() / weight.sum() < miss:
                break
            least = k
        looks.append((seen, least))
    return tuple(looks)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_pairs(
    sig: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, looks
) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among some sets (side 2), or between sides 0 and 1."""
    n = len(sets)
    parent = np.arange(n)
    cross = side[0] != 2 if n else False
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side == 1) if cross else left
    out = []
    step = max(1, 400_000 // max(1, len(right)))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        shared = np.zeros((len(rows), len(right)), bool)
        for k in range(bands.shape[1]):
            shared |= bands[rows, k][:, None] == bands[right, k][None, :]
        i, j = np.nonzero(shared)
        i, j = rows[i], right[j]
        if not cross:
            i, j = i[i < j], j[i < j]
        matches, start = np.zeros(len(i), np.int32), 0
        for seen, least in looks:
            matches += (sig[i, start:seen] == sig[j, start:seen]).sum(1, dtype=np.int32)
            stay = matches >= least
            i, j, matches, start = i[stay], j[stay], matches[stay], seen
        for p in np.argsort(-matches, kind="stable"):
            x, y = int(i[p]), int(j[p])
            rx, ry = _find(parent, x), _find(parent, y)
            if rx == ry:
                continue
            u, v = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
            if 100 * len(u) < percent * len(v):
                continue
            spot = np.searchsorted(v, u)
            both = int((v[np.minimum(spot, len(v) - 1)] == u).sum())
            if 100 * both >= percent * (len(u) + len(v) - both):
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out


def _verify(percent: int, looks):
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        if table.num_rows:
            part = np.asarray(table.column("part"))
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            cls, sig_all = table.column("cls").to_pylist(), table.column("sig").to_pylist()
            sets_all, side_all = table.column("shingles"), np.asarray(table.column("side"))
            bands_all = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(table.num_rows, -1)
            for rows in np.split(order, edges):
                seen: dict = {}
                for r in rows.tolist():  # a class may come twice if ids repeat
                    seen.setdefault((cls[r], side_all[r]), r)
                rows = list(seen.values())
                sig = np.frombuffer(b"".join(sig_all[r] for r in rows), np.uint8).reshape(len(rows), -1)
                sets = [np.frombuffer(sets_all[r].as_py(), _U) for r in rows]
                for x, y in linked_pairs(sig, bands_all[rows], sets, side_all[rows], percent, looks):
                    a.append(cls[rows[x]])
                    b.append(cls[rows[y]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def minhash_components(
    docs: DataFrame,
    percent: int = 85,
    width: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    A null, empty or white text has the empty set (0 shingles) and links with nothing. Rows with the
    same id stay separate rows; their component is that of their own text, and ``tkey`` (a hash of the
    text) tells them apart. Null ids take part, but never name a component that has another id. An
    empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select("doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id {}, tkey long, n_shingles long, cls binary, sig binary, bands array<long>"
    schema = schema.format(docs.schema["doc_id"].dataType.simpleString())
    signed = staged(slim.mapInArrow(_signatures(width, bands, rows), schema))

    some = F.first
    classes = staged(
        signed.where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("lead"),
            *[some(c).alias(c) for c in ("n_shingles", "sig", "bands")],
        )
        .select("cls", "lead.doc_id", "lead.tkey", "n_shingles", "sig", "bands")
    )
    entries = classes.select("cls", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("cls").alias("lead"), F.max("cls").alias("top"))
    buckets = staged(buckets.where(F.col("lead") < F.col("top")).select("band", "lead"))
    candidates = entries.join(buckets, "band").where(F.col("cls") != F.col("lead"))
    groups = components(candidates.select(F.col("lead").alias("a"), F.col("cls").alias("b")))

    members = staged(groups.withColumnRenamed("node", "cls").join(classes, "cls"))
    sizes = members.groupBy("root").agg(F.count("*").alias("n_sets"), F.sum("n_shingles").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n_sets") / block_sets), F.ceil(F.col("weight") / block_shingles), F.lit(1))
    sizes = staged(sizes.select("root", "n_sets", "weight", blocks.cast("int").alias("blocks")))
    weight = sizes.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    shared_tasks = 1 + int(weight * 2 // block_shingles)

    # a root may stand for very many members: such roots are joined by broadcast
    dealt = lookup_join(members, sizes.select("root", "blocks", "n_sets"), ["root"], weight="n_sets", dim_rows=sizes.count())
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    own = F.xxhash64("root", lo, hi)
    dealt = dealt.select(
        F.col("doc_id").alias("member_id"),
        F.col("tkey").alias("member_key"),
        "cls",
        "sig",
        "bands",
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        own.alias("part"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shared_tasks))).otherwise(own).alias("task"),
    )
    dealt = small(staged(dealt), 72 + bands * (rows + 8))
    # one text of each member: rows that share its id, or have none, are told apart by their text
    texts = docs.select("doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(dealt, texts["doc_id"].eqNullSafe(dealt["member_id"]) & (texts["tkey"] == dealt["member_key"])).select(
        "text", "cls", "sig", "bands", "side", "part", "task"
    )
    kinds = "cls binary, sig binary, bands array<long>, side int, part long, task long, shingles binary"
    with_sets = texts.mapInArrow(_sets_of_members(width), kinds)
    looks = least_matches(bands * rows, BATCH, percent, miss)
    links = with_sets.groupBy("task").applyInArrow(_verify(percent, looks), "a binary, b binary")
    linked = components(links)

    named = classes.select("cls", "doc_id").join(linked.withColumnRenamed("node", "cls"), "cls")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n"))
    lowest = lookup_join(linked, lowest, ["root"], weight="n").select(F.col("node").alias("cls"), "lowest")
    names = classes.select("cls", "doc_id").join(lowest, "cls", "left")
    names = staged(names.select("cls", F.coalesce("lowest", "doc_id").alias("component_id")))
    rows_out = signed.select("doc_id", "tkey", "n_shingles", "cls").join(names, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows_out.select(
        "doc_id", "tkey", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays, columns unchanged.

    Documents are near from a similarity of ``percent``; bands and rows must suit it. Rows that repeat both id and text
    count as copies of each other; one of them stays. A null, empty or white text is near to none: its rows stay, but for
    repeated ones. An empty table gives an empty result; columns of any name keep their values.
    """
    found = staged(minhash_components(docs, percent, bands=bands, rows=rows).select("doc_id", "tkey", "kept"))
    gone = small(staged(found.where("not kept").distinct()), 24)
    again = found.where("kept").groupBy("doc_id", "tkey").count().where("count > 1").drop("count")
    again = small(staged(again), 24)
    keyed = docs.select("doc_id", text_key().alias("tkey"), F.struct(*docs.columns).alias("row"))  # names of docs stay inside

    def match(other):
        return keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed["tkey"] == other["tkey"])

    left = keyed.join(gone, match(gone), "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, match(again), "left_anti")
    twice = left.join(again, match(again), "left_semi").dropDuplicates(["doc_id", "tkey"])
    return once.unionByName(twice).select("row.*")
