"""Line diffs between two versions of a note, edit hunks, and their application."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.functions.text import replace_first

MERGE_GAP = 6
CONTEXT = 3
MANY_PLACES = 16
# Lines and characters of diffs that leave the worker together.
SEND_LINES = 10_000
SEND_CHARS = 4 << 20


def _masks(new: list[str]) -> Callable[[str], int]:
    """Function from a line to the bits of its places in ``new``.

    Bits of lines that stand at many places are kept; there are few of those. Others are set anew for each use, so that
    a text of all different lines does not hold a bit row for each.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(new):
        places.setdefault(line, []).append(j)
    width = len(new) // 8 + 1
    kept: dict[str, int] = {}

    def mask(line: str) -> int:
        if line in kept:
            return kept[line]
        bits = bytearray(width)
        for j in places.get(line, ()):
            bits[j >> 3] |= 1 << (j & 7)
        value = int.from_bytes(bits, "little")
        if len(places.get(line, ())) > MANY_PLACES:
            kept[line] = value
        return value

    return lambda line: mask(line) if line in places else 0


def _line_ops(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Longest-common-subsequence diff; among equal choices an addition is written last.

    A row of the table of lengths is one whole number: a bit of 0 says that the length grows by one at that new line, so a row
    follows from the one before by an addition and two logical operations over all new lines at once. Only every
    step-th row is kept; the rows between two of them are computed again while walking back, so memory
    grows with the root of the number of old lines.
    """
    # Equal last lines are always kept, so only what precedes them needs the table.
    tail = 0
    while tail < min(len(old), len(new)) and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    kept = [("same", line) for line in old[len(old) - tail :]]
    old, new = old[: len(old) - tail], new[: len(new) - tail]
    if not old or not new:
        return [("remove", line) for line in old] + [("add", line) for line in new] + kept
    mask = _masks(new)
    every = (1 << len(new)) - 1

    def following(row: int, line: str) -> int:
        met = row & mask(line)
        return ((row + met) | (row - met)) & every if met else row

    step = math.isqrt(len(old)) + 1
    row = every
    saved = [row]
    for i, line in enumerate(old, start=1):
        row = following(row, line)
        if i % step == 0:
            saved.append(row)
    ops, i, j, at, block = [], len(old), len(new), -1, []
    while i and j:
        if (i - 1) // step != at:
            at = (i - 1) // step
            block = [saved[at]]
            for line in old[at * step : (at + 1) * step]:
                block.append(following(block[-1], line))
        if old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("same", old[i]))
        elif block[i - at * step] >> (j - 1) & 1:  # as long without this new line
            j -= 1
            ops.append(("add", new[j]))
        else:
            i -= 1
            ops.append(("remove", old[i]))
    ops += [("add", line) for line in reversed(new[:j])] + [("remove", line) for line in reversed(old[:i])]
    return ops[::-1] + kept


def _sent_diffs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Diffs (key, seq, op, line) of batches (key, old_text, new_text), in batches of bounded size."""
    for batch in batches:
        names = batch.column(key)
        at, seqs, ops, lines, chars = [], [], [], [], 0

        def sent():
            columns = [names.take(pa.array(at, pa.int32())), pa.array(seqs, pa.int32()), pa.array(ops, pa.string()), pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [key, "seq", "op", "line"])

        for i, (old, new) in enumerate(zip(batch.column("old_text"), batch.column("new_text"))):
            for seq, (op, line) in enumerate(_line_ops(old.as_py().split("\n"), new.as_py().split("\n"))):
                at.append(i), seqs.append(seq), ops.append(op), lines.append(line)
                chars += len(line)
                if len(at) >= SEND_LINES or chars >= SEND_CHARS:
                    yield sent()
                    at, seqs, ops, lines, chars = [], [], [], [], 0
        if at:
            yield sent()


def diff_lines(pairs: DataFrame, key: str = "path") -> DataFrame:
    """(key, seq, op, line) for version pairs (key, old_text, new_text); op is same, add or remove.

    Equal pairs are handled with built-ins; only true diffs reach Python. There is no limit of lines. A worker holds one
    pair's diff and what it sends next, whatever the number of pairs.
    """
    equal = F.col("old_text") == F.col("new_text")
    whole = pairs.where(equal).select(
        key, F.lit("same").alias("op"), F.posexplode_outer(F.split("new_text", "\n", -1)).alias("seq", "line")
    )
    schema = T.StructType(
        [
            pairs.schema[key],
            T.StructField("seq", T.IntegerType()),
            T.StructField("op", T.StringType()),
            T.StructField("line", T.StringType()),
        ]
    )

    changed = pairs.where(~equal).select(key, "old_text", "new_text").mapInArrow(lambda batches: _sent_diffs(batches, key), schema)
    return whole.select(key, "seq", "op", "line").unionByName(changed)


def diff_hunks(diff: DataFrame, key: str = "path") -> DataFrame:
    """(key, hunk_no, first_seq, last_seq, old_text, new_text) of a diff.

    Changes at most 6 apart share a hunk; each hunk takes up to 3 lines of context on both sides.
    The windows run per version pair, whose size is the document's own.
    """
    by_pair = Window.partitionBy(key)
    changes = diff.where(F.col("op") != "same").withColumn("_prev", F.lag("seq").over(by_pair.orderBy("seq")))
    starts = F.when(F.col("_prev").isNull() | (F.col("seq") - F.col("_prev") > MERGE_GAP), 1).otherwise(0)
    numbered = changes.withColumn("hunk_no", F.sum(starts).over(by_pair.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    spans = numbered.groupBy(key, "hunk_no").agg(
        F.greatest(F.min("seq") - CONTEXT, F.lit(0)).alias("first_seq"), (F.max("seq") + CONTEXT).alias("last_seq")
    )
    # Each hunk names the diff lines it covers: an equi-join on (pair, line), no range join.
    covered = spans.select(key, "hunk_no", "first_seq", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    lines = covered.join(diff, [key, "seq"])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "op", "line")))
    text = lambda skip: F.array_join(F.transform(F.filter("ls", lambda l: l["op"] != skip), lambda l: l["line"]), "\n")
    return (
        lines.groupBy(key, "hunk_no")
        .agg(ordered.alias("ls"))
        .select(
            key,
            F.col("hunk_no").cast("int").alias("hunk_no"),
            F.array_min(F.transform("ls", lambda l: l["seq"])).alias("first_seq"),
            F.array_max(F.transform("ls", lambda l: l["seq"])).alias("last_seq"),
            text("add").alias("old_text"),
            text("remove").alias("new_text"),
            F.col("ls").alias("lines"),
        )
    )


def apply_hunks(notes: DataFrame, hunks: DataFrame, revert: bool = False) -> DataFrame:
    """(hunk columns, content, status): each hunk applied on its own to its note.

    The first occurrence of the old text is replaced literally; status is 'applied', 'reverted' or
    'not_found'. ``revert`` swaps old and new.
    """
    old, new = ("new_text", "old_text") if revert else ("old_text", "new_text")
    joined = hunks.join(notes.select("path", F.col("content").alias("_before")), "path")
    after = replace_first(F.col("_before"), F.col(old), F.col(new))
    changed = joined.withColumn("content", after)
    done = F.lit("reverted" if revert else "applied")
    return changed.withColumn("status", F.when(F.col("content") != F.col("_before"), done).otherwise("not_found")).drop("_before")
