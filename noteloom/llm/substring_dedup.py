"""Repeated passages: lines, sentences and paragraphs, found by global digests and removed but for the first.

A text is cut in four ways: into lines; into the sentences of its lines; into paragraphs (between blank lines); and into
sentences that may go over line ends. A unit is a piece of at least MIN_WORDS words; a shorter piece is joined by the
pieces that follow it until the words are enough, so that a passage in short lines is found by its runs
of lines, and a short piece on its own, which repeats by chance, is left alone. Units are normalised (ASCII letters small, white space
collapsed), so a unit is the sequence of its words, and hashed to 128 bits. Digests are grouped over the whole corpus with a
combined minimum of the rank (document id, offset) before the shuffle; every other occurrence is removed.

Sentences end at ``.`` ``!`` ``?``, with up to two closing quotes or brackets, before white space. Full stops of
scripts without white space end none: their words are runs without white space, too.

Only digests and offsets are shuffled. Offsets are code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import _powers, byte_rows, mix, pieces_of, small, staged, text_key, word_bounds, word_hashes

MIN_WORDS = 8


LINES, LINE_SENTENCES, PARAGRAPHS, SENTENCES = LEVELS = range(4)


def unit_bounds(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """Byte positions at which a piece begins, and the end; ``starts`` are those of the words."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    newline = np.flatnonzero(data == 10)
    if level in (LINES, LINE_SENTENCES):
        cut[newline + 1] = True
    elif len(newline) > 1:  # a blank line has no word between its ends
        seen = np.searchsorted(starts, newline)
        cut[newline[1:][seen[1:] == seen[:-1]] + 1] = True
    if level in (LINE_SENTENCES, SENTENCES):
        white = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
        before = white - 1
        for _ in range(2):  # closing quotes and brackets
            there = before >= 0
            before = before - (there & np.isin(data[np.maximum(before, 0)], (34, 39, 41, 93)))
        stop = (before >= 0) & np.isin(data[np.maximum(before, 0)], (33, 46, 63))
        cut[white[stop] + 1] = True
    cut[0] = cut[-1] = True
    return np.flatnonzero(cut)


def units(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Row, start and end in bytes, and two digests of every unit of at least ``min_words`` words."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, of_row = word_bounds(low, offsets)
    hashes = word_hashes(low, starts, ends)
    last = of_row[np.searchsorted(offsets, starts, side="right")] if len(starts) else np.zeros(0, np.int64)  # end of the word's row
    found = []
    for level in LEVELS:
        edges = np.unique(np.searchsorted(starts, unit_bounds(data, offsets, starts, level)))  # in words
        a = edges[edges < len(starts)]
        at = np.searchsorted(edges, a + min_words)
        b = edges[np.minimum(at, len(edges) - 1)]
        whole = (at < len(edges)) & (b <= last[a])
        found.append((a[whole], b[whole]))
    a, b = (np.concatenate(c) for c in zip(*found))
    _, once = np.unique(a * (len(starts) + 1) + b, return_index=True)  # a line of one sentence is one unit
    a, b = a[once], b[once]
    start, end = starts[a], ends[b - 1]
    powers, back = _powers(len(hashes))
    digests = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)) * powers[: len(hashes)], out=total[1:])
        digests.append(mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64))
    return np.searchsorted(offsets, start, side="right") - 1, start, end, *digests


def _unit_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "text", 1 << 20):
            data, offsets = byte_rows(part.column("text"))
            row, start, end, h1, h2 = units(data, offsets, min_words)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[offsets[row]]
            pick = pa.array(row)
            columns = [part.column("doc_id").take(pick), part.column("tkey").take(pick)]
            columns += [pa.array((points[x] - base).astype(np.int32)) for x in (start, end)] + [pa.array(h1), pa.array(h2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "start", "end", "h1", "h2"])

    return run


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tkey, start, end) of every unit of ``docs`` that has an earlier occurrence.

    Occurrences are ranked by document id (null last), text hash and offset. Rows that repeat both id and
    text are one occurrence.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    found = slim.mapInArrow(_unit_rows(min_words), f"doc_id {kind}, tkey long, start int, end int, h1 long, h2 long")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "tkey", "start")
    groups = found.groupBy("h1", "h2").agg(F.min(rank).alias("lead"), F.max(rank).alias("last"))
    groups = staged(groups.where(F.col("lead") < F.col("last")).select("h1", "h2", "lead"))
    again = found.join(groups, ["h1", "h2"]).where(rank > F.col("lead"))
    return again.select("doc_id", "tkey", "start", "end")


def _joined_spans(found: DataFrame) -> DataFrame:
    """(_d, _t, cuts): the sorted spans of each text, joined where they touch. A window holds one text's spans."""
    text = Window.partitionBy("_d", "_t").orderBy("start", "end")
    found = found.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), "start", "end")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = opens.withColumn("island", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("_d", "_t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return staged(islands.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed) for every row of ``docs`` (doc_id, text, ...): what is left and what went.

    ``removed`` lists the removed spans as (start, end) code points of the original text, joined where they
    overlap. A null text stays null. Rows with equal ids stay separate rows; an empty table gives an empty
    result; other columns are ignored.
    """
    spans = _joined_spans(repeated_units(docs, min_words))
    n, total = spans.agg(F.count("*"), F.sum(F.size("cuts"))).first()
    spans = small(spans, 100 + 40 * int((total or 0) / max(n, 1) + 1))
    keyed = docs.select("doc_id", "text", text_key().alias("tkey"))
    keyed = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_d"]) & (keyed["tkey"] == spans["_t"]), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                cuts = cuts or []
                if cuts:
                    edges = [0, *[x for c in cuts for x in (c["start"], c["end"])], len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text)
                removed.append(cuts)
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = keyed.select("doc_id", "text", "cuts")
    return joined.mapInArrow(cut, f"doc_id {kind}, text string, removed array<struct<start:int,end:int>>")

