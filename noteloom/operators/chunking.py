"""Split notes into chunks by section, paragraph or token budget.

The whole chunker is one narrow projection per note: lines are folded into break positions with
``aggregate``, texts are cut with ``slice`` and exploded at the very end. Nothing is shuffled, so
cost grows linearly with the corpus and a corpus-wide line table never exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import WS_CLASS, bound, estimate_tokens, js_ltrim, js_trim
from noteloom.operators.frontmatter import with_frontmatter

STRATEGIES = ("section", "paragraph", "fixed")
_HEADING = rf"^#{{1,6}}[{WS_CLASS}]"
_MARK = 2**31  # a mark packs a break's line number and a heading's line number into one long


def _heading(line: Column) -> Column:
    return js_trim(F.ltrim(line, F.lit("#")))


def _line_facts(lines: Column, strategy: str) -> Column:
    """What the strategy asks of the lines: the cost of a line is dear and only a budget needs it, of every line.

    The other strategies change their state at headings, fences and (paragraphs) blank lines only; most lines are neither and
    are dropped here, by two plain comparisons.
    """
    is_heading = lambda line: F.startswith(line, F.lit("#")) & line.rlike(_HEADING)
    is_fence = lambda line: F.contains(line, F.lit("```")) & F.startswith(js_ltrim(line), F.lit("```"))

    def fact(i, fence, heading, **asked):
        return F.struct(i.alias("i"), fence.alias("fence"), heading.cast("string").alias("heading"), *[c.alias(n) for n, c in asked.items()])

    if strategy == "fixed":
        return F.transform(
            lines, lambda line, i: fact(i, is_fence(line), F.when(is_heading(line), _heading(line)), cost=estimate_tokens(line))
        )
    no, yes, none = F.lit(False), F.lit(True), F.lit(None)
    blank = (lambda c: {"blank": c}) if strategy == "paragraph" else (lambda c: {})

    def turn(line, i):
        found = F.when(is_heading(line), fact(i, no, _heading(line), **blank(no))).when(is_fence(line), fact(i, yes, none, **blank(no)))
        return found.when(js_trim(line) == "", fact(i, no, none, **blank(yes))) if strategy == "paragraph" else found

    return F.filter(F.transform(lines, turn), lambda f: f.isNotNull())


def _mark(line: Column, heading_line: Column) -> Column:
    return line.cast("long") * _MARK + heading_line + 1


def _no_marks() -> Column:
    return F.array().cast("array<bigint>")


def _state(in_code, heading_line, marks, **counts) -> Column:
    counted = [c.cast("int").alias(n) for n, c in counts.items()]
    return F.struct(in_code.alias("in_code"), heading_line.cast("int").alias("heading_line"), marks.alias("marks"), *counted)


def _marks(facts: Column, n_lines: Column, strategy: str, max_tokens: int) -> Column:
    """Where the raw chunks end, each with the line of its heading (-1: none), closed by the last line.

    The fold copies its state at every fact, so the state holds numbers only.
    """
    none = {"held": F.lit(0), "used": F.lit(0)} if strategy == "fixed" else {}
    start = _state(F.lit(False), F.lit(-1), _no_marks(), **none)

    def mark_if(acc, cut, line, heading_line):
        return F.when(cut, F.array_append(acc["marks"], _mark(line, heading_line))).otherwise(acc["marks"])

    def section(acc, f):
        in_code = acc["in_code"] != f["fence"]
        opens = ~in_code & f["heading"].isNotNull()
        heading_line = F.when(opens, f["i"]).otherwise(acc["heading_line"])
        cut = opens & (f["i"] > 0)
        return _state(in_code, heading_line, mark_if(acc, cut, f["i"], acc["heading_line"]))

    def paragraph(acc, f):
        in_code = acc["in_code"] != f["fence"]
        heading_line = F.when(~in_code & f["heading"].isNotNull(), f["i"]).otherwise(acc["heading_line"])
        gap = f["blank"] & ~in_code
        return _state(in_code, heading_line, mark_if(acc, gap, f["i"], heading_line))

    def fixed(acc, f):
        in_code = acc["in_code"] != f["fence"]
        heading_line = F.when(~in_code & f["heading"].isNotNull(), f["i"]).otherwise(acc["heading_line"])
        full = (acc["used"] + f["cost"] > max_tokens) & (acc["held"] > 0) & ~in_code
        return _state(
            in_code,
            heading_line,
            mark_if(acc, full, f["i"], heading_line),
            held=F.when(full, F.lit(1)).otherwise(acc["held"] + 1),
            used=F.when(full, f["cost"]).otherwise(acc["used"] + f["cost"]),
        )

    step = {"paragraph": paragraph, "fixed": fixed}.get(strategy, section)
    return F.aggregate(facts, start, step, lambda acc: F.array_append(acc["marks"], _mark(n_lines, acc["heading_line"])))


def _ranges(marks: Column, skip: int = 0) -> Column:
    """(first, last, heading_line) per mark; ``skip`` = 1 when the marked line belongs to no chunk."""

    def one(mark, j):
        before = F.floor(F.get(marks, j - 1) / _MARK) + skip
        return F.struct(
            F.when(j == 0, F.lit(0)).otherwise(before).cast("int").alias("first"),
            (F.floor(mark / _MARK) - 1).cast("int").alias("last"),
            (mark % _MARK - 1).cast("int").alias("heading_line"),
        )

    return F.transform(marks, one)


def _text(lines: Column, first: Column, last: Column) -> Column:
    return js_trim(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))


def _piece(content, heading, start_line, end_line) -> Column:
    return bound(
        content,
        lambda text: F.struct(
            text.alias("content"),
            heading.alias("heading"),
            start_line.cast("int").alias("start_line"),
            end_line.cast("int").alias("end_line"),
            estimate_tokens(text).alias("tokens"),
        ),
    )


def split_large(chunk: Column, max_tokens: int) -> Column:
    """Cut one oversize chunk at line ends; a single line over the budget stays whole."""
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("used"), _no_marks().alias("marks"))

    def step(acc, f):
        full = (acc["used"] + f["cost"] > max_tokens) & (acc["held"] > 0)
        return F.struct(
            F.when(full, F.lit(1)).otherwise(acc["held"] + 1).alias("held"),
            F.when(full, f["cost"]).otherwise(acc["used"] + f["cost"]).alias("used"),
            F.when(full, F.array_append(acc["marks"], _mark(f["i"], F.lit(-1)))).otherwise(acc["marks"]).alias("marks"),
        )

    def pieces(lines):
        last_line = F.size(lines) - 1
        costs = F.transform(lines, lambda l, i: F.struct(i.alias("i"), estimate_tokens(l).alias("cost")))
        marks = F.aggregate(costs, start, step, lambda a: F.array_append(a["marks"], _mark(F.size(lines), F.lit(-1))))
        return F.transform(
            bound(marks, _ranges),
            lambda s: _piece(
                _text(lines, s["first"], s["last"]),
                chunk["heading"],
                chunk["start_line"] + s["first"],
                F.when(s["last"] == last_line, chunk["end_line"]).otherwise(chunk["start_line"] + s["last"]),
            ),
        )

    return F.filter(bound(F.split(chunk["content"], "\n", -1), pieces), lambda p: p["content"] != "")


def raw_chunks(bodies: DataFrame, strategy: str, max_tokens: int) -> DataFrame:
    """Add ``raw``: the strategy's chunks of ``body`` before oversize splitting."""
    return (
        bodies.withColumn("_lines", F.split("body", "\n", -1))
        .withColumn("_marks", _marks(_line_facts(F.col("_lines"), strategy), F.size("_lines"), strategy, max_tokens))
        .withColumn(
            "raw",
            F.filter(
                F.transform(
                    _ranges(F.col("_marks"), skip=1 if strategy == "paragraph" else 0),
                    lambda s: _piece(
                        _text(F.col("_lines"), s["first"], s["last"]),
                        F.when(s["heading_line"] >= 0, _heading(F.get("_lines", s["heading_line"]))),
                        F.col("body_start_line") + s["first"],
                        F.col("body_start_line") + s["last"],
                    ),
                ),
                lambda p: p["content"] != "",
            ),
        )
        .drop("_lines", "_marks")
    )


def chunk_documents(notes: DataFrame, strategy: str = "section", max_tokens: int = 512) -> DataFrame:
    """Chunks of every note: front matter, strategy split, oversize split, numbering."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    split = raw_chunks(with_frontmatter(notes.select("path", "name", "content")), strategy, max_tokens)
    cut = F.flatten(
        F.transform(
            "raw", lambda c: F.when(c["tokens"] <= max_tokens, F.array(c)).otherwise(split_large(c, max_tokens))
        )
    )
    final = F.when(F.exists("raw", lambda c: c["tokens"] > max_tokens), cut).otherwise(F.col("raw"))  # most notes have no large chunk
    has_meta = F.size("metadata") > 0
    meta = [F.when(has_meta, F.col(c)).alias(c) for c in ("metadata", "metadata_is_list")]
    return (
        split.select("path", "name", *meta, final.alias("_final"))
        .select("path", "name", "metadata", "metadata_is_list", F.posexplode_outer("_final").alias("chunk_index", "c"))
        .where(F.col("c").isNotNull())  # outer: keeps the optimizer from chunking twice for a size check
        .select(
            F.concat("path", F.lit("::"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "path",
            "name",
            "chunk_index",
            F.col("c.content").alias("content"),
            F.col("c.heading").alias("heading"),
            F.col("c.start_line").alias("start_line"),
            F.col("c.end_line").alias("end_line"),
            F.col("c.tokens").alias("tokens"),
            "metadata",
            "metadata_is_list",
        )
    )
