"""Front matter: split a note into metadata and body. One narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import bound, js_ltrim, js_trim

_ENTRIES = "array<struct<key:string,values:array<string>,is_list:boolean>>"
_QUOTES = r"^[\"']|[\"']$"


def _unquoted(value: Column) -> Column:
    quoted = F.contains(value, F.lit("'")) | F.contains(value, F.lit('"'))  # most values need no pattern
    return F.when(quoted, F.regexp_replace(value, _QUOTES, "")).otherwise(value)


def _yaml_entries(block: Column) -> Column:
    """Fold the YAML lines into (key, values, is_list) entries in writing order."""
    lines = F.transform(F.split(block, "\n"), js_trim)
    lines = F.filter(lines, lambda l: (l != "") & ~F.startswith(l, F.lit("#")))
    empty = F.struct(
        F.lit("").alias("key"),
        F.lit(False).alias("open"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast(_ENTRIES).alias("done"),
    )

    def entry(key, values, is_list):
        return F.struct(key.alias("key"), values.alias("values"), F.lit(is_list).alias("is_list"))

    def flushed(acc):
        return F.when(acc["open"], F.array_append(acc["done"], entry(acc["key"], acc["items"], True))).otherwise(
            acc["done"]
        )

    def step(acc, line):
        colon = F.instr(line, ":")
        value = js_trim(F.substring(line, colon + 1, F.char_length(line)))
        return bound(F.struct(colon.alias("colon"), value.alias("value")), lambda cut: state_after(acc, line, cut["colon"], cut["value"]))

    def state_after(acc, line, colon, value):
        key = js_trim(F.substring(line, F.lit(1), colon - 1))
        inner = F.substring(value, F.lit(2), F.char_length(value) - 2)
        parts = F.transform(F.split(inner, ","), lambda p: _unquoted(js_trim(p)))
        inline = F.filter(parts, lambda p: p != "")
        is_item = acc["open"] & F.startswith(line, F.lit("- "))
        opens = (value == "") | (value == "[]")
        is_inline = F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]"))
        no_items = F.array().cast("array<string>")

        def state(key, is_open, items, done):
            return F.struct(key.alias("key"), is_open.alias("open"), items.alias("items"), done.alias("done"))

        item = state(
            acc["key"],
            acc["open"],
            F.array_append(acc["items"], js_trim(F.substring(line, F.lit(3), F.char_length(line)))),
            acc["done"],
        )
        scalar = F.array(_unquoted(value))
        return (
            F.when(is_item, item)
            .when(colon <= 1, acc)
            .when(opens, state(key, F.lit(True), no_items, flushed(acc)))
            .when(is_inline, state(F.lit(""), F.lit(False), no_items, F.array_append(flushed(acc), entry(key, inline, True))))
            .otherwise(
                state(F.lit(""), F.lit(False), no_items, F.array_append(flushed(acc), entry(key, scalar, False)))
            )
        )

    return F.aggregate(lines, empty, step, flushed)


def with_frontmatter(notes: DataFrame, content: str = "content") -> DataFrame:
    """Add ``metadata`` (map), ``metadata_is_list`` (map), ``body`` and ``body_start_line``."""
    text = F.col(content)
    trimmed = notes.withColumn("_t", js_ltrim(text)).withColumn(
        "_end", F.when(F.startswith(F.col("_t"), F.lit("---")), F.locate("\n---", F.col("_t"), 4)).otherwise(0)
    )
    found = F.col("_end") > 0
    block = js_trim(F.substring(F.col("_t"), F.lit(5), F.greatest(F.col("_end") - 5, F.lit(0))))
    rest = F.substring(F.col("_t"), F.col("_end") + 4, F.char_length("_t"))
    parsed = trimmed.withColumn("_rest", rest).withColumn(
        "body",
        F.when(~found, text)
        .when(F.startswith(F.col("_rest"), F.lit("\n")), F.substring(F.col("_rest"), F.lit(2), F.char_length("_rest")))
        .otherwise(F.col("_rest")),
    )
    before = F.substring(text, F.lit(1), F.position(F.col("body"), text) - 1)
    line_no = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    # The common note has no front matter; only the others run the fold.
    entries = F.when(found, _yaml_entries(block)).otherwise(F.array().cast(_ENTRIES))
    parsed = parsed.withColumn("_all", entries).withColumn(
        "_last",
        F.filter(
            F.col("_all"),
            lambda e, i: ~F.exists(
                F.slice(F.col("_all"), i + 2, F.size("_all")), lambda later: later["key"] == e["key"]
            ),
        ),
    )
    return (
        parsed.withColumn(
            "metadata", F.map_from_entries(F.transform("_last", lambda e: F.struct(e["key"], e["values"])))
        )
        .withColumn(
            "metadata_is_list", F.map_from_entries(F.transform("_last", lambda e: F.struct(e["key"], e["is_list"])))
        )
        .withColumn("body_start_line", F.when(found, line_no).otherwise(0).cast("int"))
        .drop("_t", "_end", "_rest", "_all", "_last")
    )


def metadata_rows(notes: DataFrame) -> DataFrame:
    """One row per (path, key, value) of the front matter, for ad-hoc queries."""
    parsed = with_frontmatter(notes).select("path", "metadata", "metadata_is_list")
    return (
        parsed.select("path", "metadata_is_list", F.explode_outer("metadata").alias("key", "vals"))
        .where(F.col("key").isNotNull())
        .select("path", "key", F.element_at("metadata_is_list", F.col("key")).alias("is_list"), F.posexplode_outer("vals").alias("pos", "value"))
    )
