"""Views for ad-hoc Spark SQL over notes: notes, metadata, tags, links, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import js_trim
from noteloom.operators.frontmatter import metadata_rows
from noteloom.operators.links import wikilinks

_TASK = r"(?m)^[ \t]*[-*+] \[([ xX])\] (.*)$"


def note_views(notes: DataFrame) -> dict[str, DataFrame]:
    """Relations to query together; each is one narrow projection of the notes."""
    meta = metadata_rows(notes)
    marks = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(_TASK), F.lit(1)).alias("mark"),
        F.regexp_extract_all("content", F.lit(_TASK), F.lit(2)).alias("text"),
    )
    tasks = notes.select("path", F.posexplode_outer(marks).alias("pos", "t")).where(F.col("t").isNotNull())
    return {
        "notes": notes,
        "metadata": meta,
        "tags": meta.where(F.col("key") == "tags").select("path", F.col("value").alias("tag")),
        "links": wikilinks(notes, distinct=False),
        "tasks": tasks.select("path", "pos", (F.lower("t.mark") == "x").alias("completed"), js_trim("t.text").alias("text")),
    }


def register_views(notes: DataFrame, prefix: str = "") -> None:
    """Make the relations available to ``spark.sql`` as temporary views."""
    for name, df in note_views(notes).items():
        df.createOrReplaceTempView(prefix + name)
