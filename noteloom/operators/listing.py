"""Folder tree, filtered and paged note listings, and their text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import bytes_label, file_name, minute_label, parent_folder

_SORTS = ("mtime", "ctime", "name", "size")
_SIZES = (None, "empty", "small", "large")


def folder_entries(notes: DataFrame) -> DataFrame:
    """(path, name, parent, children) of every folder; children are direct files and folders.

    Files are counted per folder first, so a folder holding most notes is one partial aggregate;
    the ancestor expansion then runs over distinct folders only.
    """
    files = notes.groupBy(parent_folder("path").alias("folder")).agg(F.count("*").alias("files")).where("folder <> ''")
    segments = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    folders = files.select(F.explode(prefixes).alias("path")).distinct().withColumn("parent", parent_folder("path"))
    counts = (
        files.select(F.col("folder").alias("path"), F.col("files").alias("n"))
        .unionByName(folders.where("parent <> ''").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n")))
        .groupBy("path")
        .agg(F.sum("n").alias("children"))
    )
    return counts.select("path", file_name("path").alias("name"), parent_folder("path").alias("parent"), "children")


def list_entries(
    notes: DataFrame,
    folder: str | None = None,
    recursive: bool = True,
    extensions: str = "md",
    include_folders: bool = False,
    size_filter: str | None = None,
) -> DataFrame:
    """All entries matching the filters: (path, name, type, size, mtime, children)."""
    if size_filter not in _SIZES:
        raise ValueError(f"size_filter must be one of {_SIZES}")
    wanted = [e.strip().lower() for e in extensions.split(",")]

    def scoped(path, parent):
        if not folder:
            return F.lit(True) if recursive else parent == ""
        return F.startswith(path, F.lit(folder.rstrip("/") + "/")) if recursive else parent == folder.rstrip("/")

    entries = (
        notes.where(F.lower("ext").isin(wanted))
        .where(scoped(F.col("path"), parent_folder("path")))
        .select(
            "path",
            file_name("path").alias("name"),
            F.lit("file").alias("type"),
            "size",
            "mtime",
            F.lit(None).cast("long").alias("children"),
        )
    )
    size = F.col("size")
    if size_filter:
        classes = {"empty": size == 0, "small": (size > 0) & (size < 1024), "large": size >= 102400}
        return entries.where(classes[size_filter])
    if include_folders:
        folders = folder_entries(notes).where(scoped(F.col("path"), F.col("parent")))
        entries = entries.unionByName(
            folders.select(
                "path",
                "name",
                F.lit("folder").alias("type"),
                F.lit(0).cast("long").alias("size"),
                F.lit(None).cast(notes.schema["mtime"].dataType).alias("mtime"),
                "children",
            )
        )
    return entries


def list_notes(
    notes: DataFrame, sort_by: str = "mtime", limit: int = 50, offset: int = 0, **filters
) -> DataFrame:
    """One page of a listing with ``position``, ``total`` and ``has_more`` on every row.

    The page is a top-n (no global sort); the total is a separate aggregate. ``ctime`` sorts by
    ``mtime``. Folders have no time and come last.
    """
    if sort_by not in _SORTS:
        raise ValueError(f"sort_by must be one of {_SORTS}")
    entries = list_entries(notes, **filters)
    page = entries.orderBy(*_page_order(sort_by)).offset(offset).limit(limit)
    total = entries.agg(F.count("*").alias("n")).scalar()
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def _page_order(sort_by: str):
    first = {"name": F.asc(F.collate(F.col("name"), "UNICODE")), "size": F.desc("size")}
    return [first.get(sort_by, F.desc_nulls_last("mtime")), F.asc("path")]


def _joined_lines(page: DataFrame, order, line, count: str):
    """Lines of an ordered page, as one array: the text is one value, so its rows meet in one task."""
    placed = page.select(F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line"))
    return placed.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda l: l["line"]).alias("lines"),
        F.count("*").alias(count),
    )


def _first(rows: DataFrame, by: list, cap: int | None) -> DataFrame:
    return rows if cap is None else rows.orderBy(*by).limit(cap)


def list_report(notes: DataFrame, sort_by: str = "mtime", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """The page as one text: headline, table head, one line per entry of the page."""
    entries = list_entries(notes, **filters)
    page = list_notes(notes, sort_by, limit, offset, **filters)
    items = F.concat(F.coalesce("children", F.lit(0)).cast("string"), F.lit(" items"))
    line = F.concat_ws(
        " | ",
        "path",
        "type",
        F.when(F.col("type") == "folder", items).otherwise(bytes_label("size")),
        F.coalesce(minute_label("mtime"), F.lit("-")),
    )
    body = _joined_lines(page, _page_order(sort_by), line, "shown").withColumn(
        "total", entries.agg(F.count("*").alias("n")).scalar()
    )
    more = F.when(F.lit(offset + limit) < F.col("total"), " (use offset for more)").otherwise("")
    head = F.concat(
        F.lit("Found "), F.col("total").cast("string"), F.lit(" items total. Showing "), F.col("shown").cast("string"), F.lit(" items."), more
    )
    text = F.array_join(
        F.concat(F.array(head, F.lit(""), F.lit("Path | Type | Size | Modified"), F.lit("---|---|---|---")), F.col("lines")), "\n"
    )
    return body.select(F.when(F.col("total") == 0, "No files found matching the criteria.").otherwise(text).alias("report"))


def render_table(
    rows: DataFrame, columns: list[str], order: list[tuple[str, str]], links: list[str] | None = None, cap: int | None = None
) -> DataFrame:
    """A query result as text: header, rule, all rows or the first ``cap`` and a count of the rest.

    Nulls are empty, times ``yyyy-MM-dd``, columns named in ``links`` become ``[[...]]``.
    """

    def cell(name):
        c = F.col(name)
        if rows.schema[name].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
            c = F.date_format(c, "yyyy-MM-dd")
        c = c.cast("string")
        if name in (links or []):
            c = F.concat(F.lit("[["), c, F.lit("]]"))
        return F.coalesce(c, F.lit(""))

    by = [F.desc(c) if d == "desc" else F.asc(c) for c, d in order]
    line = F.array_join(F.array(*[cell(c) for c in columns]), " | ")
    body = _joined_lines(_first(rows, by, cap), by, line, "shown").withColumn(
        "total", rows.agg(F.count("*").alias("n")).scalar()
    )
    return _with_rest(body, F.array(F.lit(" | ".join(columns)), F.lit(" | ".join("---" for _ in columns))), cap, "rows", "(No results)")


def render_list(rows: DataFrame, column: str, order: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
    """A result column as a bullet list with the same cap."""
    by = [F.desc(c) if d == "desc" else F.asc(c) for c, d in order]
    line = F.concat(F.lit("- "), F.coalesce(F.col(column).cast("string"), F.lit("")))
    body = _joined_lines(_first(rows, by, cap), by, line, "shown").withColumn(
        "total", rows.agg(F.count("*").alias("n")).scalar()
    )
    return _with_rest(body, None, cap, "items", "(No results)")


def render_tasks(tasks: DataFrame, order: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
    """Tasks (completed, text) as check boxes with the same cap."""
    by = [F.desc(c) if d == "desc" else F.asc(c) for c, d in order]
    line = F.concat(F.when(F.col("completed"), "- [x] ").otherwise("- [ ] "), F.col("text"))
    body = _joined_lines(_first(tasks, by, cap), by, line, "shown").withColumn(
        "total", tasks.agg(F.count("*").alias("n")).scalar()
    )
    return _with_rest(body, None, cap, "tasks", "(No tasks)")


def _with_rest(body: DataFrame, head, cap: int | None, noun: str, nothing: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rest = F.col("total") - F.col("shown")
    tail = F.when(rest > 0, F.array(F.concat(F.lit("... and "), rest.cast("string"), F.lit(f" more {noun}")))).otherwise(none)
    text = F.array_join(F.concat(head if head is not None else none, F.col("lines"), tail), "\n")
    return body.select(F.when(F.col("total") == 0, nothing).otherwise(text).alias("text"))
