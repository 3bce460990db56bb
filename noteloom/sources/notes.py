"""Note sources and sinks: scans, lookups, upserts."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import base_name, content_hash, extension
from noteloom.runtime import checked, stage


def scan_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Markdown files below ``root`` as notes. Metadata-only queries never open the files' text:
    ``size`` and ``mtime`` come from the listing.

    Spark's readers leave out names that begin with ``_`` or ``.``. Files and folders with ``_`` are notes like
    others here: they are listed apart and read by the tasks. Names with ``.`` are hidden.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri()
    raw = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("uri"),
            F.col("value").alias("content"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )
    whole = F.regexp_replace("uri", r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    start = len(base.getPath().rstrip("/")) + 2  # behind the root's own path and its slash
    seen = raw.withColumn("path", F.substring(whole, start, 1 << 30)).drop("uri")
    apart = _underscored(spark, base, glob)
    return as_notes(seen if apart is None else seen.unionByName(apart))


def _underscored(spark: SparkSession, base, glob: str) -> DataFrame | None:
    """Notes whose path below ``base`` has a part that begins with ``_``; None if there are none."""
    uri = base.toString()
    try:
        system, top = fs.FileSystem.from_uri(base.getPath() if base.getScheme() == "file" else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that only Spark's readers reach
        warnings.warn(f"notes with names that begin with _ cannot be listed below {uri}", stacklevel=3)
        return None
    found = []
    for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
        path = info.path[len(top.rstrip("/")) + 1 :]
        parts = path.split("/")
        if info.is_file and any(p[:1] == "_" for p in parts) and not any(p[:1] == "." for p in parts) and fnmatch(parts[-1], glob):
            found.append((path, info.path, info.size, info.mtime))
    if not found:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                with system.open_input_stream(batch.column("at")[i].as_py()) as stream:
                    text = stream.read().decode("utf-8", "replace")
                row = batch.slice(i, 1)
                columns = [row.column("path"), pa.array([text]), row.column("size"), row.column("mtime")]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "content", "size", "mtime"])

    listed = spark.createDataFrame(found, "path string, at string, size long, mtime timestamp")
    return listed.mapInArrow(read, "path string, content string, size long, mtime timestamp")


def as_notes(df: DataFrame) -> DataFrame:
    """Complete a frame with (path, content, mtime[, size]) to the note schema."""
    size = F.col("size") if "size" in df.columns else F.octet_length("content")
    return df.select(
        "path",
        base_name("path").alias("name"),
        base_name("path").alias("basename"),
        extension("path").alias("ext"),
        "content",
        size.cast("long").alias("size"),
        "mtime",
    )


def markdown_only(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("ext") == "md")


def in_folder(notes: DataFrame, folder: str) -> DataFrame:
    """Markdown notes at any depth below ``folder`` (a prefix filter that reaches the scan)."""
    return markdown_only(notes).where(F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/")))


def not_excluded(path: Column, folders: str | list[str]) -> Column:
    """Predicate: the path is none of the folders and lies in none of them."""
    names = folders.split(",") if isinstance(folders, str) else folders
    names = [n.strip() for n in names if n.strip()]
    keep = F.lit(True)
    for n in names:
        keep = keep & (path != n) & ~F.startswith(path, F.lit(n + "/"))
    return keep


def read_by_path(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """Each requested path with its content; missing paths keep a row with status 'missing'."""
    asked = stage(requests)
    wanted = checked(asked.select("path").distinct())
    found = notes.select("path", "name", "content").join(wanted, "path", "left_semi").withColumn("_hit", F.lit(True))
    return asked.join(found, "path", "left").select(
        *requests.columns,
        "name",
        "content",
        F.when(F.col("_hit"), "found").otherwise("missing").alias("status"),
    )


def recent_paths(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Paths by modification time, newest first; all of them unless ``limit`` is given."""
    ordered = markdown_only(notes).orderBy(F.desc("mtime"), "path")
    return (ordered if limit is None else ordered.limit(limit)).select("path", "mtime")


def upsert_notes(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Existing notes with created and modified ones applied; the last update of a path wins.

    ``updates`` carries the note columns plus ``seq`` (writing order). Updates are reduced to one
    row per path with a partial aggregate before they meet the table.
    """
    cols = existing.columns
    rest = [c for c in cols if c != "path"]
    latest = updates.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("u")).select("path", *[F.col(f"u.{c}") for c in rest])
    latest = stage(latest)
    return existing.join(checked(latest.select("path")), "path", "left_anti").select(cols).unionByName(latest.select(cols))


def write_partitioned(df: DataFrame, target: str, buckets: int = 64) -> None:
    """Replace only the path-hash partitions that occur in ``df`` (which must not read ``target``)."""
    (
        df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
        .repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(target)
    )


def with_hash(notes: DataFrame) -> DataFrame:
    return notes.withColumn("hash", content_hash("content"))


