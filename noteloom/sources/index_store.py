"""Index persistence: validity of a stored index, Parquet layout, JSON export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.notes import write_partitioned

VERSION = 2  # fixed value: format version of the stored index

_CHUNK = "struct<id:string,filePath:string,fileName:string,content:string,heading:string,startLine:int,endLine:int,tokens:int,metadata:string>"
_CACHE = f"struct<version:int,chunkStrategy:string,chunkMaxTokens:int,excludeFolders:string,files:map<string,struct<hash:string,mtime:bigint,chunks:array<{_CHUNK}>>>>"


def is_valid(strategy: str, max_tokens: int, exclude_folders: str = "") -> Column:
    """Whether a stored index (version, chunk_strategy, chunk_max_tokens, exclude_folders) fits the settings."""
    folders = ",".join(f.strip() for f in exclude_folders.split(",") if f.strip())
    return (
        (F.col("version") == VERSION)
        & (F.col("chunk_strategy") == strategy)
        & (F.col("chunk_max_tokens") == max_tokens)
        & (F.col("exclude_folders") == folders)
    )


def metadata_json(metadata: Column, is_list: Column) -> Column:
    """Front matter as a JSON object: lists as arrays, scalars as strings, in writing order."""
    one = lambda k, v: F.concat(
        _json_string(k), F.lit(":"), F.when(is_list[k], F.to_json(v)).otherwise(_json_string(F.get(v, F.lit(0))))
    )
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(metadata), lambda e: one(e["key"], e["value"])), ","), F.lit("}"))


def _json_string(c: Column) -> Column:
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2)


def export_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, hash, mtime, chunks_json): one JSON array of chunks per file, in chunk order.

    A file's chunks together are one note's text, so gathering them per path is bounded.
    """
    core = F.to_json(
        F.struct(
            F.col("chunk_id").alias("id"),
            F.col("path").alias("filePath"),
            F.col("name").alias("fileName"),
            F.col("content"),
            F.col("heading"),
            F.col("start_line").alias("startLine"),
            F.col("end_line").alias("endLine"),
            F.col("tokens"),
        )
    )
    meta = metadata_json(F.col("metadata"), F.col("metadata_is_list"))
    full = F.when(F.col("metadata").isNull(), core).otherwise(
        F.concat(F.substring(core, F.lit(1), F.char_length(core) - 1), F.lit(',"metadata":'), meta, F.lit("}"))
    )
    grouped = chunks.select("path", F.struct("chunk_index", full.alias("j")).alias("c")).groupBy("path").agg(
        F.array_sort(F.collect_list("c")).alias("cs")
    )
    array = F.concat(F.lit("["), F.array_join(F.transform("cs", lambda c: c["j"]), ","), F.lit("]"))
    return files.join(grouped, "path", "left").select("path", "hash", "mtime", F.coalesce(array, F.lit("[]")).alias("chunks_json"))


def save_index(files: DataFrame, chunks: DataFrame, root: str, buckets: int = 64) -> None:
    """Write both tables, partitioned by path hash so that later updates touch few partitions."""
    write_partitioned(files, f"{root}/files", buckets)
    write_partitioned(chunks, f"{root}/chunks", buckets)


def load_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/files"), spark.read.parquet(f"{root}/chunks")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, files, chunks) of index files in the JSON layout; several files may be read at once."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _CACHE).alias("c"))
    meta = raw.select(
        F.col("c.version").alias("version"),
        F.col("c.chunkStrategy").alias("chunk_strategy"),
        F.col("c.chunkMaxTokens").alias("chunk_max_tokens"),
        F.col("c.excludeFolders").alias("exclude_folders"),
    )
    files = raw.select(F.explode("c.files").alias("path", "f"))
    chunks = files.select(F.posexplode("f.chunks").alias("chunk_index", "k")).select(
        F.col("k.id").alias("chunk_id"),
        F.col("k.filePath").alias("path"),
        F.col("k.fileName").alias("name"),
        "chunk_index",
        F.col("k.content").alias("content"),
        F.col("k.heading").alias("heading"),
        F.col("k.startLine").alias("start_line"),
        F.col("k.endLine").alias("end_line"),
        F.col("k.tokens").alias("tokens"),
        F.col("k.metadata").alias("metadata_json"),
    )
    return meta, files.select("path", F.col("f.hash").alias("hash"), F.timestamp_millis("f.mtime").alias("mtime")), chunks
