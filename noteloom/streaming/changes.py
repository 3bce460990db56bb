"""Structured Streaming: change feeds, debouncing, idle detection, and index upkeep per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.changes import DEBOUNCE_MS, IDLE_MS, normalize_changes
from noteloom.runtime import exists
from noteloom.sources.stored_index import StoredIndex

CHANGE_SCHEMA = "path string, old_path string, op string, ts timestamp"


def read_changes(spark: SparkSession, source: str, fmt: str = "parquet", schema: str = CHANGE_SCHEMA) -> DataFrame:
    """Change events of Markdown files appended below ``source``."""
    events = spark.readStream.schema(schema).format(fmt).load(source)
    return events.where(F.endswith(F.col("path"), F.lit(".md")))


def debounced(events: DataFrame, key: str = "path", quiet_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n): a row per burst once the watermark has passed its quiet period."""
    session = F.session_window("ts", f"{quiet_ms} milliseconds")
    return (
        events.withWatermark("ts", late)
        .groupBy(key, session.alias("w"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
        .drop("w")
    )


def debounced_changes(
    events: DataFrame, quiet_ms: int = DEBOUNCE_MS, late: str = "10 minutes"
) -> DataFrame:
    """(path, op, last): a change per path and burst, with the burst's last operation.

    A rename counts as a deletion of the old path and a modification of the new one, before bursts are
    formed, so neither path is lost.
    """
    one = lambda path, op: F.struct(path.alias("path"), F.lit(op).alias("op"))
    renamed = F.array(one(F.col("old_path"), "delete"), one(F.col("path"), "modify"))
    plain = F.array(F.struct(F.col("path"), F.coalesce("op", F.lit("modify")).alias("op")))
    single = events.withWatermark("ts", late).select(
        "ts", F.explode(F.when((F.col("op") == "rename") & F.col("old_path").isNotNull(), renamed).otherwise(plain)).alias("c")
    )
    session = F.session_window("ts", f"{quiet_ms} milliseconds")
    bursts = single.select("ts", "c.*").groupBy("path", session.alias("w"))
    return bursts.agg(F.max_by("op", "ts").alias("op"), F.max("ts").alias("last")).drop("w")


def idle(events: DataFrame, user: str, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """(user, last): the last activity before each silence of ``idle_ms``."""
    return debounced(events, user, idle_ms, late).select(user, "last")


class IndexMaintainer:
    """``foreachBatch`` handler that keeps a stored index equal to the current notes.

    A micro-batch of changed paths becomes one batch of the index, named by stream and batch number; a repeated
    micro-batch finds that name and does nothing. Chunks, postings, term counts, links and file states move
    together. Notes in the excluded folders of the index's settings are not indexed.
    """

    def __init__(self, notes, store: StoredIndex):
        self.notes = notes  # function returning the current notes
        self.store = store
        self.stream = uuid.uuid4().hex  # replaced by the id kept with the checkpoint when a stream starts

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        changes = normalize_changes(batch) if "old_path" in batch.columns else batch
        self.store.update(self.notes(), changes.select("path"), f"{self.stream}-{batch_id}")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id written into the checkpoint folder; created with it."""
    where = f"{checkpoint}/noteloom_stream"
    if not exists(spark, f"{where}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").write.mode("overwrite").json(where)
    return spark.read.schema("id string").json(where).first()[0]


def maintain_index(changes: DataFrame, maintainer: IndexMaintainer, checkpoint: str, interval: str | None = "30 seconds"):
    """Start the upkeep query; ``interval`` None processes what is available and stops.

    A new checkpoint gets a new stream id, kept beside it, so batch numbers that start again never meet
    rows that another stream left.
    """
    maintainer.stream = _stream_id(changes.sparkSession, checkpoint)
    writer = changes.writeStream.foreachBatch(maintainer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
