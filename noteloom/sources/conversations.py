"""Conversation store: messages as a partitioned table, import of one-file-per-conversation JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.runtime import checked, stage

_FILE = (
    "struct<id:string,title:string,provider:string,model:string,createdAt:bigint,updatedAt:bigint,scope:string,"
    "messages:array<struct<role:string,content:string,timestamp:bigint>>>"
)


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of conversation files; unreadable files are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _FILE).alias("c")).where(F.col("c.id").isNotNull())
    heads = raw.select(
        F.col("c.id").alias("conv_id"), "c.title", "c.provider", "c.model", F.col("c.createdAt").alias("created_at"),
        F.col("c.updatedAt").alias("updated_at"), "c.scope",
    )
    turns = raw.select(F.col("c.id").alias("conv_id"), F.posexplode("c.messages").alias("turn", "m"))
    return heads, turns.select("conv_id", "turn", "m.role", "m.content", F.col("m.timestamp").alias("ts"))


def replace_conversations(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """Stored messages with whole conversations replaced by their newly saved version."""
    saved = stage(saved)
    ids = checked(saved.select("conv_id").distinct())
    return stored.join(ids, "conv_id", "left_anti").select(stored.columns).unionByName(saved.select(stored.columns))


def delete_conversations(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(checked(ids.select("conv_id").distinct()), "conv_id", "left_anti").select(stored.columns)


def load_conversations(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of the given conversations; unknown ids have no rows."""
    return stored.join(checked(ids.select("conv_id").distinct()), "conv_id", "left_semi")
