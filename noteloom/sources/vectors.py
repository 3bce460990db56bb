"""Vector shard files: JSON maps of chunk id to base64 little-endian float32."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHARD = "struct<entries:map<string,string>>"


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def encode_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("encoded", F.base64(_encode(F.col(column))))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of all shard files matching ``path``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _SHARD).alias("s"))
    entries = raw.select(F.explode("s.entries").alias("chunk_id", "encoded"))
    return entries.select("chunk_id", _decode(F.unbase64("encoded")).alias("embedding"))


def write_shards(vectors: DataFrame, path: str, per_shard: int = 500) -> None:
    """One JSON document per shard of about ``per_shard`` vectors, spread by hash of the id."""
    shards = max(1, -(-vectors.count() // per_shard))
    # base64 breaks its output into lines; shard files hold it in one piece.
    one_line = F.regexp_replace("encoded", r"[\r\n]", "")
    packed = (
        encode_vectors(vectors)
        .groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).alias("shard"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("chunk_id").cast("string"), one_line))).alias("entries"))
    )
    packed.repartition(shards, "shard").select(F.to_json(F.struct("entries")).alias("value"), "shard").write.partitionBy("shard").text(path)
