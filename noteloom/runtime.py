"""Session helpers shared by every operator: staging, bounded broadcasts, skew-aware lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after it was counted and found below this many rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
# Of a longer lookup table, the most frequent keys up to this number are broadcast.
HOT_ROWS = 250_000
_TABLE = "noteloom_staged_"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def local_session(app: str = "noteloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, benchmarks) may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="noteloom-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/noteloom/{spark.sparkContext.applicationId}"


def _prefix(spark: SparkSession) -> str:
    """Of this application's staged tables; another application's tables are never dropped."""
    return _TABLE + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def drop_staged(spark: SparkSession) -> None:
    """Remove everything this application staged. Frames built on it must not be used afterwards."""
    for t in spark.catalog.listTables(pattern=f"{_prefix(spark)}*"):
        spark.sql(f"drop table if exists {t.name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times or its lineage must be cut: the copy survives
    lost executors, is columnar (so later reads prune columns) and carries size statistics.
    """
    path = f"{_run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._noteloom_staged = True
    return staged


def staged_parts(spark: SparkSession, schema: T.StructType, parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of ``parts``, written one part after the other as by :func:`stage`; a part is asked for when the one before is written."""
    path, n = f"{_run_dir(spark)}/{uuid.uuid4().hex}", 0
    for n, part in enumerate(parts, 1):
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)


def staged_once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` as it is if :func:`stage` returned it, else a staged copy of its ``columns``."""
    return df if getattr(df, "_noteloom_staged", False) is True else stage(df.select(*columns))


def dealt(df: DataFrame, column: str) -> DataFrame:
    """``df`` with equal values of ``column`` in one task, in as many tasks as :func:`stage_bucketed` has buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def stage_bucketed(df: DataFrame, column: str, buckets: int | None = None, is_dealt: bool = False) -> DataFrame:
    """Like :func:`stage`, bucketed by ``column``: later group-bys and joins on it need no shuffle.

    What follows from :func:`dealt` rows without moving them is not shuffled again. A task then holds one bucket, so it is written
    as it comes; Spark would otherwise sort all rows by bucket first.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{_prefix(spark)}{uuid.uuid4().hex}"
    writers = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "4")
    try:
        (
            (df if is_dealt else df.repartition(n, column))
            .write.bucketBy(n, column)
            .option("path", f"{_run_dir(spark)}/{name}")
            .format("parquet")
            .saveAsTable(name)
        )
    finally:
        spark.conf.set(_WRITERS, writers)
    return spark.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that arrives in fewer splits than there are cores.

    Only small inputs (a file with a single row group, say) are affected; a large table already
    has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows if there are at most ``limit``, else None. Never fetches more than ``limit + 1``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its text as JSON, and what Spark adds to every value."""
    return F.octet_length(F.to_json(F.struct(*df.columns))) + 8 * (len(df.columns) + 2)


def _size(staged: DataFrame) -> Row:
    """(n, size): rows and, if they are within the bound, bytes."""
    n = staged.count()
    return Row(n=n, size=staged.agg(F.coalesce(F.sum(row_bytes(staged)), F.lit(0))).first()[0] if n <= BROADCAST_ROWS else None)


def _kept_apart(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Spark would go by the bytes of the files, and paths are many times as long in memory."""
    return df.hint("merge")


def checked(df: DataFrame) -> DataFrame:
    """Write ``df`` once, count its rows and bytes, and mark it for broadcast if it is within the bounds.

    For the side of a join that is usually small next to note texts (winners of a search, changed
    paths): within the bounds the texts are not shuffled, beyond them Spark joins by shuffle.
    """
    staged = stage(df)
    size = _size(staged)
    return F.broadcast(staged) if size.n <= BROADCAST_ROWS and size.size <= BROADCAST_BYTES else _kept_apart(staged)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str | None = None,
    how: str = "inner",
    hot_share: int = 1000,
    dim_rows: int | None = None,
) -> DataFrame:
    """Join a large table to a table with one row per key, safe for very frequent keys.

    ``weight`` is a column of ``dim`` holding the number of fact rows of each key. If the whole
    dimension is small it is broadcast. Otherwise the most frequent keys are joined by broadcast, up to HOT_ROWS and BROADCAST_BYTES
    of them by counted weights and in any case those carrying more than ``1/hot_share`` of all fact rows (there
    can be at most ``hot_share`` of them, whatever the data). Only the rest is shuffled, so that no task receives
    a hot key and most fact rows stay where they are.
    """
    parts = lookup_parts(facts, dim, keys, weight, how, hot_share, dim_rows)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def lookup_parts(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str | None = None,
    how: str = "inner",
    hot_share: int = 1000,
    dim_rows: int | None = None,
) -> list[DataFrame]:
    """:func:`lookup_join` in one part or two: rows joined by broadcast, which stay in their buckets, and the rest."""
    most = HOT_ROWS
    fits = True
    if dim_rows is None:
        dim = stage(dim)  # counted, and read again for the join
        dim_rows, size = _size(dim)
        if size is None:
            size = dim.limit(BROADCAST_ROWS).agg(F.sum(row_bytes(dim))).first()[0] * dim_rows // BROADCAST_ROWS
        fits = size <= BROADCAST_BYTES
        most = min(most, BROADCAST_BYTES * dim_rows // max(size, 1))
    if dim_rows <= BROADCAST_ROWS and fits:
        return [facts.join(F.broadcast(dim), keys, how)]
    if weight is None:
        return [facts.join(_kept_apart(dim), keys, how)]
    level = F.floor(F.log2(F.col(weight)) * 4)  # a few hundred levels, whatever the weights
    levels = dim.groupBy(level.alias("at")).agg(F.count("*").alias("n"), F.sum(weight).alias("w")).where("at is not null").orderBy(F.desc("at")).collect()
    total, held, least = sum(r["w"] for r in levels), 0, None
    for r in levels:
        held += r["n"]
        if held > most:
            break
        least = r["at"]
    frequent = F.col(weight) > total / hot_share
    frequent = F.coalesce(frequent if least is None else frequent | (level >= least), F.lit(False))
    hot, cold = dim.where(frequent), dim.where(~frequent)
    hot_keys = hot.select(*keys)
    return [facts.join(F.broadcast(hot), keys, "inner"), facts.join(F.broadcast(hot_keys), keys, "left_anti").join(_kept_apart(cold), keys, how)]


def rounded(score: Column) -> Column:
    """Scores at 9 digits: ranks must not depend on the order in which a shuffle adds floats."""
    return F.round(score, 9)
