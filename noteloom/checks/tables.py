"""The given tables as the toolkit's inputs: notes, chunks, queries, vectors, messages, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import base_name, extension, file_name
from noteloom.runtime import spread, stage

# Markdown notes derived from the order tables: valid in Spark and in DuckDB.
NOTES_SQL = """
with o as (select o_custkey, max(o_orderdate) as last_ts, count(*) as n_orders from {orders} group by o_custkey),
c as (select c.*, n.n_name, n.n_nationkey, r.r_name, o.last_ts, coalesce(o.n_orders, 0) as n_orders, p.c_name as peer
  from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
  left join o on o.o_custkey = c.c_custkey
  left join {customer} p on p.c_custkey = cast(floor(c.c_custkey / 2.0) as bigint) and p.c_custkey <> c.c_custkey)
select concat(r_name, '/', n_name, '/', c_name, '.md') as path, c_name as basename,
  concat('---', chr(10), 'tags: [', lower(c_mktsegment), ', customer]', chr(10), 'status: "active"', chr(10),
    'aliases:', chr(10), '  - alias ', cast(c_custkey as varchar(20)), chr(10), '---', chr(10),
    'Preamble for ', c_name, chr(10), chr(10), '# Profile', chr(10), 'Based in [[', n_name, ']] segment ', c_mktsegment, '.', chr(10), chr(10),
    '```sql', chr(10), '# not a heading', chr(10), chr(10), 'select 1', chr(10), '```', chr(10),
    '## Orders', chr(10), cast(n_orders as varchar(20)), ' orders on file.', chr(10), chr(10),
    case when n_nationkey % 5 = 0 then concat('日本語のメモ、東京。', chr(10)) else '' end,
    '### Related', chr(10), case when peer is null then 'none' else concat('See [[', peer, '|peer]].') end) as content,
  coalesce(last_ts, {epoch}) as mtime
from c
union all
select concat(r_name, '/', n_name, '.md'), n_name, concat('# ', n_name, chr(10), 'Part of [[', r_name, ']].'), {epoch}
from {nation} join {region} on n_regionkey = r_regionkey
union all
select concat(r_name, '.md'), r_name, concat('# ', r_name), {epoch} from {region}
"""

NOTES = NOTES_SQL.format(
    orders="orders", customer="customer", nation="nation", region="region", epoch="timestamp '2000-01-01 00:00:00'"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, basename, ext, content, size, mtime."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    sql = NOTES_SQL.replace("{epoch}", "timestamp_ntz'2000-01-01 00:00:00'")
    return spark.sql(sql, **t).select(
        "path",
        F.col("basename").alias("name"),
        "basename",
        F.lit("md").alias("ext"),
        "content",
        F.octet_length("content").cast("long").alias("size"),
        "mtime",
    )


def stored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes as a table, for queries that read them more than once."""
    return spread(stage(notes(spark, sf_dir)))


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain documents as notes: path = source/doc_id.md, with the row's other columns."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = spread(table(spark, sf_dir, "documents")).withColumn("path", path)
    return d.select(
        "path",
        base_name("path").alias("name"),
        file_name("path").alias("file_name"),
        extension("path").alias("ext"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        "doc_id",
        "lang",
        "source",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
