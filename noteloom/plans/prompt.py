"""Prompt assembly for a batch of requests: instructions, files, attachments, links, retrieved context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import epoch_micros, file_name
from noteloom.operators.context import ACTIVE_HEADER, FILES_HEADER, assemble_prompt, attached_context, linked_notes, note_block, rag_context
from noteloom.operators.links import link_keys, resolve_links, written_links
from noteloom.operators.packing import LINKED_BUDGET, LINKED_MAX
from noteloom.plans.retriever import Retriever
from noteloom.runtime import checked, stage
from noteloom.sources.notes import recent_paths

SCOPES = ("active", "local", "vault")


def _omitted_text() -> Column:
    return F.concat(
        F.lit("(+"), F.col("omitted").cast("string"), F.lit(" more linked notes not included — switch to Vault scope to search all notes)")
    )


def build_prompts(
    requests: DataFrame,
    notes: DataFrame,
    retriever: Retriever | None = None,
    attachments: DataFrame | None = None,
    system_prompt: str = "",
    instructions: str = "",
    k: int = 5,
    min_score: float = 0.3,
    file_list: int | None = None,
    linked_budget: int = LINKED_BUDGET,
    linked_max: int = LINKED_MAX,
    query_vectors: DataFrame | None = None,
    rerank: bool = False,
) -> DataFrame:
    """(request_id, prompt) for requests (request_id, text, scope, anchor).

    Parts in order: system prompt, instructions, file list (vault scope without an index), attached
    notes (request_id, path, position), the anchor note, notes it links to (local scope), notes
    linked in the text, search results (vault scope). A note already in the context is not repeated.
    ``file_list`` limits the file list (all files by default), ``linked_budget`` and ``linked_max`` the
    linked notes. With ``query_vectors`` (query_id, embedding) the search is hybrid, with ``rerank`` results
    near the anchor move up.
    """
    req = stage(requests.select("request_id", "text", "scope", "anchor"))
    ids = req.select("request_id")
    texts = notes.select("path", "content")
    parts = []

    def part(df, no, text, seq=None):
        parts.append(df.select("request_id", F.lit(no).alias("part_no"), (seq if seq is not None else F.lit(0)).cast("int").alias("seq"), text.alias("text")))

    if system_prompt:
        part(ids, 1, F.lit(system_prompt))
    if instructions:
        part(ids, 2, F.lit(instructions))
    if retriever is None:
        # One list, shared by all requests as a scalar.
        listed = recent_paths(notes, file_list).agg(F.array_sort(F.collect_list(F.struct((-epoch_micros("mtime")).alias("o"), "path"))).alias("l"))
        text = listed.select(F.concat(F.lit(FILES_HEADER + "\n"), F.array_join(F.transform("l", lambda x: x["path"]), "\n"))).scalar()
        part(req.where("scope = 'vault'"), 3, text)
    taken = None
    if attachments is not None:
        with_text = texts.join(checked(attachments), "path").withColumn("file_name", file_name("path"))
        part(attached_context(with_text), 4, F.col("text"))
        taken = attachments.select("request_id", "path")
    anchors = req.where(F.col("anchor").isNotNull()).select("request_id", "scope", F.col("anchor").alias("path"))
    shown = anchors if taken is None else anchors.join(taken, ["request_id", "path"], "left_anti")
    active = texts.join(checked(shown), "path").withColumn("file_name", file_name("path"))
    part(active, 5, F.concat(F.lit(ACTIVE_HEADER + "\n"), note_block("file_name")))
    in_context = anchors.select("request_id", "path")
    if taken is not None:
        in_context = in_context.unionByName(taken)
    body = notes.select("path", "name", "content", "mtime")

    local = anchors.where("scope = 'local'")
    keys = stage(link_keys(notes))
    own_links = written_links(texts.join(checked(local.select("path").distinct()), "path", "left_semi"))
    targets = resolve_links(own_links, notes, keys=keys).where(F.col("target_path").isNotNull()).select("path", "target_path").distinct()
    linked = local.join(targets, "path").select("request_id", F.col("target_path").alias("path"))
    picked, omitted = linked_notes(linked, notes, in_context, linked_budget, linked_max)
    packed = body.join(checked(picked.select("request_id", "path")), "path")
    parts.append(
        packed.select(
            "request_id",
            F.lit(6).alias("part_no"),
            F.row_number().over(_newest_first()).cast("int").alias("seq"),
            note_block().alias("text"),
        )
    )
    part(omitted.where("omitted > 0"), 6, _omitted_text(), F.lit(1_000_000))

    asked = written_links(req, "request_id", "text")
    named = resolve_links(asked, notes, source=None, keys=keys).where(F.col("target_path").isNotNull())
    named = named.groupBy("request_id", F.col("target_path").alias("path")).agg(F.min("pos").alias("pos"))
    named = body.drop("mtime").join(checked(named.join(in_context.distinct(), ["request_id", "path"], "left_anti")), "path")
    part(named, 7, note_block(), F.col("pos"))

    if retriever is not None:
        vault = req.where("scope = 'vault'").select(F.col("request_id").alias("query_id"), "text")
        near = anchors.select(F.col("request_id").alias("query_id"), F.col("path").alias("anchor")) if rerank else None
        context = rag_context(stage(retriever.search(vault, k, min_score, query_vectors, near)), vault)
        part(context.withColumnRenamed("query_id", "request_id"), 8, F.col("context"))
    return assemble_prompt(parts)


def _newest_first():
    return Window.partitionBy("request_id").orderBy(F.desc("mtime"), "path")
