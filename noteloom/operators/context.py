"""Text assembly: retrieved context, search reports, attached notes, full prompts, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import estimate_tokens, fixed_digits
from noteloom.operators.packing import LINKED_BUDGET, LINKED_MAX, omitted_counts, pack
from noteloom.runtime import checked, stage

# --- fixed values: texts every consumer of the context expects -------------------------------
CONTEXT_HEADER = "Relevant notes from vault (auto-retrieved by RAG):"
NO_RESULTS = "No relevant notes found for: "
ACTIVE_HEADER = "Currently open note:"
FILES_HEADER = (
    "Files in vault (user can reference any file using [[filename]] in their message and its content "
    "will be automatically loaded):"
)
# ---------------------------------------------------------------------------------------------
ATTACHED_HEADER = "The following notes are referenced from the user's notes:"


def joined(rows: DataFrame, by: str, order: Column, text: Column, separator: str, alias: str) -> DataFrame:
    """Join a few ordered texts per key (top-k rows, prompt parts) into one."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(alias))


def _heading() -> Column:
    return F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" > "), "heading")).otherwise("")


def rag_context(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): the header and one block per result; '' when nothing was found."""
    block = F.concat(
        F.lit("--- [["), "name", F.lit("]]"), _heading(), F.lit(" ("), "path", F.lit(", score: "), fixed_digits(F.col("score"), 2), F.lit(") ---\n"), "content"
    )
    found = joined(results, "query_id", F.col("rank"), block, "\n\n", "blocks")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce(F.concat(F.lit(CONTEXT_HEADER + "\n\n"), "blocks"), F.lit("")).alias("context")
    )


def search_report(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, report): headline with count and query, one section per result, or a message."""
    section = F.concat(
        F.lit("### [["), "name", F.lit("]]"), _heading(), F.lit("\nPath: "), "path", F.lit(" | Score: "), fixed_digits(F.col("score"), 2),
        F.lit(" | Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n\n"), "content",
    )
    found = joined(results, "query_id", F.col("rank"), section, "\n\n---\n\n", "sections")
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    head = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(' relevant sections for "'), "text", F.lit('":'))
    return queries.select("query_id", "text").join(found.join(counts, "query_id"), "query_id", "left").select(
        "query_id",
        F.when(F.col("n") > 0, F.concat(head, F.lit("\n\n---\n\n"), "sections")).otherwise(F.concat(F.lit(NO_RESULTS), "text")).alias("report"),
    )


def note_block(name: str = "name") -> Column:
    return F.concat(F.lit("--- "), name, F.lit(" ("), "path", F.lit(") ---\n"), "content")


def attached_context(attached: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, text) of attached notes in attachment order."""
    text = joined(attached, request, F.col("position"), note_block("file_name"), "\n\n", "blocks")
    return text.select(request, F.concat(F.lit(ATTACHED_HEADER + "\n\n"), "blocks").alias("text"))


def context_tokens(contexts: DataFrame, request: str, text: str, limit: int = 100_000) -> DataFrame:
    total = contexts.groupBy(request).agg(F.sum(estimate_tokens(text)).alias("tokens"))
    return total.withColumn("within_limit", F.col("tokens") <= limit)


def linked_notes(
    links: DataFrame, notes: DataFrame, taken: DataFrame, budget: int = LINKED_BUDGET, most: int = LINKED_MAX
) -> tuple[DataFrame, DataFrame]:
    """Packed notes one link away and the omitted counts.

    ``links`` (request_id, path) are resolved link targets, ``taken`` (request_id, path) notes that are
    in the context already. Newest first, at most ``most`` notes and ``budget`` tokens; sizes and times are
    packed, contents join afterwards.
    """
    free = links.select("request_id", "path").distinct().join(taken, ["request_id", "path"], "left_anti")
    sized = stage(notes.select("path", "mtime", estimate_tokens("content").alias("tokens")).join(checked(free), "path"))
    picked = pack(sized, "request_id", [F.desc("mtime"), F.asc("path")], budget, most)
    return picked, omitted_counts(sized, picked, "request_id")


def apply_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Prompt = template text + user text, by ``action_id``."""
    return requests.join(templates, "action_id").withColumn("prompt", F.concat("template", "text"))


def assemble_prompt(parts: list[DataFrame]) -> DataFrame:
    """(request_id, prompt) from frames (request_id, part_no, seq, text), joined by blank lines.

    Parts per request are bounded: instructions, a file list, attachments and links within
    their budgets, and at most k search results.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.coalesce("text", F.lit("")) != "")
    return joined(rows, "request_id", F.struct("part_no", "seq"), F.col("text"), "\n\n", "prompt")
