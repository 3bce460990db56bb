"""Conversation logs: summaries, truncation, history, tool tags, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import WS_CLASS, js_rtrim, js_trim, short_title
from noteloom.runtime import checked, lookup_join

# --- fixed values: tag formats and the title of an empty conversation ---
READ_TAG = r"<vault_read>([^<]+)</vault_read>"
WRITE_TAG = rf'(?s)<vault_write[{WS_CLASS}]+path="([^"]+)">(.*?)</vault_write>'
ANY_READ_TAG = r"<vault_read>[^<]*</vault_read>"
ANY_WRITE_TAG = rf'(?s)<vault_write[{WS_CLASS}]+path="[^"]*">.*?</vault_write>'
OPEN_TAG = r"(?s)<vault.*$"
TAG_START = r"<v(?:a(?:u(?:l)?)?)?\z"  # the first letters of a tag at the very end
NEW_CHAT = "New chat"
# ------------------------------------------------------------------------


def conversation_index(messages: DataFrame) -> DataFrame:
    """(conv_id, title, message_count, created_at, updated_at). Plain partial aggregates."""
    by_user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.coalesce(short_title(F.min_by(F.when(by_user, F.col("content")), F.when(by_user, F.col("turn")))), F.lit(NEW_CHAT)).alias("title"),
        F.count("*").alias("message_count"),
        F.min_by("ts", "turn").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def conversation_list(messages: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The index, latest first, without deleted conversations."""
    kept = messages if deleted is None else messages.join(deleted.select("conv_id"), "conv_id", "left_anti")
    return conversation_index(kept).orderBy(F.desc("updated_at"), "conv_id")


def chat_history(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") != "system").select("conv_id", "turn", "role", "content")


def last_assistant(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content")
    )


def truncate_last_user(messages: DataFrame) -> DataFrame:
    """Messages before each conversation's last user message; without one nothing is cut.

    The cut is an aggregate joined back instead of a window, so one huge conversation is spread
    over many tasks.
    """
    cut = messages.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_cut"), F.count("*").alias("_n")
    )
    joined = lookup_join(messages, cut, ["conv_id"], weight="_n")
    return joined.where(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut"))).drop("_cut", "_n")


def truncate_at(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages before an edited user message (conv_id, at_turn); other conversations are kept whole.

    Of several edits of a conversation the first counts. Cuts are joined by size, as in :func:`truncate_last_user`.
    """
    edited = checked(edits.select("conv_id", F.col("at_turn").alias("turn")).distinct())
    targets = messages.where(F.col("role") == "user").select("conv_id", "turn").join(edited, ["conv_id", "turn"], "left_semi")
    first = targets.groupBy("conv_id").agg(F.min("turn").alias("_cut"))
    sizes = messages.join(checked(first.select("conv_id")), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("_n"))
    joined = lookup_join(messages, first.join(sizes, "conv_id"), ["conv_id"], weight="_n", how="left")
    return joined.where(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut"))).drop("_cut", "_n")


def read_tags(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(READ_TAG), F.lit(1)), js_trim)


def write_tags(text: Column | str) -> Column:
    paths = F.transform(F.regexp_extract_all(text, F.lit(WRITE_TAG), F.lit(1)), js_trim)
    bodies = F.transform(F.regexp_extract_all(text, F.lit(WRITE_TAG), F.lit(2)), js_trim)
    return F.zip_with(paths, bodies, lambda p, c: F.struct(p.alias("path"), c.alias("content")))


def tool_tags(logs: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(keys, op, pos, path, content): one row per read or write tag."""
    blank = F.lit(None).cast("string")
    reads = F.transform(read_tags(text), lambda p, i: F.struct(F.lit("read").alias("op"), i.alias("pos"), p.alias("path"), blank.alias("content")))
    writes = F.transform(
        write_tags(text), lambda w, i: F.struct(F.lit("write").alias("op"), i.alias("pos"), w["path"].alias("path"), w["content"].alias("content"))
    )
    return logs.select(*keys, F.explode_outer(F.concat(reads, writes)).alias("t")).where(F.col("t").isNotNull()).select(*keys, "t.*")


def strip_tool_tags(text: Column | str) -> Column:
    """Text without complete tags."""
    no_reads = js_trim(F.regexp_replace(text, READ_TAG, ""))
    return js_trim(F.regexp_replace(no_reads, ANY_WRITE_TAG, ""))


def clean_truncated(text: Column | str) -> Column:
    """Displayable part of a response that may have been cut inside a tag."""
    done = F.regexp_replace(F.regexp_replace(text, ANY_READ_TAG, ""), ANY_WRITE_TAG, "")
    opened = F.regexp_replace(done, OPEN_TAG, "")
    return js_rtrim(F.regexp_replace(opened, TAG_START, ""))
