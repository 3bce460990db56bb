"""Provider payloads: response normalisation, usage, stream-log reassembly, request bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import js_trim
from noteloom.runtime import checked, stage

_USES = "array<struct<id:string,name:string,input:string>>"
_OPENAI = (
    "struct<model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,choices:array<struct<finish_reason:string,"
    "message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>>"
)
_ANTHROPIC = (
    "struct<model:string,stop_reason:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,"
    "content:array<struct<type:string,text:string,id:string,name:string,input:string>>>"
)
_GEMINI = (
    "struct<modelVersion:string,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>,"
    "candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean,functionCall:struct<name:string,args:string>>>>>>>"
)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _result(content, model, usage, tokens_in, tokens_out, finish, uses) -> Column:
    return F.struct(
        content.alias("content"),
        _blank(model).alias("model"),
        F.when(usage.isNotNull(), F.coalesce(tokens_in, F.lit(0)).cast("long")).alias("input_tokens"),
        F.when(usage.isNotNull(), F.coalesce(tokens_out, F.lit(0)).cast("long")).alias("output_tokens"),
        F.when(finish != "", finish).alias("finish_reason"),
        F.coalesce(uses, F.array()).cast(_USES).alias("tool_uses"),
    )


def _is_json(text: Column) -> Column:
    """Whether a text is JSON; an object may repeat a key, which a variant does not allow."""
    return F.try_parse_json(text).isNotNull() | F.get_json_object(text, "$").isNotNull()


# How a JSON text can begin; and an object without a closing brace is none. Java throws, at length, for every other text.
_BEGINS = r"^[\s\x{FEFF}]*(?:true|false|null|NaN|Infinity|INF|[^a-zA-Z{\s\x{FEFF}]|\{[^}]*+\})"


def _may_be_json(text: Column) -> Column:
    return text.rlike(_BEGINS)


def normalize_responses(logs: DataFrame) -> DataFrame:
    """Response logs (response_id, provider, body) in one shape whatever the provider.

    Text parts are joined, thought parts skipped, tool calls with unreadable arguments dropped.
    ``tool_uses.input`` stays JSON text.
    """
    o = F.from_json("body", _OPENAI)
    first = F.get(o["choices"], F.lit(0))
    calls = F.filter(first["message"]["tool_calls"], lambda c: c["function"].isNotNull())
    arguments = lambda c: F.when(_blank(c["function"]["arguments"]) == "", "{}").otherwise(c["function"]["arguments"])
    calls = F.filter(calls, lambda c: _is_json(arguments(c)))
    openai = _result(
        _blank(first["message"]["content"]),
        o["model"],
        o["usage"],
        o["usage"]["prompt_tokens"],
        o["usage"]["completion_tokens"],
        first["finish_reason"],
        F.transform(calls, lambda c: F.struct(_blank(c["id"]).alias("id"), _blank(c["function"]["name"]).alias("name"), arguments(c).alias("input"))),
    )
    a = F.from_json("body", _ANTHROPIC)
    texts = F.transform(F.filter(a["content"], lambda b: b["type"] == "text"), lambda b: b["text"])
    anthropic = _result(
        _blank(F.array_join(texts, "")),
        a["model"],
        a["usage"],
        a["usage"]["input_tokens"],
        a["usage"]["output_tokens"],
        a["stop_reason"],
        F.transform(
            F.filter(a["content"], lambda b: b["type"] == "tool_use"),
            lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("input")),
        ),
    )
    g = F.from_json("body", _GEMINI)
    candidate = F.get(g["candidates"], F.lit(0))
    parts = candidate["content"]["parts"]
    said = F.filter(parts, lambda p: (_blank(p["text"]) != "") & ~F.coalesce(p["thought"], F.lit(False)))
    gemini = _result(
        _blank(F.array_join(F.transform(said, lambda p: p["text"]), "")),
        g["modelVersion"],
        g["usageMetadata"],
        g["usageMetadata"]["promptTokenCount"],
        g["usageMetadata"]["candidatesTokenCount"],
        candidate["finishReason"],
        F.transform(
            F.filter(parts, lambda p: p["functionCall"].isNotNull()),
            lambda p, i: F.struct(
                F.concat(F.lit("gemini-"), F.col("response_id").cast("string"), F.lit("-"), i.cast("string")).alias("id"),
                _blank(p["functionCall"]["name"]).alias("name"),
                F.coalesce(p["functionCall"]["args"], F.lit("{}")).alias("input"),
            ),
        ),
    )
    parsed = F.when(F.col("provider") == "anthropic", anthropic).when(F.col("provider") == "gemini", gemini).otherwise(openai)
    return logs.select("response_id", "provider", parsed.alias("r")).select("response_id", "provider", "r.*")


def usage_by_model(responses: DataFrame) -> DataFrame:
    return responses.groupBy("provider", "model").agg(
        F.count("*").alias("responses"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


# --- stream logs -----------------------------------------------------------------------------

_BLOCK = 4096  # lines


def _found_token(payload: Column) -> Column:
    """An event's token, null where it has none. The whole event is parsed for it, so where one is found the event is JSON."""
    anthropic = F.when(F.get_json_object(payload, "$.type") == "content_block_delta", F.get_json_object(payload, "$.delta.text"))
    gemini = F.get_json_object(payload, "$.candidates[0].content.parts[0].text")
    openai = F.get_json_object(payload, "$.choices[0].delta.content")
    return F.when(F.col("provider") == "anthropic", anthropic).when(F.col("provider") == "gemini", gemini).otherwise(openai)


def _judged(events: DataFrame) -> DataFrame:
    """Add ``t``, the token of a whole event, and ``torn``: each from a column of its own, so that no event is parsed twice for one answer."""
    payload = F.col("_payload")
    parsed = events.withColumn("_may", _may_be_json(payload)).withColumn("t", F.when(F.col("_may"), _found_token(payload)))
    return parsed.withColumn("torn", payload.isNotNull() & F.col("t").isNull() & (~F.col("_may") | ~_is_json(payload)))


def _pick_token(event: dict, provider: str) -> str:
    try:
        if provider == "anthropic":
            return (event["delta"].get("text") or "") if event.get("type") == "content_block_delta" else ""
        if provider == "gemini":
            return event["candidates"][0]["content"]["parts"][0].get("text") or ""
        return event["choices"][0]["delta"].get("content") or ""
    except (KeyError, IndexError, TypeError, AttributeError):
        return ""


_MARKS = re.compile(r'\\.?|["{}\[\]]', re.DOTALL)


class _Fragment:
    """The text of an event that arrives in pieces; every character is looked at once."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.depth, self.quoted, self.escaped = 0, False, False

    def add(self, piece: str) -> bool:
        """Take a piece; whether all brackets and quotes are closed now."""
        self.pieces.append(piece)
        start = 1 if self.escaped and piece else 0
        self.escaped = self.escaped and not piece
        for mark in _MARKS.finditer(piece, start):
            found = mark.group()
            if found == "\\":
                self.escaped = True
            elif self.quoted:
                self.quoted = found != '"'
            elif found == '"':
                self.quoted = True
            elif found in "{[":
                self.depth += 1
            elif found in "}]":
                self.depth -= 1
        return self.depth <= 0 and not self.quoted and not self.escaped


def _glue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(response_id, line_no, t): tokens of events in pieces. The lines of a stretch arrive in order.

    An event starts at a ``data:`` line with an opening brace and is read when its brackets are closed. If it is not
    JSON then, it is lost, and so is one that the stretch leaves open. Only the event at hand is held.
    """
    stretch, held = None, None
    for batch in batches:
        rows = []
        columns = ("response_id", "_stretch", "provider", "line_no", "line")
        for rid, part, provider, line_no, line in zip(*[batch[c] for c in columns]):
            if (rid, part) != stretch:
                stretch, held = (rid, part), None
            is_data = line.startswith("data: ")
            piece = line[6:] if is_data else line
            if held is None:
                if not is_data or not piece.lstrip().startswith("{"):
                    continue
                held = _Fragment()
            if held.add(piece):
                text, held = "".join(held.pieces), None
                try:
                    token = _pick_token(json.loads(text), provider)
                except ValueError:
                    continue
                rows.append((rid, line_no, token))
        yield pd.DataFrame(rows, columns=["response_id", "line_no", "t"])


def _stretches(events: DataFrame) -> DataFrame:
    """Add ``_stretch``: the number of whole events before and at a line of its response.

    Counted within blocks of lines and then over the blocks, so no window holds more than a block's lines or a
    response's blocks.
    """
    lines = events.withColumn("_block", F.floor(F.col("line_no") / _BLOCK))
    whole = F.col("whole").cast("long")
    blocks = lines.groupBy("response_id", "_block").agg(F.sum(whole).alias("_n"))
    before = Window.partitionBy("response_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("response_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("response_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("_inside", F.sum(whole).over(inside))
        .join(offsets, ["response_id", "_block"])
        .withColumn("_stretch", F.col("_before") + F.col("_inside"))
    )


def _joined_tokens(tokens: DataFrame, *more: Column) -> DataFrame:
    """(response_id, content, more) of (response_id, line_no, t): blocks of lines are joined, then the blocks, so a very
    long response is built by many tasks."""
    # Lines without a token leave no entry in the lists: collect_list skips nulls.
    entry = lambda order: F.when(F.coalesce("t", F.lit("")) != "", F.struct(order, "t"))
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(entry(order))), lambda x: x["t"]), "")
    blocks = tokens.groupBy("response_id", F.floor(F.col("line_no") / _BLOCK).alias("block")).agg(text("line_no").alias("t"), *more)
    return blocks.groupBy("response_id").agg(text("block").alias("content"), *more)


def sse_reassemble(lines: DataFrame) -> DataFrame:
    """(response_id, content) from stream log lines (response_id, provider, line_no, line).

    A log whose ``data:`` lines all hold complete JSON is handled line by line with built-ins. Another is
    cut at its whole events, which end whatever was left open before them; only the stretches between them that
    hold a torn line go to Python, each a group of its own. So a long response is repaired by many tasks,
    in time linear in its text, and a lost fragment costs no more than its stretch.
    """
    trimmed = lines.withColumn("line", js_trim("line"))
    is_data = F.startswith(F.col("line"), F.lit("data: ")) & (F.col("line") != "data: [DONE]")
    events = trimmed.withColumn("_payload", F.when(is_data, F.substring("line", 7, 1 << 30)))
    read = _judged(events).select("response_id", "line_no", "t", "torn")
    done = stage(_joined_tokens(read, F.max("torn").alias("torn")))
    broken = checked(done.where("torn").select("response_id"))

    event_key = F.when(F.col("provider") == "anthropic", "type").when(F.col("provider") == "gemini", "candidates").otherwise("choices")
    keys = F.when(~F.col("torn"), F.json_object_keys("_payload"))
    whole = F.coalesce(F.array_contains(keys, event_key), F.lit(False))
    again = _judged(events.where(F.col("line") != "data: [DONE]").join(broken, "response_id", "left_semi")).withColumn("whole", whole)
    rest = F.when(~F.col("whole"), F.col("line")).alias("line")
    cut = stage(again.select("response_id", "provider", "line_no", rest, "t", "torn", "whole"))  # read twice below
    parts = stage(_stretches(cut).select("response_id", "provider", "line_no", "line", "t", "torn", "whole", "_stretch"))
    to_glue = parts.where("torn").select("response_id", "_stretch").distinct()
    between = parts.where(~F.col("whole"))
    glued = (
        between.join(to_glue, ["response_id", "_stretch"], "left_semi")
        .select("response_id", "_stretch", "provider", "line_no", "line")
        .repartition("response_id", "_stretch")
        .sortWithinPartitions("response_id", "_stretch", "line_no")
        .mapInPandas(_glue, lines.select("response_id", "line_no", F.lit("").alias("t")).schema)
    )
    alone = parts.where("whole").unionByName(between.join(to_glue, ["response_id", "_stretch"], "left_anti"))
    nothing = broken.select("response_id", F.lit(0).cast(lines.schema["line_no"].dataType).alias("line_no"), F.lit("").alias("t"))
    found = alone.select("response_id", "line_no", "t").unionByName(glued).unionByName(nothing)
    return done.where(~F.col("torn")).select("response_id", "content").unionByName(_joined_tokens(found))


# --- requests --------------------------------------------------------------------------------

_REASONING = r"(?i)^(o[1-9]|gpt-5)"  # fixed pattern: models with another limit name and no temperature


def request_payloads(requests: DataFrame, messages: DataFrame, tools: str | None = None) -> DataFrame:
    """(request_id, provider, body): JSON request bodies for a batch file; nothing is sent.

    ``requests``: request_id, provider, model, system_prompt, temperature, max_tokens, stream (nullable);
    ``messages``: request_id, turn, role, content; ``tools``: a JSON array of {name, description,
    input_schema} offered in every request. One request's messages form one JSON document, so
    gathering them per request is the output itself.
    """
    turns = messages.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    full = requests.join(turns, "request_id", "left").withColumn(
        "turns", F.coalesce("turns", F.array().cast(turns.schema["turns"].dataType))
    )
    has_system = F.coalesce("system_prompt", F.lit("")) != ""
    no_system = F.filter("turns", lambda m: m["role"] != "system")
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    system = F.when(has_system, F.array(message(F.lit("system"), F.col("system_prompt"))))
    no_message = F.array().cast("array<struct<role:string,content:string>>")
    chat = F.concat(F.coalesce(system, no_message), F.transform("turns", lambda m: message(m["role"], m["content"])))
    reasoning = F.col("model").rlike(_REASONING) & (F.col("provider") == "openai")
    stream = F.when(F.col("stream"), F.lit(True))
    offered = json.loads(tools) if tools else []
    with_tools = lambda text, field, value: F.concat(
        F.substring(text, F.lit(1), F.char_length(text) - 1), F.lit(f',"{field}":{json.dumps(value, ensure_ascii=False)}}}')
    )

    openai = F.to_json(
        F.struct(
            F.col("model"),
            chat.alias("messages"),
            F.when(~reasoning, F.col("temperature")).alias("temperature"),
            F.when(~reasoning, F.col("max_tokens")).alias("max_tokens"),
            F.when(reasoning, F.col("max_tokens")).alias("max_completion_tokens"),
            stream.alias("stream"),
        )
    )
    anthropic = F.to_json(
        F.struct(
            F.col("model"),
            F.transform(no_system, lambda m: message(m["role"], m["content"])).alias("messages"),
            F.when(F.coalesce("max_tokens", F.lit(0)) > 0, F.col("max_tokens")).otherwise(4096).alias("max_tokens"),
            F.when(has_system, F.col("system_prompt")).alias("system"),
            F.col("temperature"),
            stream.alias("stream"),
        )
    )
    said = lambda text: F.array(F.struct(text.alias("text")))
    config = F.struct(F.col("temperature").alias("temperature"), F.col("max_tokens").alias("maxOutputTokens"))
    gemini = F.to_json(
        F.struct(
            F.transform(
                no_system, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), said(m["content"]).alias("parts"))
            ).alias("contents"),
            F.when(has_system, F.struct(said(F.col("system_prompt")).alias("parts"))).alias("systemInstruction"),
            F.when(F.col("temperature").isNotNull() | F.col("max_tokens").isNotNull(), config).alias("generationConfig"),
        )
    )
    if offered:
        functions = [{"name": x["name"], "description": x["description"], "parameters": x["input_schema"]} for x in offered]
        # Only some providers accept tool definitions.
        wrapped = with_tools(openai, "tools", [{"type": "function", "function": f} for f in functions])
        openai = F.when(F.col("provider").isin("ollama", "custom"), openai).otherwise(wrapped)
        anthropic = with_tools(anthropic, "tools", offered)
        gemini = with_tools(gemini, "tools", [{"functionDeclarations": functions}])
    body = F.when(F.col("provider") == "anthropic", anthropic).when(F.col("provider") == "gemini", gemini).otherwise(openai)
    return full.select("request_id", "provider", body.alias("body"))
