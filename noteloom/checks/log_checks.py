"""Registered queries: conversations, tool tags, responses, stream logs, diffs, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.checks import sqltext as S
from noteloom.checks import tables as X
from noteloom.operators import chatlog, context, diff, responses
from noteloom.operators.embedding import batch_complete as run_completions
from noteloom.runtime import spread, stage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _messages(spark, sf):
    return X.messages(spark, sf).withColumn("ts", F.col("conv_id") * 60000 + F.col("turn") * 1000)


_MSG = "msg as (select conv_id, turn, role, text as content, (conv_id * 60000 + turn * 1000)::bigint as ts from conversations)"
_INDEX = f"""select conv_id, coalesce({S.title("arg_min(content, turn) filter (where role = 'user')")}, 'New chat') as title, count(*)::bigint as message_count,
 arg_min(ts, turn) as created_at, max(ts) as updated_at from msg"""


@query(f"with {_MSG} {_INDEX} group by conv_id")
def conversation_index(spark, sf):
    return chatlog.conversation_index(_messages(spark, sf))


@query(f"with {_MSG} {_INDEX} where conv_id not in (select conv_id from msg where role = 'system') group by conv_id")
def conversation_list(spark, sf):
    """Conversations with a system message count as deleted."""
    m = _messages(spark, sf)
    return chatlog.conversation_list(m, m.where("role = 'system'").select("conv_id").distinct())


@query(f"with {_MSG} select conv_id, turn, role, content from msg where role <> 'system'")
def chat_history(spark, sf):
    return chatlog.chat_history(_messages(spark, sf))


@query(f"with {_MSG} select conv_id, max(turn) as turn, arg_max(content, turn) as content from msg where role = 'assistant' group by conv_id")
def last_assistant(spark, sf):
    return chatlog.last_assistant(_messages(spark, sf))


@query(
    f"with {_MSG}, cut as (select conv_id, max(turn) filter (where role = 'user') as c from msg group by conv_id) "
    "select conv_id, turn, role, content from msg join cut using (conv_id) where c is null or turn < c"
)
def truncate_last_user(spark, sf):
    return chatlog.truncate_last_user(_messages(spark, sf)).select("conv_id", "turn", "role", "content")


@query(f"with {_MSG} select conv_id, sum({S.est_tokens('content')})::bigint as tokens, sum({S.est_tokens('content')}) <= 300 as within_limit from msg group by conv_id")
def context_tokens(spark, sf):
    return context.context_tokens(_messages(spark, sf), "conv_id", "content", 300)


_TAGGED = """content || ' <vault_read> src' || turn || '/a.md </vault_read>' || chr(10) || '<vault_write  path="notes/' || conv_id || '.md">' || chr(10) || content || chr(10) || '</vault_write> end'"""


def _tagged(spark, sf):
    return _messages(spark, sf).withColumn("content", F.expr(_TAGGED))


@query(
    f"""with {_MSG} select conv_id, turn, 'read' as op, 0::bigint as pos, 'src' || turn || '/a.md' as path, null::varchar as content from msg
    union all select conv_id, turn, 'write', 0, 'notes/' || conv_id || '.md', {S.trim('content')} from msg"""
)
def extract_tool_tags(spark, sf):
    return chatlog.tool_tags(_tagged(spark, sf), ["conv_id", "turn"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"with {_MSG} select conv_id, turn, {S.trim('content || chr(32) || chr(10) || chr(32) || chr(101) || chr(110) || chr(100)')} as content from msg")
def strip_tool_tags(spark, sf):
    return _tagged(spark, sf).select("conv_id", "turn", chatlog.strip_tool_tags("content").alias("content"))


@query(
    f"""with {_MSG} select conv_id, turn, {S.rtrim("case turn % 4 when 1 then content || ' ' when 2 then content || ' done' else content end")} as content from msg"""
)
def clean_truncated_response(spark, sf):
    """Four kinds of cut: inside a write tag, inside a tag's first letters, after a read tag, none."""
    cut = F.expr(
        """case turn % 4 when 0 then content || '<vault_write path="a.md">' || content when 1 then content || ' <vau'
        when 2 then content || '<vault_read>a.md</vault_read> done  ' else content end"""
    )
    return _messages(spark, sf).select("conv_id", "turn", chatlog.clean_truncated(cut).alias("content"))


_ACTION = "case lang when 'en' then 'translate-ja' when 'fr' then 'translate-en' when 'de' then 'summarize' else 'explain' end"
_TEMPLATES = {"summarize": "Sum up: ", "translate-en": "In English: ", "translate-ja": "In Japanese: ", "explain": "What is this? "}
_TEMPLATE = "case a " + " ".join(f"when '{k}' then '{v}'" for k, v in _TEMPLATES.items()) + " end"


@query(f"select doc_id, a as action_id, {_TEMPLATE} || text as prompt from (select *, {_ACTION} as a from documents)")
def apply_prompt_template(spark, sf):
    templates = spark.createDataFrame(list(_TEMPLATES.items()), "action_id string, template string")
    requests = X.table(spark, sf, "documents").select("doc_id", "text", F.expr(_ACTION).alias("action_id"))
    return context.apply_templates(requests, templates).select("doc_id", "action_id", "prompt")


# --- responses -------------------------------------------------------------------------------


def _json(c):
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2)


def response_logs(spark, sf):
    """Assistant messages as provider responses: a text, a tool call, and noise to be skipped."""
    m = X.messages(spark, sf).where("role = 'assistant'").withColumn("j", _json(F.col("content"))).withColumn("n", F.char_length("content"))
    openai = F.format_string(
        '{"model":"gpt-4o","usage":{"prompt_tokens":%d,"completion_tokens":%d},"choices":[{"finish_reason":"stop","message":{"content":%s,"tool_calls":['
        '{"id":"c%d","type":"function","function":{"name":"vault_read","arguments":"{\\"path\\":\\"a.md\\"}"}},'
        '{"id":"bad","type":"function","function":{"name":"vault_list","arguments":"{oops"}}]}}]}',
        "n", "turn", "j", "conv_id",
    )
    anthropic = F.format_string(
        '{"model":"claude","stop_reason":"end_turn","usage":{"input_tokens":%d,"output_tokens":%d},"content":[{"type":"text","text":%s},'
        '{"type":"tool_use","id":"c%d","name":"vault_read","input":{"path":"a.md"}},{"type":"text","text":"!"}]}',
        "n", "turn", "j", "conv_id",
    )
    gemini = F.format_string(
        '{"modelVersion":"gemini","usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":%d},"candidates":[{"finishReason":"STOP","content":{"parts":['
        '{"text":"hidden","thought":true},{"text":%s},{"functionCall":{"name":"vault_read","args":{"path":"a.md"}}}]}}]}',
        "n", "turn", "j",
    )
    provider = F.expr("case conv_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'gemini' end")
    body = F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).otherwise(gemini)
    return m.select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), provider.alias("provider"), body.alias("body"))


_RESPONSES = """resp as (select conv_id || '-' || turn as response_id, case conv_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'gemini' end as provider,
 case conv_id % 3 when 1 then text || '!' else text end as content, case conv_id % 3 when 0 then 'gpt-4o' when 1 then 'claude' else 'gemini' end as model,
 length(text)::bigint as input_tokens, turn as output_tokens, case conv_id % 3 when 0 then 'stop' when 1 then 'end_turn' else 'STOP' end as finish_reason,
 case conv_id % 3 when 2 then 'gemini-' || conv_id || '-' || turn || '-0' else 'c' || conv_id end as tool_id from conversations where role = 'assistant')"""


@query(f"""with {_RESPONSES} select *, 'vault_read' as tool_name, '{{"path":"a.md"}}' as tool_input from resp""")
def normalize_responses(spark, sf):
    r = responses.normalize_responses(response_logs(spark, sf))
    use = F.col("u")
    return r.select("*", F.explode_outer("tool_uses").alias("u")).select(
        "response_id", "provider", "content", "model", "input_tokens", "output_tokens", "finish_reason",
        use["id"].alias("tool_id"), use["name"].alias("tool_name"), use["input"].alias("tool_input"),
    )


@query(
    f"with {_RESPONSES} select provider, model, count(*)::bigint as responses, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from resp group by all"
)
def llm_usage(spark, sf):
    return responses.usage_by_model(responses.normalize_responses(response_logs(spark, sf)))


def sse_lines(spark, sf):
    """Assistant messages as stream logs, one word per event; every fifth conversation has its events torn in two."""
    m = X.messages(spark, sf).where("role = 'assistant'").withColumn("words", F.split("content", " ", -1))
    provider = F.expr("case conv_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'gemini' end")
    word = F.when(F.col("pos") < F.size("words") - 1, F.concat("w", F.lit(" "))).otherwise(F.col("w"))
    ev = m.select("conv_id", "turn", "words", provider.alias("provider"), F.posexplode("words").alias("pos", "w")).withColumn("j", _json(word))
    payload = (
        F.when(F.col("provider") == "openai", F.concat(F.lit('{"choices":[{"delta":{"content":'), "j", F.lit("}}]}")))
        .when(F.col("provider") == "anthropic", F.concat(F.lit('{"type":"content_block_delta","delta":{"text":'), "j", F.lit("}}")))
        .otherwise(F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), "j", F.lit("}]}}]}")))
    )
    second = F.concat(F.when(F.col("turn") % 4 == 1, "data: ").otherwise(""), F.substring(payload, F.lit(16), F.char_length(payload)))
    torn = F.array(F.concat(F.lit("data: "), F.substring(payload, 1, 15)), second)
    plain = F.array(F.concat(F.lit("data: "), payload), F.when(F.col("pos") == F.size("words") - 1, "data: [DONE]").otherwise(""))
    lines = F.when(F.col("conv_id") % 5 == 0, torn).otherwise(plain)
    return ev.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), "provider", F.col("pos").alias("_p"), F.posexplode(lines).alias("_q", "line")
    ).select("response_id", "provider", (F.col("_p") * 2 + F.col("_q")).alias("line_no"), "line")


@query("select conv_id || '-' || turn as response_id, text as content from conversations where role = 'assistant'")
def sse_reassemble(spark, sf):
    return responses.sse_reassemble(stage(spread(sse_lines(spark, sf))))


_PAYLOAD = """with m as (select conv_id, list(struct_pack("role" := role, content := text) order by turn) as all_m,
   list(struct_pack("role" := role, content := text) order by turn) filter (where role <> 'system') as user_m,
   list(struct_pack("role" := case when role = 'assistant' then 'model' else 'user' end, parts := [struct_pack("text" := text)]) order by turn) filter (where role <> 'system') as g_m
  from conversations group by conv_id)
select conv_id as request_id, case conv_id % 4 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'gemini' else 'openai' end as provider,
 case conv_id % 4
  when 0 then to_json(struct_pack(model := 'gpt-4o', messages := list_concat([struct_pack("role" := 'system', content := 'Be brief.')], all_m), temperature := 0.5::double, max_tokens := 1000))
  when 1 then to_json(struct_pack(model := 'claude', messages := user_m, max_tokens := 1000, system := 'Be brief.', temperature := 0.5::double))
  when 2 then to_json(struct_pack(contents := g_m, systemInstruction := struct_pack(parts := [struct_pack("text" := 'Be brief.')]), generationConfig := struct_pack(temperature := 0.5::double, maxOutputTokens := 1000)))
  else to_json(struct_pack(model := 'gpt-5-mini', messages := list_concat([struct_pack("role" := 'system', content := 'Be brief.')], all_m), max_completion_tokens := 1000)) end::varchar as body from m"""


@query(_PAYLOAD)
def build_request_payloads(spark, sf):
    m = X.messages(spark, sf).withColumnRenamed("conv_id", "request_id")
    kind = F.col("request_id") % 4
    requests = m.select("request_id").distinct().select(
        "request_id",
        F.when(kind == 1, "anthropic").when(kind == 2, "gemini").otherwise("openai").alias("provider"),
        F.when(kind == 1, "claude").when(kind == 2, "gemini").when(kind == 3, "gpt-5-mini").otherwise("gpt-4o").alias("model"),
        F.lit("Be brief.").alias("system_prompt"),
        F.lit(0.5).alias("temperature"),
        F.lit(1000).alias("max_tokens"),
        F.lit(False).alias("stream"),
    )
    return responses.request_payloads(requests, m)


@query("select doc_id as request_id, 'Echo (' || length(p) || '): ' || p as content, 'ok' as status from (select doc_id, 'Please explain: ' || text as p from documents)")
def batch_complete(spark, sf):
    prompts = X.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.concat(F.lit("Please explain: "), "text").alias("prompt"))
    return run_completions(prompts, lambda p: f"Echo ({len(p)}): {p}")


# --- diffs -----------------------------------------------------------------------------------


def document_pairs(spark, sf):
    """Every document against itself with some words changed and its lines in other places broken."""
    new = F.regexp_replace(F.regexp_replace("text", r"\b(the|la|die|que)\b", "<$1>"), r", ", ",\n")
    return spread(X.table(spark, sf, "documents")).select("doc_id", F.col("text").alias("old_text"), new.alias("new_text"))


@query("select doc_id, sha256(text) as old_sha256, true as new_equal from documents")
def diff_rebuild(spark, sf):
    """Kept and removed lines give the old text, kept and added lines the new one, for every document."""
    pairs = document_pairs(spark, sf)
    lines = stage(diff.diff_lines(pairs, "doc_id"))

    def side(op):
        rows = F.sort_array(F.collect_list(F.when(F.col("op").isin("same", op), F.struct("seq", "line"))))
        return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")

    built = lines.groupBy("doc_id").agg(side("remove").alias("old"), side("add").alias("new"))
    joined = built.join(pairs.select("doc_id", "new_text"), "doc_id")
    return joined.select("doc_id", F.sha2("old", 256).alias("old_sha256"), (F.col("new") == F.col("new_text")).alias("new_equal"))


_EDIT = "replace(replace(content, 'Preamble for', 'Introduction to'), 'orders on file', 'orders archived')"


def note_pairs(spark, sf):
    return X.notes(spark, sf).select("path", F.col("content").alias("old_text"), F.expr(_EDIT).alias("new_text"))


@query(
    f"""{S.WITH_NOTES}, ln as (select path, unnest(string_split(content, chr(10))) as o, unnest(string_split({_EDIT}, chr(10))) as n,
      generate_subscripts(string_split(content, chr(10)), 1) - 1 as i from notes),
    ops as (select *, i + sum(case when o <> n then 1 else 0 end) over (partition by path order by i) - (o <> n)::int as seq from ln),
    d as (select path, seq, case when o = n then 'same' else 'remove' end as op, o as line from ops union all select path, seq + 1, 'add', n from ops where o <> n)
    select path, seq::bigint as seq, op, line from d"""
)
def diff_lines(spark, sf):
    rows = diff.diff_lines(note_pairs(spark, sf))
    return rows.select("path", F.col("seq").cast("long").alias("seq"), "op", "line")


@query(
    f"""{S.WITH_NOTES}, ln as (select path, unnest(string_split(content, chr(10))) as o, unnest(string_split({_EDIT}, chr(10))) as n,
      generate_subscripts(string_split(content, chr(10)), 1) - 1 as i from notes),
    ops as (select *, i + sum(case when o <> n then 1 else 0 end) over (partition by path order by i) - (o <> n)::int as seq from ln),
    d as (select path, seq, case when o = n then 'same' else 'remove' end as op, o as line from ops union all select path, seq + 1, 'add', n from ops where o <> n),
    ch as (select *, lag(seq) over (partition by path order by seq) as prev from d where op <> 'same'),
    g as (select *, sum(case when prev is null or seq - prev > 6 then 1 else 0 end) over (partition by path order by seq) - 1 as hunk_no from ch),
    sp as (select path, hunk_no, greatest(min(seq) - 3, 0) as f, max(seq) + 3 as l from g group by all)
    select sp.path, hunk_no::bigint as hunk_no, min(seq)::bigint as first_seq, max(seq)::bigint as last_seq,
      string_agg(line, chr(10) order by seq) filter (where op <> 'add') as old_text, string_agg(line, chr(10) order by seq) filter (where op <> 'remove') as new_text
    from sp join d on d.path = sp.path and d.seq between f and l group by sp.path, hunk_no"""
)
def diff_hunks(spark, sf):
    h = diff.diff_hunks(stage(diff.diff_lines(note_pairs(spark, sf))))
    longs = [F.col(c).cast("long").alias(c) for c in ("hunk_no", "first_seq", "last_seq")]
    return h.select("path", *longs, "old_text", "new_text")


@query(
    f"""{S.WITH_NOTES}, h as (select path, 'customer' as old_text, 'client $& \\1' as new_text from notes union all select path, 'orders on file', 'orders' from notes),
    x as (select *, strpos(content, old_text) as spot from h join notes using (path))
    select path, old_text, case when spot > 0 then substr(content, 1, spot - 1) || new_text || substr(content, spot + length(old_text)) else content end as content,
      case when spot > 0 then 'applied' else 'not_found' end as status from x"""
)
def apply_hunks(spark, sf):
    """Two edits per note: the first of several occurrences, with pattern characters in the new text."""
    notes = X.stored_notes(spark, sf)
    edits = F.array(
        F.struct(F.lit("customer").alias("old_text"), F.lit("client $& \\1").alias("new_text")),
        F.struct(F.lit("orders on file").alias("old_text"), F.lit("orders").alias("new_text")),
    )
    hunks = notes.select("path", F.explode(edits).alias("e")).select("path", "e.*")
    return diff.apply_hunks(notes, hunks).select("path", "old_text", "content", "status")


