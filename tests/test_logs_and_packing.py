import json
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.operators import chatlog, context, diff, embedding, packing, responses
from noteloom.operators.listing import list_notes, list_report, render_list, render_table, render_tasks
from noteloom.plans.views import note_views
from tests import models as m


def _pack(spark, sizes, budget, cap=None):
    rows = [("r", f"n{i}", s, i) for i, s in enumerate(sizes)]
    items = spark.createDataFrame(rows, "request string, path string, tokens int, pos int")
    return {r.path for r in packing.pack(items, "request", [F.asc("pos")], budget, cap).collect()}


def test_pack_examples(spark):
    assert _pack(spark, [9000, 15000, 8000, 4000], 20000, 5) == {"n0", "n2"}
    assert _pack(spark, [10] * 6, 20000, 5) == {f"n{i}" for i in range(5)}
    assert _pack(spark, [20000, 0], 20000, 5) == {"n0"}
    assert _pack(spark, [100000, 0, 1], 100000) == {"n0", "n1"}


def test_pack_matches_model(spark):
    rng = random.Random(7)
    for cap in (5, None):
        rows, want = [], {}
        for req in range(30):
            items = [(f"n{rng.randrange(25)}", rng.choice([0, 1, 3, 7, 40, 90, 120])) for _ in range(40)]
            size = dict(reversed(items))  # a path has one size: that of its first appearance
            items = [(k, size[k]) for k, _ in items]
            rows += [(req, k, s, i) for i, (k, s) in enumerate(items)]
            want[req] = set(m.pack(items, 150, cap))
        df = spark.createDataFrame(rows, "request int, path string, tokens int, pos int")
        got = {}
        picked = packing.pack(df, "request", [F.asc("pos")], 150, cap)
        for r in picked.collect():
            got.setdefault(r.request, set()).add(r.path)
        assert got == want
        left = {r.request: r.omitted for r in packing.omitted_counts(df, picked, "request").collect()}
        assert left == {q: len({k for a, k, _, _ in rows if a == q}) - len(p) for q, p in want.items()}


def test_diff_matches_model(spark):
    rng = random.Random(3)
    pairs = [("same\ntext", "same\ntext"), ("", ""), ("a", ""), ("a\nb\nc", "b\nc\nd"), ("x\nx\nx", "x\nx")]
    pairs += [("\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25))), "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))) for _ in range(60)]
    pairs.append(("\n".join(map(str, range(2001))), "p\nq"))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "path int, old_text string, new_text string")
    got = {}
    for r in diff.diff_lines(df).orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.op, r.line))
    for i, (a, b) in enumerate(pairs):
        assert got[i] == m.diff(a, b), (a, b)


def test_diffs_leave_the_worker_in_bounded_pieces():
    """One batch of many pairs and long lines gives all lines in order, never more at once than the bounds."""
    pairs = [(f"p{i}", "a\n" * 3000, "a\nb\n" * (2000 + i)) for i in range(8)] + [("wide", "w" * 3_000_000 + "\nx", "w" * 3_000_000 + "\ny\n" + "z" * 3_000_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs)], ["path", "old_text", "new_text"])
    sent = list(diff._sent_diffs(iter([batch]), "path"))
    assert max(b.num_rows for b in sent) <= diff.SEND_LINES and len(sent) > 4
    longest = 3_000_000
    assert all(sum(map(len, b.column("line").to_pylist())) < diff.SEND_CHARS + longest for b in sent)
    got = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    want = [(k, i, op, line) for k, old, new in pairs for i, (op, line) in enumerate(diff._line_ops(old.split("\n"), new.split("\n")))]
    assert got == want


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_line_ops_take_the_models_path(old, new):
    """Rows of bits choose the same one of several longest diffs as the full table, also where kept rows are computed again."""
    got = diff._line_ops([*old, "x"], [*new, "y"])
    assert got == m.diff("\n".join([*old, "x"]), "\n".join([*new, "y"]))


@pytest.mark.parametrize("kinds", [300, 10**9])
def test_long_diff_keeps_every_line(kinds):
    """50,000 lines a side: the kept and removed lines are the old text, the kept and added ones the new."""
    rng = random.Random(4)
    old = [f"l{rng.randrange(kinds)}" for _ in range(50_000)]
    new = [x for x in old if rng.random() > 0.1] + ["end"]
    ops = diff._line_ops(old, new)
    assert [x for op, x in ops if op != "add"] == old and [x for op, x in ops if op != "remove"] == new
    assert sum(op == "same" for op, _ in ops) == len(new) - 1


@pytest.mark.parametrize("gap,hunks", [(6, 1), (7, 2)])
def test_hunks_merge_by_gap(spark, gap, hunks):
    lines = [f"l{i}" for i in range(40)]
    new = list(lines)
    # the diff holds remove+add for the first change, so the distance is measured from its add line
    new[10] = "changed"
    new[10 + gap] = "changed too"
    df = spark.createDataFrame([("p", "\n".join(lines), "\n".join(new))], "path string, old_text string, new_text string")
    found = diff.diff_hunks(diff.diff_lines(df)).orderBy("hunk_no").collect()
    assert len(found) == hunks
    notes = spark.createDataFrame([("p", "\n".join(lines))], "path string, content string")
    todo = spark.createDataFrame([(h.path, h.hunk_no, h.old_text, h.new_text) for h in found], "path string, hunk_no int, old_text string, new_text string")
    for h in diff.apply_hunks(notes, todo).collect():
        assert h.status == "applied"
        back = diff.apply_hunks(spark.createDataFrame([("p", h.content)], "path string, content string"), todo.where(F.col("hunk_no") == h.hunk_no), revert=True).first()
        assert back.status == "reverted" and back.content == "\n".join(lines)


def test_hunk_text_is_literal(spark):
    notes = spark.createDataFrame([("p", "one two one")], "path string, content string")
    hunks = spark.createDataFrame([("p", "one", "$& $1"), ("p", "three", "x")], "path string, old_text string, new_text string")
    got = {r.old_text: (r.content, r.status) for r in diff.apply_hunks(notes, hunks).collect()}
    assert got == {"one": ("$& $1 two one", "applied"), "three": ("one two one", "not_found")}


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id string, turn int, role string, content string, ts long")


def test_conversations(spark):
    msgs = _messages(
        spark,
        [
            ("a", 0, "system", "sys", 5),
            ("a", 1, "user", "  " + "x" * 31, 10),
            ("a", 2, "assistant", "r1", 20),
            ("a", 3, "user", "again", 30),
            ("a", 4, "assistant", "r2", 40),
            ("b", 0, "assistant", "hello", 50),
        ],
    )
    index = {r.conv_id: r for r in chatlog.conversation_index(msgs).collect()}
    assert index["a"].title == "x" * 30 + "..." and index["b"].title == "New chat"
    assert (index["a"].message_count, index["a"].created_at, index["a"].updated_at) == (5, 5, 40)
    assert [r.conv_id for r in chatlog.conversation_list(msgs).collect()] == ["b", "a"]
    kept = chatlog.truncate_last_user(msgs).select("conv_id", "turn").collect()
    assert sorted(map(tuple, kept)) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    edits = spark.createDataFrame([("a", 1), ("a", 2)], "conv_id string, at_turn int")
    assert sorted(tuple(r)[:2] for r in chatlog.truncate_at(msgs, edits).collect()) == [("a", 0), ("b", 0)]
    assert {r.conv_id: r.content for r in chatlog.last_assistant(msgs).collect()} == {"a": "r2", "b": "hello"}


def test_tool_tags(spark):
    text = 'See <vault_read> a b.md </vault_read><vault_write path=" n.md ">\nline <b>\nx\n</vault_write> ok <vault_read>c</vault_read>'
    df = spark.createDataFrame([(1, text)], "id int, content string")
    rows = [tuple(r) for r in chatlog.tool_tags(df, ["id"]).orderBy("op", "pos").collect()]
    assert rows == [(1, "read", 0, "a b.md", None), (1, "read", 1, "c", None), (1, "write", 0, "n.md", "line <b>\nx")]
    assert df.select(chatlog.strip_tool_tags("content")).first()[0] == "See  ok"
    cut = spark.createDataFrame([("hi <vault_write path=\"a\">x",), ("hi <vau",), ("hi <v",), ("hi <",), ("a <vault_read></vault_read> b \n",)], "t string")
    assert [r[0] for r in cut.select(chatlog.clean_truncated("t")).collect()] == ["hi", "hi", "hi", "hi <", "a  b"]


def test_responses(spark):
    bodies = [
        ("1", "openai", {"choices": [{"message": {"content": None}}]}),
        ("2", "openrouter", {"model": "m", "usage": {"prompt_tokens": 3}, "choices": [{"finish_reason": "stop", "message": {"content": "hi", "tool_calls": [{"id": "t", "function": {"name": "f", "arguments": ""}}, {"id": "u", "function": {"name": "g", "arguments": "{bad"}}]}}]}),
        ("3", "anthropic", {"model": "c", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "i", "name": "n", "input": {"p": [1, 2]}}, {"type": "text", "text": "b"}]}),
        ("4", "gemini", {"candidates": [{"content": {"parts": [{"text": "no", "thought": True}, {"text": "yes"}, {"functionCall": {"name": "z"}}]}}]}),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(b)) for i, p, b in bodies], "response_id string, provider string, body string")
    r = {x.response_id: x for x in responses.normalize_responses(df).collect()}
    assert r["1"].content == "" and r["1"].input_tokens is None and r["1"].tool_uses == []
    assert (r["2"].content, r["2"].input_tokens, r["2"].output_tokens) == ("hi", 3, 0)
    assert [(u.id, u.input) for u in r["2"].tool_uses] == [("t", "{}")]
    assert r["3"].content == "ab" and json.loads(r["3"].tool_uses[0].input) == {"p": [1, 2]}
    assert r["4"].content == "yes" and r["4"].tool_uses[0].name == "z" and r["4"].tool_uses[0].input == "{}"


def test_stream_logs(spark):
    def ev(t):
        return json.dumps({"choices": [{"delta": {"content": t}}]})

    whole = ev("broken")
    logs = {
        "plain": ["data: " + ev("a "), "", "data: " + ev("b"), ": ping", "data: [DONE]"],
        "torn": ["data: " + whole[:20], whole[20:30], "data: " + whole[30:], "data: " + ev("!")],
        "lost": ["data: " + whole[:20]],
        "empty": ["event: x"],
    }
    rows = [(k, "openai", i, line) for k, ls in logs.items() for i, line in enumerate(ls)]
    df = spark.createDataFrame(rows, "response_id string, provider string, line_no int, line string")
    got = {r.response_id: r.content for r in responses.sse_reassemble(df).collect()}
    assert got == {"plain": "a b", "torn": "broken!", "lost": "", "empty": ""}


def _read_stream(logs):
    """Plain model: whole events end what is open; an event in pieces is read when its brackets close, or lost."""
    out, held = "", ""

    def token(text):
        event = json.loads(text)
        try:
            return event["choices"][0]["delta"]["content"]
        except (KeyError, IndexError):
            return ""

    def closed(text):
        depth, quoted, skip = 0, False, False
        for ch in text:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = not quoted
            elif not quoted:
                depth += (ch in "{[") - (ch in "}]")
        return depth <= 0 and not quoted and not skip

    for line in logs:
        data = line.startswith("data: ")
        text = line[6:] if data else line
        try:
            event = json.loads(text)
            whole = data and isinstance(event, dict) and "choices" in event
        except ValueError:
            whole = False
        if whole:
            held, out = "", out + token(text)
        elif held or (data and text.startswith("{")):
            held += text
            if closed(held):
                try:
                    out += token(held)
                except ValueError:
                    pass
                held = ""
    return out


def test_torn_stream_logs_match_model(spark, monkeypatch):
    """Events torn anywhere, also within escapes and in many pieces, lost heads, tails and middles; blocks of 4 lines."""
    monkeypatch.setattr(responses, "_BLOCK", 4)
    rng = random.Random(8)
    logs = {}
    for n in range(120):
        lines = []
        for _ in range(rng.randrange(1, 14)):
            said = "".join(rng.choice(['a', '"', "\\", "{", "]", "é", "\n", "b"]) for _ in range(rng.randrange(1, 6)))
            event = json.dumps({"choices": [{"delta": {"content": said}}]}, ensure_ascii=rng.random() < 0.5)
            if rng.random() < 0.5:
                pieces = ["data: " + event]
            else:
                at = sorted(rng.sample(range(1, len(event)), rng.randrange(1, 4)))
                pieces = [event[i:j] for i, j in zip([0, *at], [*at, len(event)])]
                pieces = ["data: " + pieces[0]] + [rng.choice(["", "data: "]) + p for p in pieces[1:]]
                if rng.random() < 0.3:
                    del pieces[rng.randrange(len(pieces))]
            lines += pieces + rng.choice([[], [""], [": ping"], ['data: {"other":1}'], ["data: nonsense"]])
        # pieces with white space at their ends are trimmed like any line: both sides see trimmed lines
        logs[f"r{n}"] = [line.strip() for line in lines]
    rows = [(k, "openai", i, line) for k, ls in logs.items() for i, line in enumerate(ls)]
    df = spark.createDataFrame(rows, "response_id string, provider string, line_no int, line string")
    got = {r.response_id: r.content for r in responses.sse_reassemble(df).collect()}
    assert got == {k: _read_stream(ls) for k, ls in logs.items()}


def test_torn_responses_are_cut_at_whole_events(spark):
    """A long response is dealt in stretches; gluing looks at every character once, also for an event in 20,000 pieces."""
    event = json.dumps({"choices": [{"delta": {"content": "x" * 200_000}}]})
    rows = [("r", "openai", i, ("data: " if i == 0 else "") + event[10 * i : 10 * i + 10]) for i in range(len(event) // 10 + 1)]
    rows += [("r", "openai", len(rows) + i, line) for i, line in enumerate(['data: {"choices":[]}', 'data: {"cho', 'ices":[{"delta":{"content":"y"}}]}'])]
    df = spark.createDataFrame(rows, "response_id string, provider string, line_no int, line string")
    whole = df.withColumn("whole", F.expr("line = 'data: {\"choices\":[]}'"))
    assert responses._stretches(whole).select("_stretch").distinct().count() == 2
    assert responses.sse_reassemble(df).first().content == "x" * 200_000 + "y"


def test_request_payloads(spark):
    reqs = [
        ("a", "openai", "o3-mini", "sys", 0.2, 10, True),
        ("b", "openai", "gpt-4o", None, 0.2, None, False),
        ("c", "anthropic", "claude", "sys", None, None, False),
        ("d", "gemini", "g", None, None, None, False),
        ("e", "ollama", "gpt-5-x", None, 0.1, 5, False),
    ]
    df = spark.createDataFrame(reqs, "request_id string, provider string, model string, system_prompt string, temperature double, max_tokens int, stream boolean")
    msgs = spark.createDataFrame([(r[0], i, role, f"m{i}") for r in reqs for i, role in enumerate(["system", "user", "assistant"])], "request_id string, turn int, role string, content string")
    tools = json.dumps([{"name": "f", "description": "d", "input_schema": {"type": "object"}}])
    plain = {r.request_id: json.loads(r.body) for r in responses.request_payloads(df, msgs).collect()}
    assert plain["a"]["max_completion_tokens"] == 10 and "temperature" not in plain["a"] and plain["a"]["stream"] is True
    assert [x["role"] for x in plain["a"]["messages"]] == ["system", "system", "user", "assistant"]
    assert plain["b"]["temperature"] == 0.2 and "max_tokens" not in plain["b"] and "stream" not in plain["b"]
    assert plain["c"]["max_tokens"] == 4096 and plain["c"]["system"] == "sys" and len(plain["c"]["messages"]) == 2
    assert plain["d"] == {"contents": [{"role": "user", "parts": [{"text": "m1"}]}, {"role": "model", "parts": [{"text": "m2"}]}]}
    assert plain["e"]["max_tokens"] == 5 and plain["e"]["temperature"] == 0.1
    tooled = {r.request_id: json.loads(r.body) for r in responses.request_payloads(df, msgs, tools).collect()}
    assert tooled["b"]["tools"][0]["function"]["parameters"] == {"type": "object"}
    assert tooled["c"]["tools"][0]["input_schema"] == {"type": "object"}
    assert tooled["d"]["tools"][0]["functionDeclarations"][0]["name"] == "f" and "tools" not in tooled["e"]


def test_embedding_failures_and_retries(spark):
    calls, pauses = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) == 1:
            raise embedding.RateLimited
        if len(calls) == 2:
            raise embedding.ServerFailure
        return x * 2

    assert embedding.with_retry(flaky, 4, pause=pauses.append) == 8 and pauses == [1.0, 1.0]
    with pytest.raises(ZeroDivisionError):
        embedding.with_retry(lambda _: 1 / 0, 1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(x))] for x in texts], len(texts)

    chunks = spark.createDataFrame([(f"c{i}", "bad" if i == 3 else "x" * i) for i in range(10)], "chunk_id string, content string").coalesce(1)
    out = embedding.embed_chunks(chunks, embed, "p", "m", batch=2).collect()
    assert {r.chunk_id for r in out if r.status == "failed"} == {"c2", "c3"}
    assert all(r.embedding is None for r in out if r.status == "failed")
    assert sum(r.tokens for r in out) == 8


def test_vector_key_is_provider_model_width(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    vectors = spark.createDataFrame([("a", "p", "m", 3), ("b", "p", "m", 2), ("b", "p", "other", 3)], "chunk_id string, provider string, model string, dims int")
    assert [r.chunk_id for r in embedding.pending_embeddings(chunks, vectors, "p", "m", 3).collect()] == ["b"]


def test_context_texts(spark):
    q = spark.createDataFrame([(1, "cats"), (2, "dogs")], "query_id int, text string")
    rows = [(1, "a.md", "a", None, "text a", 0.005, 3, 4, 2), (1, "b/c.md", "c", "H", "text c", 0.125, 0, 1, 1)]
    res = spark.createDataFrame(rows, "query_id int, path string, name string, heading string, content string, score double, start_line int, end_line int, rank int")
    got = {r.query_id: r.context for r in context.rag_context(res, q).collect()}
    assert got[2] == ""
    assert got[1].split("\n\n")[1:] == ["--- [[c]] > H (b/c.md, score: 0.13) ---\ntext c", "--- [[a]] (a.md, score: 0.01) ---\ntext a"]
    rep = {r.query_id: r.report for r in context.search_report(res, q).collect()}
    assert rep[2] == "No relevant notes found for: dogs"
    assert rep[1].startswith('Found 2 relevant sections for "cats":\n\n---\n\n### [[c]] > H\nPath: b/c.md | Score: 0.13 | Lines: 0-1\n\ntext c')


def _listing(spark):
    rows = [("a/one.md", 0), ("a/two.md", 1), ("a/b/three.md", 1023), ("a/b/four.MD", 1024), ("root.md", 102399), ("a/pic.png", 102400), ("z/big.md", 102400)]
    df = spark.createDataFrame([(p, p.rsplit(".", 1)[1], s) for p, s in rows], "path string, ext string, size long")
    return df.withColumn("mtime", F.timestamp_seconds(F.col("size") + 1_700_000_000).cast("timestamp_ntz"))


def test_listing(spark):
    notes = _listing(spark)
    paths = lambda **kw: [r.path for r in list_notes(notes, **kw).collect()]
    assert paths() == ["z/big.md", "root.md", "a/b/four.MD", "a/b/three.md", "a/two.md", "a/one.md"]
    assert paths(folder="a", recursive=False) == ["a/two.md", "a/one.md"]
    assert paths(folder="nowhere") == []
    assert paths(size_filter="empty") == ["a/one.md"] and paths(size_filter="large") == ["z/big.md"]
    assert paths(size_filter="small", include_folders=True) == ["a/b/three.md", "a/two.md"]
    assert paths(sort_by="name", extensions="png, MD") == ["z/big.md", "a/b/four.MD", "a/one.md", "a/pic.png", "root.md", "a/b/three.md", "a/two.md"]
    page = list_notes(notes, limit=2, offset=4, include_folders=True).collect()
    assert [(r.path, r.total, r.has_more) for r in page] == [("a/two.md", 9, True), ("a/one.md", 9, True)]
    assert paths(offset=50) == []
    report = list_report(notes, folder="a", recursive=False, include_folders=True).first().report.split("\n")
    assert report[0] == "Found 3 items total. Showing 3 items." and report[-1] == "a/b | folder | 2 items | -"
    assert list_report(notes, folder="none").first().report == "No files found matching the criteria."
    many = spark.range(300).select(F.concat(F.lit("f/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("md").alias("ext"), F.col("id").alias("size"), F.lit(None).cast("timestamp_ntz").alias("mtime"))
    assert list_notes(many, limit=500).count() == min(500, many.count())
    text = render_table(many, ["path", "size"], [("size", "asc")], cap=200).first().text.split("\n")
    assert len(text) == 203 and text[-1] == "... and 100 more rows"
    assert len(render_table(many, ["path", "size"], [("size", "asc")]).first().text.split("\n")) == many.count() + 2
    assert render_list(many.limit(0), "path", [("path", "asc")]).first().text == "(No results)"
    assert render_list(many.limit(2), "size", [("size", "desc")]).first().text.count("\n") == 1


def test_views(spark):
    notes = spark.createDataFrame([("a.md", "a", "---\ntags: [x, y]\n---\n- [ ] open\n  * [x] done [[b]]\n- [y] no")], "path string, name string, content string")
    v = note_views(notes)
    assert sorted(r.tag for r in v["tags"].collect()) == ["x", "y"]
    assert [(r.completed, r.text) for r in v["tasks"].orderBy("pos").collect()] == [(False, "open"), (True, "done [[b]]")]
    assert render_tasks(v["tasks"], [("pos", "asc")]).first().text == "- [ ] open\n- [x] done [[b]]"
    assert [r.target for r in v["links"].collect()] == ["b"]


def test_conversation_store(spark, tmp_path):
    from noteloom.sources import conversations as store

    a = {"id": "a", "title": "t", "provider": "p", "model": "m", "createdAt": 1, "updatedAt": 2, "messages": [{"role": "user", "content": "hé", "timestamp": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    heads, msgs = store.import_json(spark, str(tmp_path / "*.json"))
    assert [(r.conv_id, r.updated_at) for r in heads.collect()] == [("a", 2)]
    assert [tuple(r) for r in msgs.collect()] == [("a", 0, "user", "hé", 1)]
    new = _messages(spark, [("a", 0, "user", "new", 5), ("b", 0, "user", "b", 6)])
    both = store.replace_conversations(msgs, new)
    assert sorted(r.content for r in both.collect()) == ["b", "new"]
    ids = spark.createDataFrame([("a",), ("zz",)], "conv_id string")
    assert [r.conv_id for r in store.delete_conversations(both, ids).collect()] == ["b"]
    assert [r.conv_id for r in store.load_conversations(both, ids).collect()] == ["a"]


def test_query_embedding_and_model_width(spark):
    q = spark.createDataFrame([(1, "ab"), (2, "boom")], "query_id int, text string")

    def embed(texts):
        if "boom" in texts:
            raise RuntimeError
        return [[1.0]] * len(texts), 0

    assert [r.query_id for r in embedding.embed_queries(q.repartition(2, "query_id"), embed).collect()] in ([1], [])
    assert embedding.model_dims("text-embedding-3-large", compact=True) == 512 and embedding.model_dims("nomic-embed-text", True) == 768
    vectors = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    assert [r.v for r in embedding.vectors_for(vectors, spark.createDataFrame([("b",), ("c",)], "chunk_id string")).collect()] == [2]


def test_retriever_hybrid_fallback(spark):
    from noteloom.operators.chunking import chunk_documents
    from noteloom.plans.retriever import Retriever

    notes = spark.createDataFrame([(f"n{i}.md", f"n{i}", f"# T\n{w} text") for i, w in enumerate(["apple", "pear", "plum"])], "path string, name string, content string")
    chunks = chunk_documents(notes)
    vectors = spark.createDataFrame([("n1.md::0", [1.0, 0.0]), ("n2.md::0", [0.0, 1.0]), ("gone.md::0", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    r = Retriever.build(chunks, vectors=vectors)
    queries = spark.createDataFrame([(1, "apple"), (2, "apple")], "query_id int, text string")
    q_vectors = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<float>")
    rows = {(x.query_id, x.chunk_id): x for x in r.search(queries, 3, 0.1, query_vectors=q_vectors).collect()}
    assert rows[1, "n0.md::0"].match_type == "text" and rows[1, "n1.md::0"].match_type == "semantic"
    assert (1, "gone.md::0") not in rows and [k for k in rows if k[0] == 2] == [(2, "n0.md::0")]
    assert rows[2, "n0.md::0"].score > 0.3
    with pytest.raises(ValueError):
        r.search(queries, 0)


def test_tool_calls_with_repeated_keys_stay(spark):
    call = {"id": "c", "function": {"name": "f", "arguments": '{"a": 1, "a": 2}'}}
    broken = {"id": "d", "function": {"name": "g", "arguments": '{"a": 1, "a": 2'}}
    body = json.dumps({"choices": [{"message": {"content": "x", "tool_calls": [call, broken]}}]})
    got = responses.normalize_responses(spark.createDataFrame([("r", "openai", body)], "response_id string, provider string, body string")).first()
    assert [(t["name"], t["input"]) for t in got.tool_uses] == [("f", '{"a": 1, "a": 2}')]


def test_a_broken_fragment_does_not_swallow_the_rest(spark):
    event = lambda t: json.dumps({"choices": [{"delta": {"content": t}}]})
    torn = event("C")
    lines = ["data: " + event("A"), 'data: {"choices": [{"del', "data: " + event("B"), "data: " + torn[:20], torn[20:], "data: " + torn[:9], "data: " + torn[9:], "data: " + event("D")]
    rows = [("r", "openai", i, line) for i, line in enumerate(lines)]
    got = responses.sse_reassemble(spark.createDataFrame(rows, "response_id string, provider string, line_no int, line string")).collect()
    assert [(r.response_id, r.content) for r in got] == [("r", "ABCCD")]


def test_user_function_of_the_retry_query_travels_alone(spark, monkeypatch):
    import threading

    from pyspark import cloudpickle

    from noteloom.checks import index_checks, plan_checks

    for module in (index_checks, embedding):  # whatever lives in a module stays on the driver
        monkeypatch.setattr(module, "held", threading.RLock(), raising=False)
    assert len(cloudpickle.dumps(plan_checks.flaky_embedder)) < 20_000
    texts = spark.createDataFrame([("a", "xyz"), ("b", "1234567"), ("c", None), ("d", "xyz")], "chunk_id string, content string")
    done = embedding.embed_chunks(texts, plan_checks.flaky_embedder, "p", "m", batch=1, pause=plan_checks._no_pause).collect()
    assert {r.chunk_id: (r.status, r.tokens, r.embedding and r.embedding[0]) for r in done} == {
        "a": ("ok", 3, 3.0), "b": ("failed", 0, None), "c": ("ok", 0, None), "d": ("ok", 3, 3.0)
    }


@pytest.mark.parametrize("cells", [1, 5, 1 << 20])
def test_embedded_slices_leave_together(spark, monkeypatch, cells):
    """One table for many slices (its pieces bounded by numbers, not by slices), with each slice's own outcome."""
    monkeypatch.setattr(embedding, "OUT_CELLS", cells)

    def embed(texts):
        if "x3" in texts:
            raise RuntimeError("no")
        return [[1.0, float(x[1:])] for x in texts], len(texts)

    texts = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "chunk_id long, content string").coalesce(1)
    frames = []
    monkeypatch.setattr(type(texts), "mapInPandas", lambda self, run, schema: frames.extend(run(iter([self.toPandas()]))))
    embedding.embed_chunks(texts, embed, "p", "m", batch=2)
    assert len(frames) == {1: 9, 5: 5, 1 << 20: 1}[cells]  # the failed slice waits for the next
    done = [r for f in frames for r in f.to_dict("records")]
    assert [r["chunk_id"] for r in done] == list(range(20)) and sum(r["tokens"] for r in done) == 18
    assert [r["chunk_id"] for r in done if r["status"] == "failed"] == [2, 3] and done[2]["embedding"] is None
    assert all(list(r["embedding"]) == [1.0, r["chunk_id"]] and r["dims"] == 2 for r in done if r["status"] == "ok")


def test_events_are_judged_by_one_parse_and_torn_ones_by_their_looks(spark):
    """What cannot be JSON by its first characters is not parsed, and a token is only found in a whole event."""
    event = {
        "openai": '{"choices":[{"delta":{"content":"a}b"}}],"x":1}',
        "anthropic": '{"type":"content_block_delta","delta":{"text":"a"},"x":[2]}',
        "gemini": '{"candidates":[{"content":{"parts":[{"text":"a"}]}}],"x":1}',
    }
    texts = [(p, e[i:j]) for p, e in event.items() for i, j in [(0, n) for n in range(1, len(e) + 1)] + [(n, len(e)) for n in range(1, len(e))]]
    texts += [("openai", x) for x in ("true", " null", "nul", "false", "fals", "NaN", "Infinity", "-1", "1e5", "x", '"s"', "'s'", "[1", "[1]", "{}", "{", "{'a':1}", "", " ", "\ufeff{}", "{}x")]
    df = spark.createDataFrame(texts, "provider string, p string")
    rows = df.select("p", responses._is_json(F.col("p")).alias("json"), responses._may_be_json(F.col("p")).alias("may"), responses._found_token(F.col("p")).alias("t")).collect()
    assert all(r.may for r in rows if r.json) and all(r.json for r in rows if r.t is not None)
    assert not any(r.may for r in rows if r.p in ('{"choices":[{"d', "lta", "x", "nul", "{", ""))
    assert sorted(r.p for r in rows if r.t is not None) == sorted(event.values())
