import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.functions import text as t
from noteloom.operators.chunking import STRATEGIES, _line_facts, chunk_documents
from noteloom.operators.frontmatter import with_frontmatter
from tests import models as m

WHITE = [chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
EDGES = [chr(c) for c in (0x85, 0x200B, 0x2FFF, 0x3000, 0x9FFF, 0xA000, 0xF8FF, 0xF900, 0xFAFF, 0xFB00)]
TEXTS = (
    ["", "猫", "the a I", "日本語のテスト。Go言語", "a+b and `code`", "x_y-z", "😀", "😀a", "한국어 단어", "ﾃｽﾄ ｶﾅ", "Straße ÉCOLE don't"]
    + [f"ab{w}cd{w}" for w in WHITE]
    + [f"ab{e}cd{e}{e}" for e in EDGES]
    + [w + "mid" + w for w in WHITE]
)
NOTES = {
    "plain": "just text\nmore",
    "no_end": "---\ntags: [a]\nbody",
    "empty_fm": "---\n---\nbody",
    "bare_fm": "---\n---",
    "leading": "\n\n  ---\ntitle: x\n---\n\nbody\n",
    "no_items": "---\nlist:\nother: 'v'\nempty: []\n---\nb",
    "stray_item": "---\na: 1\n- x\n- y: z\n# note\nb: c:d\n---\nb",
    "dup": "---\na: 1\na:\n - p\n-q\n - r\na: \"2\"\n---\nb",
    "quotes": "---\nl: ['a', \"b\", , c ]\ns: '\nq: \"\n---\nb",
    "crlf": "---\r\ntags: [a, b]\r\n---\r\n# H\r\nx\r\n\r\ny\r\n",
    "echo": "---\nx: hello\n---\nhello",
    "echo2": "---\nhello: hello\n---\nhello",
    "blank_only": " \n\t\n　\n",
    "heading0": "# First\ntext\n## Second \n\nmore\n",
    "unclosed": "a\n```\n# not\n\nb\n\n# neither",
    "nohead": "#nohead\n# \n####### seven\n###### six",
    "hash_alone": "# \nx\n#\n y",
    "fences": "p1\n\n```py\n# c\n\nx\n```\n\n## after\nq\n\n\n\nr",
    "long_line": "short\n" + "x" * 900 + "\nshort\n" + "y" * 50,
    "fence_at_limit": "\n".join(["w" * 40] * 12 + ["```", "code " * 20, "```"] + ["z" * 40] * 12),
    "lead_blank_big": "# H\n\n\n\n" + "\n".join(f"line {i} " + "v" * 60 for i in range(30)),
    "cjk": "# 見出し\n" + "日本語の文章。" * 40 + "\n" + "短い\n" * 30,
    "ws_heading": "#　wide\nbody\n##\ttab\nbody",
}


def test_tokens_and_estimates_match_model(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, s string")
    for r in df.select("i", "s", t.tokenize("s").alias("tk"), t.estimate_tokens("s").alias("n"), t.js_trim("s").alias("tr")).collect():
        assert list(r.tk) == m.tokens(r.s), (r.i, r.s)
        assert r.n == m.est(r.s), (r.i, r.s)
        assert r.tr == m.trim(r.s)
    assert df.select(t.estimate_tokens(F.lit(None).cast("string")).alias("n")).first().n == 0


def test_frontmatter_matches_model(spark):
    df = spark.createDataFrame(list(NOTES.items()), "path string, content string")
    for r in with_frontmatter(df).collect():
        values, listy, body, base = m.frontmatter(r.content)
        assert r.metadata == values, r.path
        assert r.metadata_is_list == listy, r.path
        assert (r.body, r.body_start_line) == (body, base), r.path


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("max_tokens", [20, 128])
def test_chunks_match_model(spark, strategy, max_tokens):
    df = spark.createDataFrame([(k, k, v) for k, v in NOTES.items()], "path string, name string, content string")
    got = {}
    for r in chunk_documents(df, strategy, max_tokens).collect():
        assert r.chunk_id == f"{r.path}::{r.chunk_index}"
        got.setdefault(r.path, []).append((r.chunk_index, r.content, r.heading, r.start_line, r.end_line, r.tokens))
    for path, content in NOTES.items():
        assert sorted(got.get(path, [])) == m.chunks(content, strategy, max_tokens), path


def test_unknown_strategy_means_sections(spark):
    df = spark.createDataFrame([("a", "a", NOTES["heading0"])], "path string, name string, content string")
    assert chunk_documents(df, "other").collect() == chunk_documents(df, "section").collect()


LINES = st.sampled_from(["", " ", "text", "# One", "## Two ", "```", "```sql", "#x", "日本語", "word " * 12, "　", "- item", "---"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(LINES, max_size=14), min_size=20, max_size=40))
def test_random_notes(spark, docs):
    rows = [(str(i), "\n".join(lines)) for i, lines in enumerate(docs)]
    df = spark.createDataFrame([(p, p, c) for p, c in rows], "path string, name string, content string")
    for strategy in STRATEGIES:
        got = {}
        for r in chunk_documents(df, strategy, 16).collect():
            got.setdefault(r.path, []).append((r.chunk_index, r.content, r.heading, r.start_line, r.end_line, r.tokens))
        for path, content in rows:
            want = m.chunks(content, strategy, 16)
            assert sorted(got.get(path, [])) == want, (strategy, content)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab T-.'　 日本😀é\n#", max_size=30), min_size=50, max_size=80))
def test_random_tokens(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    for r in df.select("s", t.tokenize("s").alias("tk"), t.estimate_tokens("s").alias("n")).collect():
        assert list(r.tk) == m.tokens(r.s)
        assert r.n == m.est(r.s)


def test_labels(spark):
    rows = [(0,), (999,), (1000,), (1050,), (1150,), (1250,), (9949,), (9999,), (10499,), (10500,), (123456,)]
    df = spark.createDataFrame(rows, "n long")
    tokens = {r.n: r.l for r in df.select("n", t.token_label("n").alias("l")).collect()}
    # 1150/1000 lies just below 1.15 in binary, 1250/1000 is an exact tie
    assert tokens == {0: "0", 999: "999", 1000: "1.0K", 1050: "1.1K", 1150: "1.1K", 1250: "1.3K", 9949: "9.9K", 9999: "10.0K", 10499: "10K", 10500: "11K", 123456: "123K"}
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1048575,), (1048576,)], "n long")
    assert [r.l for r in sizes.select("n", t.bytes_label("n").alias("l")).orderBy("n").collect()] == ["0B", "1023B", "1.0KB", "1.3KB", "1024.0KB", "1.0MB"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.d.md",), ("root.md",), ("x/noext",), (".hidden",)], "p string")
    got = df.select(t.base_name("p"), t.parent_folder("p"), t.folder_segments("p"), t.extension("p")).collect()
    assert [tuple(r) for r in got] == [("c.d", "a/b", ["a", "b"], "md"), ("root", "", [], "md"), ("noext", "x", ["x"], ""), ("", "", [], "hidden")]


@pytest.mark.parametrize("strategy, asked", [("section", []), ("paragraph", ["blank"]), ("fixed", ["cost"])])
def test_lines_are_asked_what_the_strategy_needs(spark, strategy, asked):
    facts = spark.range(1).select(_line_facts(F.array(F.lit("a")), strategy).alias("f")).schema["f"].dataType.elementType
    assert facts.names == ["i", "fence", "heading", *asked]


def test_search_chunks_are_written_once_and_without_front_matter(spark):
    from noteloom.plans.retriever import COLUMNS, Retriever
    from noteloom.runtime import stage

    notes = spark.createDataFrame([(f"n{i}.md", f"n{i}", f"---\na: [x, 'y']\nb: c:d\n---\n# T\nword{i}") for i in range(20)], "path string, name string, content string")
    chunks = chunk_documents(notes)
    assert Retriever.build(chunks).chunks.columns == list(COLUMNS)
    staged = stage(chunks.select(*COLUMNS))
    assert sorted(Retriever.build(staged).chunks.inputFiles()) == sorted(staged.inputFiles())
    assert {tuple(sorted((k, tuple(v)) for k, v in r.metadata.items())) for r in chunks.collect()} == {(("a", ("x", "y")), ("b", ("c:d",)))}


def test_only_lines_that_change_the_state_are_folded(spark):
    text = "plain\n# One\n## not`` `\n\n```sql\n# code\n  ```\n#no\nmore"
    for strategy, lines in (("section", [1, 2, 4, 5, 6]), ("paragraph", [1, 2, 3, 4, 5, 6]), ("fixed", list(range(9)))):
        facts = spark.range(1).select(_line_facts(F.split(F.lit(text), "\n"), strategy).alias("f")).first().f
        assert [f.i for f in facts] == lines and [f.i for f in facts if f.fence] == [4, 6]
        assert [f.heading for f in facts if f.heading is not None] == ["One", "not`` `", "code"]


def test_plain_text_takes_the_short_way_to_its_tokens(spark):
    """Every pair of ASCII characters between words: the pattern for ASCII text cuts as the general one does."""
    texts = [f"aB{chr(i)}C{chr(j)}{chr(j)}the{chr(i)}x9" for i in range(128) for j in range(0, 128, 5)]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    short = F.filter(F.regexp_extract_all(F.lower("s"), F.lit(t._ASCII_WORDS), F.lit(0)), lambda w: ~w.isin(t.STOP_WORDS))
    for r in df.select("s", short.alias("short"), t.tokenize("s").alias("tk")).collect():
        assert list(r.tk) == list(r.short) == m.tokens(r.s), r.s


def test_counts_of_texts_with_and_without_repeats(spark):
    from noteloom.operators.text_index import term_counts

    rows = [(["b", "a"],), (["b", "a", "b"],), ([],), (None,)]
    got = spark.createDataFrame(rows, "k array<string>").select(term_counts("k").alias("c")).collect()
    assert [sorted((c.term, c.n) for c in r.c) for r in got] == [[("a", 1), ("b", 1)], [("a", 1), ("b", 2)], [], []]
