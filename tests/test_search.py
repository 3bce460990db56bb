import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom import runtime
from noteloom.operators import hybrid, proximity
from noteloom.operators import text_search as search_operators
from noteloom.operators.links import apply_edge_changes, link_graph, link_keys, note_edges, resolve_links, written_links
from noteloom.operators.text_index import build_index, document_frequencies, term_frequencies, updated_document_frequencies, weighted_parts, weighted_postings
from noteloom.operators.text_search import _gram_pairs, cosine_hits, text_search
from noteloom.operators.vector_index import VectorIndex
from noteloom.operators.vector_search import vector_topk
from tests import models as m

DOCS = {
    "a": "red apple pie and apple tart",
    "b": "green apple",
    "c": "the of and",
    "d": "日本語のテスト、猫がいる。猫",
    "e": "blue sky blue sea; blue!",
    "f": "blue sky blue sea; blue!",
    "g": "",
    "h": "Äpfel und Birnen... und mehr",
    "i": "pie " * 60,
}
QUERIES = ["apple pie", "blue", "unseen apple", "猫", "...", "the", "  ", "", "日本", "zzz", "Blue SEA"]


def _frames(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "id string, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    return docs, queries


def _ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def test_text_search_matches_model(spark):
    docs, queries = _frames(spark)
    index = build_index(docs, "id", "text")
    assert index.n_docs == len(DOCS)
    for k, floor in itertools.product((1, 3, 20), (0.3, 0.0, 0.05, 0.6, 0.9)):
        got = _ranked(text_search(queries, index, docs, "text", k, floor).collect())
        for i, q in enumerate(QUERIES):
            assert got.get(i, []) == m.text_search(DOCS, q, k, floor), (q, k, floor)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_reads_the_postings_once_and_moves_nothing(spark, monkeypatch):
    """Lists of one document are scored where they lie, in pieces of any size, with and without common terms."""
    docs, queries = _frames(spark)
    index = build_index(docs, "id", "text")
    for floor in (0.1, 0.6):
        hits = cosine_hits(queries, index, floor)
        plan = _plan(hits)
        assert plan.count("tf#") and "hashpartitioning" not in plan and "Window" not in plan
        assert plan.count("FileScan parquet spark_catalog") == 2  # postings and norms
        whole = sorted(hits.collect())
        monkeypatch.setattr(search_operators, "DENSE", 1)
        weights = search_operators.query_weights(queries, index, floor).select("query_id", "term", "w", "qnorm", "common").toArrow()
        terms = weights.column("term").combine_chunks().unique()
        named = spark.createDataFrame([(t, i) for i, t in enumerate(terms.to_pylist())], "term string, t int")
        rows = index.postings.join(named, "term").groupBy("id").agg(F.collect_list(F.struct("t", "tf")).alias("_m")).join(index.norms, "id")
        batches = rows.select("id", "norm", "_m").toArrow().to_batches()
        got = [tuple(r.values()) for b in search_operators._scorer(weights, terms, ["id"], floor)(iter(batches)) for r in b.to_pylist()]
        assert sorted((q, d, round(x, 9)) for q, d, x in got if round(x, 9) >= floor) == [tuple(r) for r in whole]
        monkeypatch.undo()


def test_postings_of_frequent_terms_stay_in_their_buckets(spark, monkeypatch):
    """With more terms than may be broadcast, weights and norms are the same and only postings of rare terms move."""
    rows = [(f"d{i}", "common words here " + " ".join(f"only{i}x{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "id string, text string")
    whole = build_index(docs, "id", "text")
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    index = build_index(docs, "id", "text")
    near = lambda df: sorted((r.id, r.term, round(r.weight, 9), round(r.norm, 9)) for r in df.collect())
    assert near(weighted_postings(index)) == near(weighted_postings(whole))
    hot, cold = weighted_parts(index.postings, index.terms, index.n_terms)
    assert 0 < hot.count() and 0 < cold.count()
    assert "hashpartitioning" not in _plan(hot.join(index.norms, "id"))


def test_query_blocks_agree(spark):
    docs, queries = _frames(spark)
    index = build_index(docs, "id", "text")
    one = cosine_hits(queries, index, 0.1).collect()
    many = cosine_hits(queries, index, 0.1, block_terms=2).collect()
    assert sorted(one) == sorted(many) and one


def test_gram_join_equals_literal_scan(spark):
    docs, _ = _frames(spark)
    q = spark.createDataFrame([(0, "猫"), (1, "..."), (2, "e "), (3, "the"), (4, "q")], "query_id int, q string")
    low = docs.select("id", F.lower("text").alias("_low"))
    got = {(r.query_id, r.id) for r in _gram_pairs(q, low, "id").collect()}
    want = {(i, d) for i, s in [(0, "猫"), (1, "..."), (2, "e "), (3, "the"), (4, "q")] for d, t in DOCS.items() if s in t.lower()}
    assert got == want


def test_runs_of_characters_equal_the_literal_scan(spark, monkeypatch):
    """Both ways give the same hits: runs over the border of pieces, wide characters, repeated queries, empty texts."""
    rng = random.Random(5)
    rows = [(f"d{i}", "".join(rng.choice("e.,!?-😀é日 ") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [("long", "e." * 8191 + "!?-.,e😀" + "x" * 40_000 + "?!"), ("empty", ""), ("same", rows[0][1])]
    docs = spark.createDataFrame(rows, "id string, text string")
    asked = [".,", "?!", "日", "😀", "😀!", "e.", "e😀!?", "!?-.,", "?-.,-", "--!!--!!", "e."]
    asked += ["".join(rng.choice(".,!?-😀") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    found = []
    for limit in (10_000, 0):
        monkeypatch.setattr(search_operators, "FALLBACK_QUERIES", limit)
        found.append(sorted(map(tuple, search_operators.substring_hits(q, docs, "id", "text").collect())))
    assert found[0] == found[1] and {"!?-.,", "?!"} <= {asked[i] for i, d, _ in found[1] if d == "long"}


def test_best_hits_of_repeated_queries(spark, monkeypatch):
    """Repeated texts are looked up once; each query has its own best rows in the order of the ties, under its own type of id."""
    docs = spark.createDataFrame([(i, i % 3, "?!" * (i % 4) + "." * i) for i in range(40)], "id int, part int, text string")
    asked = ["?!", ".", "?!", "..", "?!", ".", "-"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    for limit in (200, 0):
        monkeypatch.setattr(search_operators, "FALLBACK_QUERIES", limit)
        every = search_operators.substring_hits(q, docs, "id", "text", ["part", "id"])
        best = search_operators.substring_hits(q, docs, "id", "text", ["part", "id"], k=3)
        want = sorted((r.query_id, r.id, r.score) for r in search_operators.top_k(every, 3, ["part", "id"]).collect())
        assert sorted((r.query_id, r.id, r.score) for r in best.collect()) == want and len(want) == 18
        assert dict(best.dtypes)["query_id"] == "bigint"


def test_rare_runs_give_the_candidates(spark):
    """A run that every document holds brings no candidates for a query that also has a rare one."""
    docs = spark.createDataFrame([(i, "e. " + ("?!," if i == 7 else "-")) for i in range(50)], "id int, _low string")
    needed = spark.createDataFrame([("e. ",), (". ?",)], "gram string")
    assert {(r.id, r.gram) for r in search_operators._gram_postings(docs, needed, "id").collect()} == {(i, "e. ") for i in range(50)} | {(7, ". ?")}
    q = spark.createDataFrame([(0, "e. ?!"), (1, "e. ?-")], "query_id int, q string")
    assert [(r.query_id, r.id) for r in _gram_pairs(q, docs, "id").collect()] == [(0, 7)]


def test_document_frequencies_update(spark):
    docs, _ = _frames(spark)
    tf = term_frequencies(docs, "id", "text")
    old = tf.where("id <> 'a'")
    moved = updated_document_frequencies(document_frequencies(old), tf.where("id = 'b'"), tf.where("id = 'a'"))
    want = document_frequencies(tf.where("id <> 'b'"))
    assert sorted(map(tuple, moved.select("term", "df").collect())) == sorted(map(tuple, want.select("term", "df").collect()))


VECTORS = {0: [1.0, 0.0, 0.0], 1: [1.0, 1.0, 0.0], 2: [2.0, 2.0, 0.0], 3: [0.0, 0.0, 0.0], 4: [1.0, 1.0], 5: [-1.0, 0.5, 0.25], 6: [0.5, 0.5, 0.5, 9.0]}


def test_vector_topk_matches_model(spark):
    v = spark.createDataFrame(list(VECTORS.items()), "id int, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    for block in (1000, 2):
        got = {}
        for r in vector_topk(q, v, "id", 4, query_block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        for i, qv in VECTORS.items():
            if not any(qv):
                assert i not in got
                continue
            scored = [(d, round(m.cosine(qv, vec), 9) + 0.0) for d, vec in VECTORS.items()]
            assert got[i] == sorted(scored, key=lambda r: (-r[1], r[0]))[:4], i


def _clustered(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    return [(f"v{i}", [float(np.float32(c)) for c in centers[i % 8] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * spread]) for i in range(n)]


def _index_case(spark, rows, queries, k, monkeypatch=None, **sizes):
    import noteloom.operators.vector_index as module

    for name, value in sizes.items():
        monkeypatch.setattr(module, name, value)
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    hits, visited = module.VectorIndex.build(v, "id").search(q, k)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i, qv in queries:
        if any(qv):
            scored = [(d, round(m.cosine(qv, vec), 9) + 0.0) for d, vec in rows if vec is not None]
            assert got[i] == sorted(scored, key=lambda r: (-r[1], r[0]))[:k], i
    return {r.query_id: r.visited for r in visited.collect()}


def test_vector_index_skips_clusters_and_loses_nothing(spark, monkeypatch):
    rows = _clustered(1500, 6, 1)
    queries = [(i, v) for i, (_, v) in enumerate(rows[::50])] + [(100, [-c for c in rows[3][1]])]
    visited = _index_case(spark, rows, queries, 7, monkeypatch, CLUSTER_ROWS=60, BLOCK_ROWS=40, BLOCKS=10**9)
    near = [visited[i] for i in range(30)]
    assert sum(near) < 0.4 * len(near) * len(rows)


def test_vector_index_on_odd_rows(spark, monkeypatch):
    """Zero vectors, other lengths, one very common vector, ties, nulls, fewer vectors than asked for."""
    rows = _clustered(60, 4, 2) + [(f"same{i:03}", [1.0, 2.0, 0.5, 0.0]) for i in range(90)]
    rows += [("zero", [0.0] * 4), ("short", [1.0, 2.0]), ("long", [1.0, 2.0, 0.5, 0.0, 7.0]), ("none", None)]
    queries = [(1, [1.0, 2.0, 0.5, 0.0]), (2, [1.0, 2.0]), (3, [0.0] * 4), (4, [0.0, -1.0, 0.0, 0.0]), (5, [1.0, 2.0, 0.5, 0.0, 7.0])]
    visited = _index_case(spark, rows, queries, 12, monkeypatch, CLUSTER_ROWS=20, BLOCK_ROWS=16, BLOCKS=10**9)
    assert set(visited) == {1, 2, 4, 5}
    _index_case(spark, rows[:3], queries, 12)
    empty = spark.createDataFrame([], "id string, embedding array<float>")
    assert VectorIndex.build(empty, "id").search(spark.createDataFrame(queries, "query_id long, embedding array<float>"), 3)[0].count() == 0


def _list(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, score double, rank int")


def test_fusion(spark):
    text = _list(spark, [(1, "x", 0.9, 1), (1, "y", 0.5, 2), (2, "x", 0.7, 1)])
    near = _list(spark, [(1, "ghost", 0.99, 1), (1, "z", 0.9, 2), (1, "y", 0.8, 3)])
    known = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    rows = {(r.query_id, r.id): r for r in hybrid.fuse(text, near, "id", 5, known).collect()}
    assert (1, "ghost") not in rows
    assert rows[1, "y"].match_type == "hybrid" and rows[1, "y"]["rank"] == 1
    # x (text rank 1) and z (vector rank 1 once the orphan is gone) tie: text comes first
    assert rows[1, "x"].score == rows[1, "z"].score == round(1 / 61, 9)
    assert (rows[1, "x"]["rank"], rows[1, "z"]["rank"]) == (2, 3)
    # no vectors for query 2: the text list as it is
    assert (rows[2, "x"].score, rows[2, "x"].match_type) == (0.7, "text")
    assert hybrid.pool_size(5) == 50 and hybrid.pool_size(40) == 80


def _notes(spark, rows):
    cols = "path string, name string, content string, mtime timestamp_ntz"
    df = spark.createDataFrame([(p, p.split("/")[-1][:-3], c) for p, c in rows], "path string, name string, content string")
    return df.withColumn("mtime", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).selectExpr(*[c.split()[0] for c in cols.split(", ")])


def test_link_resolution(spark):
    notes = _notes(
        spark,
        [
            ("a/x.md", "[[y]] [[a/z]] [[b/y.md|alias]] [[nope]] [[ y ]]"),
            ("a/y.md", ""),
            ("b/y.md", "[[z]]"),
            ("a/z.md", ""),
            ("c/deep/z.md", ""),
            ("q.md", "[[x]]"),
        ],
    )
    edges = {(r.src, r.dst): r.n for r in note_edges(notes).collect()}
    assert edges == {("a/x.md", "a/y.md"): 2, ("a/x.md", "a/z.md"): 1, ("a/x.md", "b/y.md"): 1, ("b/y.md", "a/z.md"): 1, ("q.md", "a/x.md"): 1}
    asked = spark.createDataFrame([("c/deep/n.md", "z"), ("n.md", "z")], "path string, target string")
    assert {r.path: r.target_path for r in resolve_links(asked, notes).collect()} == {"c/deep/n.md": "c/deep/z.md", "n.md": "a/z.md"}


def test_link_forms(spark):
    """Subpaths, other capitals, ends of paths, Markdown links, relative links; links that lead out or nowhere."""
    text = """[[Note#Head]] [[NOTE#^b1]] [[sub/note|x]] [a](other.md) [b](<My Page.md>) [c](My%20Page.md#top "title") [d](../c++.md)
    [[#here]] [e](https://x.org/note.md) [f](mailto:a@b.c) ![[Note]] [[x/Note]] [g](100%.md) [[./Sub/Note.MD]]"""
    notes = _notes(spark, [("a/src.md", text), ("Note.md", ""), ("note.md", ""), ("z/Sub/Note.md", ""), ("a/other.md", ""), ("other.md", ""), ("My Page.md", ""), ("c++.md", ""), ("100%.md", "")])
    found = sorted((r.pos, r.target, r.target_path) for r in resolve_links(written_links(notes), notes).collect())
    assert found == [
        (0, "Note#Head", "Note.md"),
        (1, "NOTE#^b1", "Note.md"),  # neither spelling is the same: the first by alphabet
        (2, "sub/note", "z/Sub/Note.md"),
        (3, "#here", None),
        (4, "Note", "Note.md"),
        (5, "x/Note", None),
        (6, "./Sub/Note.MD", "z/Sub/Note.md"),
        (7, "other.md", "other.md"),
        (8, "My Page.md", "My Page.md"),
        (9, "My Page.md#top", "My Page.md"),
        (10, "../c++.md", "c++.md"),
        (11, "100%.md", "100%.md"),
    ]
    asked = spark.createDataFrame([("a/b.md", "OTHER"), ("q/b.md", "Other"), ("a/b.md", "src"), ("a/b.md", "")], "path string, target string")
    got = {(r.path, r.target): r.target_path for r in resolve_links(asked, notes).collect()}
    assert got == {("a/b.md", "OTHER"): "other.md", ("q/b.md", "Other"): "other.md", ("a/b.md", "src"): "a/src.md", ("a/b.md", ""): None}
    assert resolve_links(asked, notes.limit(0)).where("target_path is not null").count() == 0


def test_edge_changes_keep_other_notes_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    changed = spark.createDataFrame([("a", False)], "path string, deleted boolean")
    fresh = spark.createDataFrame([("a", "c")], "src string, dst string")
    assert set(map(tuple, apply_edge_changes(edges, changed, fresh).collect())) == {("b", "a"), ("c", "a"), ("a", "c")}
    gone = spark.createDataFrame([("a", True)], "path string, deleted boolean")
    assert apply_edge_changes(edges, gone, fresh.limit(0)).collect() == []


@pytest.mark.parametrize("options", [{}, {"few": 0}, {"few": 0, "part": 3}])
def test_link_scores_against_bfs(spark, options):
    """Broadcast, by shuffle, and by shuffle with lists of more than 3 neighbours split."""
    pairs = [(f"n{i}", f"n{j}") for i, j in [(0, 1), (0, 2), (0, 3), (4, 5), (6, 7), (1, 8), (2, 9), (3, 10)]] + [("n0", f"n{i}") for i in range(11, 40)]
    graph = link_graph(spark.createDataFrame(pairs, "src string, dst string"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    names = [f"n{i}" for i in range(14)] + ["lonely"]
    asked = spark.createDataFrame([(a, b) for a in names for b in names], "anchor string, target string")
    found = proximity.link_scores(asked, graph, **options).collect()
    assert len(found) == len(names) ** 2
    for r in found:
        hops = near.get(r.anchor, set())
        want = 1.0 if r.anchor == r.target else 0.8 if r.target in hops else 0.4 if any(r.target in near[x] for x in hops) else 0.0
        assert r.link == want, (r.anchor, r.target)


def test_folder_name_and_time(spark):
    rows = [("a/b/x.md", "a/b/y.md"), ("a/b/x.md", "a/c/y.md"), ("x.md", "y.md"), ("x.md", "a/y.md"), ("a/b/c/q.md", "a/z.md")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(proximity.folder_score("a", "b")).collect()] == [1.0, 0.5, 1.0, 0.0, 1 / 3]
    names = spark.createDataFrame([("a", "b"), ("a", "bc"), ("Note", "note"), ("abcd", "bcde")], "a string, b string")
    assert [r[0] for r in names.select(proximity.name_score("a", "b")).collect()] == [1.0, 0.0, 1.0, 0.5]
    times = spark.sql("select timestamp_ntz'2024-01-08 00:00:00' a, timestamp_ntz'2024-01-01 00:00:00' b, cast(null as timestamp_ntz) c")
    got = times.select(proximity.time_score("a", "b"), proximity.time_score("a", "c")).first()
    assert math.isclose(got[0], math.exp(-1)) and got[1] == 0.0


def test_rerank_only_reorders(spark):
    notes = _notes(spark, [("a/x.md", "[[y]]"), ("a/y.md", ""), ("b/z.md", "")])
    graph = link_graph(note_edges(notes))
    results = spark.createDataFrame([(1, "z", "b/z.md", 0.50, 1), (1, "y", "a/y.md", 0.49, 2), (2, "z", "b/z.md", 0.5, 1)], "query_id int, chunk_id string, path string, score double, rank int")
    anchors = spark.createDataFrame([(1, "a/x.md")], "query_id int, anchor string")
    rows = {(r.query_id, r.chunk_id): r for r in proximity.proximity_rerank(results, anchors, notes, graph, 0.5).collect()}
    assert (rows[1, "y"]["rank"], rows[1, "z"]["rank"]) == (1, 2)
    # one hop, same folder, one-letter names (no bigrams: equal), same time
    assert rows[1, "y"].proximity == round(0.4 * 0.8 + 0.3 + 0.15 + 0.15, 9)
    assert rows[2, "z"].score == 0.5 and rows[2, "z"].proximity is None


def test_vector_pieces_bound_what_travels(spark, monkeypatch):
    """Queries and vectors meet in rows of bounded size, however many queries need a block; nothing is lost."""
    import noteloom.operators.vector_index as module

    monkeypatch.setattr(module, "PIECE_BYTES", 256)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(700)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    index = module.VectorIndex.build(v, "id")
    assert index.blocks.agg(F.max(F.octet_length("x"))).first()[0] <= 256
    seen = []
    monkeypatch.setattr(module, "stage", lambda df: seen.append(df) or df)
    hits = index.search(q, 3)[0].collect()
    packs = [f for f in seen if "q_ids" in f.columns]
    assert packs and all((f.agg(F.max(F.octet_length("q"))).first()[0] or 0) <= 256 for f in packs)
    m8 = np.array([r[1] for r in rows])
    unit = m8 / np.sqrt((m8 * m8).sum(1, keepdims=True))
    scores = np.round(unit @ unit.T, 9)
    want = {(i, int(j)) for i in range(700) for j in np.lexsort((np.arange(700), -scores[i]))[:3]}
    assert {(r.query_id, r.id) for r in hits} == want


def test_names_of_notes_are_cut_once(spark):
    """Paths are split in a column of their own: not again for every end of every path."""
    notes = spark.createDataFrame([("a/B/c.md",), ("c.md",)], "path string")
    keys = link_keys(notes)
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {(r.kind, r.key): r.hit.path for r in keys.collect()}
    assert got["end", "c"] == "c.md" and got["end/i", "b/c"] == got["end", "B/c"] == got["path", "a/B/c"] == got["path/i", "a/b/c"] == "a/B/c.md"


def test_documents_without_a_chance_stay_out_of_python(spark, monkeypatch):
    """A document whose terms cannot reach the threshold for any query is dropped before the products, and no hit is lost."""
    rows = [(i, "word " + " ".join(f"filler{i}x{j}" for j in range(30 if i % 3 else 1))) for i in range(30)]
    index = build_index(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    queries = spark.createDataFrame([(1, "word filler0x0"), (2, "word")], "query_id long, text string")
    want = sorted(cosine_hits(queries, index, 0.2).collect())
    scorer = search_operators._scorer

    def strict(*args):
        inner = scorer(*args)

        def run(batches):
            for batch in batches:
                assert all(i % 3 == 0 for i in batch.column("id").to_pylist()), "a document without a chance"
                yield from inner(iter([batch]))

        return run

    monkeypatch.setattr(search_operators, "_scorer", strict)
    assert sorted(cosine_hits(queries, index, 0.2).collect()) == want and {r.id for r in want} == set(range(0, 30, 3))


def test_tasks_send_only_rows_that_can_win(spark, monkeypatch):
    """Of many equal hits a task sends the k best of a query, not all of them; the result is the same."""
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else "same words") for i in range(400)], "id long, text string")
    queries = spark.createDataFrame([(1, "same words"), (2, "here"), (3, "words here")], "query_id int, text string")
    index = build_index(docs, "id", "text")
    want = sorted(search_operators.top_k(cosine_hits(queries, index, 0.1), 4, ["id"]).select("query_id", "id", "score", "rank").collect())
    scorer = search_operators._scorer

    def strict(*args):
        inner = scorer(*args)

        def run(batches):
            for batch in batches:
                for out in inner(iter([batch])):
                    assert out.num_rows <= 3 * 4 * 2, "rows that cannot win"  # queries, k, distinct scores
                    yield out

        return run

    monkeypatch.setattr(search_operators, "_scorer", strict)
    assert sorted(text_search(queries, index, docs, "text", 4, 0.1).collect()) == want and len(want) == 12


def test_contenders_hold_the_best_of_every_query():
    """Against a full sort of rounded scores, with ties, near ties and queries of fewer than k rows."""
    rng = np.random.default_rng(5)
    for k in (1, 3, 10):
        query = rng.integers(0, 9, 600) ** 2 // 8
        score = rng.choice([0.3, 0.5, 0.5 + 4e-10, 0.5 + 6e-10, 0.5 + 3e-9, 0.7], 600) + rng.choice([0, 1e-16, 1e-10], 600)
        place = rng.permutation(600)
        kept = set(search_operators._contenders(query, score, place, k).tolist())
        for q in set(query.tolist()):
            rows = sorted(np.flatnonzero(query == q).tolist(), key=lambda i: (-round(score[i], 9), place[i]))
            assert set(rows[:k]) <= kept
        assert len(kept) < 600 or k == 10
    assert len(search_operators._contenders(np.array([], int), np.array([]), np.array([], int), 2)) == 0


def test_vectors_are_assigned_once(spark, monkeypatch):
    """Dealing blocks by range samples its input: what Python gave each vector is staged before, not worked out again."""
    from noteloom.operators import vector_index

    plans, real = [], vector_index.stage
    monkeypatch.setattr(vector_index, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(50)]
    VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), "id")
    assert [p.count("MapInArrow") for p in plans] == [1, 1]


def test_settled_targets_part_links_before_they_are_made(spark, monkeypatch):
    """Frequent targets that no folder changes are told apart below the join that makes the links; all answers stay the same."""
    from noteloom.operators import links as module

    notes = spark.createDataFrame([(f"{f}/n{i}.md",) for f in "abc" for i in range(40)] + [("a/x.md",), ("b/x.md",), ("b/deep/y.md",)], "path string")
    names = spark.createDataFrame([("y",), ("x",), ("n1",), ("B/deep/Y#h",), ("no",), ("no/b",), ("y#a",), (None,)], "target string")
    own = notes.select("path", F.concat(F.lit("./"), F.regexp_extract("path", "([^/]*)$", 1)).alias("target"))
    links = notes.crossJoin(names).unionByName(own)
    want = sorted(map(repr, resolve_links(links, notes).select("path", "target", "target_path").collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(module, "SETTLED_SHARE", 50)
    parted = resolve_links(links, notes).select("path", "target", "target_path")
    assert sorted(map(repr, parted.collect())) == want and len(want) == 9 * 123
    got = {(r.path, r.target): r.target_path for r in parted.collect()}
    assert (got["a/n1.md", "x"], got["b/n1.md", "x"], got["c/n1.md", "x"]) == ("a/x.md", "b/x.md", "a/x.md")
    assert got["c/n2.md", "y"] == got["c/n2.md", "B/deep/Y#h"] == "b/deep/y.md" and got["c/n2.md", "no"] is None
    plan = parted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    crosses = [i for i, line in enumerate(plan) if "Join Cross" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    assert len(crosses) == 2
    for at in crosses:
        below = [line for line in plan[at + 1 :] if depth(line) > depth(plan[at])]
        assert any("xxhash64" in line for line in below[:8]), "links are made before they are parted"


def test_queries_do_not_travel_to_every_block(spark, monkeypatch):
    """What is written of the queries does not grow with the blocks they visit; rounds and odd rows lose nothing."""
    import noteloom.operators.vector_index as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    monkeypatch.setattr(module, "PIECE_BYTES", 128)
    monkeypatch.setattr(module, "UNIT", 3)
    monkeypatch.setattr(module, "ROUND_BYTES", 8192)
    rng = np.random.default_rng(4)
    rows = [(f"v{i:03}", [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(500)]
    rows += [(f"w{i:03}", rows[i][1]) for i in range(40)] + [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("long", [1.0] * 9)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    index = module.VectorIndex.build(v, "id")
    assert len(index.rings[1]) > 30
    seen, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df: seen.append(real(df)) or seen[-1])
    hits, visited = index.search(q, 5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    travelled = sum(f.agg(F.sum(F.size("q_ids"))).first()[0] for f in seen if "q_ids" in f.columns)
    assert travelled <= 6 * len(rows), "queries are written for every block"
    assert visited.agg(F.avg("visited")).first()[0] > 100
    assert set(got) == {i for i, _ in rows} - {"zero"}
    for i in ("v000", "v017", "w005", "short", "long"):
        qv = dict(rows)[i]
        scored = [(d, round(m.cosine(qv, vec), 9) + 0.0) for d, vec in rows]
        assert got[i] == sorted(scored, key=lambda r: (-r[1], r[0]))[:5], i


def test_best_rows_of_many_blocks():
    """Against a full sort: ties, several blocks, a floor known beforehand, keys that are no numbers."""
    from noteloom.operators.vector_math import Best

    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    queries = vectors[:50][(vectors[:50] != 0).any(1)]
    unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1)
    scores = np.round(unit(queries) @ unit(vectors).T, 9) + 0.0
    for kind in (np.int64, object):
        keys = rng.permutation(300).astype(kind) if kind is np.int64 else np.array([f"k{i}" for i in rng.permutation(300)], object)
        want = [sorted(range(300), key=lambda j: (-scores[i, j], keys[j]))[:7] for i in range(len(queries))]
        for floor in (np.full(len(queries), -2.0), np.array([scores[i, w[-1]] for i, w in enumerate(want)])):
            best = Best(queries, floor, 7, np.dtype(kind))
            for a in range(0, 300, 64):
                best.add(np.arange(len(queries)), vectors[a : a + 64], np.full(len(vectors[a : a + 64]), 4), keys[a : a + 64])
            assert [list(r) for r in best.keys] == [[keys[j] for j in w] for w in want]


def test_rows_sent_do_not_grow_with_cores(spark, monkeypatch):
    """A round meets the blocks in SPREAD parts at most, each of which sends k rows a query; rounds share the other cores."""
    import noteloom.operators.vector_index as module

    for name, value in (("BLOCK_ROWS", 16), ("PIECE_BYTES", 128), ("UNIT", 1), ("ROUND_BYTES", 2048), ("SPREAD", 2)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    plans, real = [], module.staged_parts
    monkeypatch.setattr(module, "staged_parts", lambda s, schema, parts: real(s, schema, (plans.append(p._jdf.queryExecution().optimizedPlan().toString()) or p for p in parts)))
    hits = module.VectorIndex.build(v, "id").search(v.select(F.col("id").alias("query_id"), "embedding"), 3)[0].collect()
    assert len(plans) > 1 and all(p.count("Repartition 2, false") == p.count("MapInArrow") for p in plans)
    assert max(p.count("MapInArrow") for p in plans) == spark.sparkContext.defaultParallelism // 2
    m4 = np.array([r[1] for r in rows])
    unit = m4 / np.sqrt((m4 * m4).sum(1, keepdims=True))
    scores = np.round(unit @ unit.T, 9)
    assert {(r.query_id, r.id) for r in hits} == {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -scores[i]))[:3]}
