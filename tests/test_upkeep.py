import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import changes, links, text_index
from noteloom.operators.chunking import chunk_documents
from noteloom.sources import index_store
from noteloom.plans.retriever import Retriever
from noteloom.runtime import stage
from noteloom.sources import notes as src
from noteloom.sources.stored_index import IndexSettings, StoredIndex
from noteloom.streaming import changes as stream

BASE = dt.datetime(2024, 1, 1)


def _notes(spark, rows):
    """rows: {path: (content, seconds)}"""
    data = [(p, p.split("/")[-1][:-3], c, BASE + dt.timedelta(seconds=s)) for p, (c, s) in rows.items()]
    return spark.createDataFrame(data, "path string, name string, content string, mtime timestamp_ntz")


def test_detect_changes(spark):
    cached = src.with_hash(_notes(spark, {"same.md": ("a", 1), "touched.md": ("b", 1), "edited.md": ("c", 1), "gone.md": ("d", 1), "lied.md": ("e", 1)}))
    now = _notes(spark, {"same.md": ("a", 1), "touched.md": ("b", 2), "edited.md": ("C", 2), "new.md": ("n", 1), "lied.md": ("E", 1)})
    got = {r.path: r for r in changes.detect_changes(now, cached).collect()}
    assert {p: r.status for p, r in got.items()} == {
        "same.md": "unchanged", "touched.md": "unchanged", "edited.md": "modified", "gone.md": "deleted", "new.md": "added",
        "lied.md": "unchanged",  # equal times are trusted
    }
    assert got["touched.md"].mtime == BASE + dt.timedelta(seconds=2)


def test_incremental_equals_rebuild(spark):
    rng = random.Random(5)
    words = ["# A", "text one", "## B", "more text", "", "```", "日本語"]
    state = {f"d/{i}.md": ("\n".join(rng.choices(words, k=6)), 0) for i in range(12)}
    notes = _notes(spark, state)
    files, chunks = src.with_hash(notes).select("path", "hash", "mtime"), chunk_documents(notes)
    for step in range(1, 4):
        for p in rng.sample(sorted(state), 3):
            state[p] = ("\n".join(rng.choices(words, k=6)), step)
        state.pop(rng.choice(sorted(state)))
        state[f"d/new{step}.md"] = ("# New\ntext", step)
        notes = _notes(spark, state)
        files, chunks, _ = changes.incremental_index(notes, files, chunks)
        want = {(r.chunk_id, r.content, r.heading, r.start_line, r.end_line, r.tokens) for r in chunk_documents(notes).collect()}
        assert {(r.chunk_id, r.content, r.heading, r.start_line, r.end_line, r.tokens) for r in chunks.collect()} == want
        assert {r.path for r in files.collect()} == set(state)


def test_remove_compares_whole_paths(spark):
    rows = spark.createDataFrame([("a.md", 1), ("a.md::x.md", 2)], "path string, n int")
    assert [r.n for r in changes.remove_files(rows, spark.createDataFrame([("a.md",)], "path string")).collect()] == [2]


def _brute_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return [tuple(x) for x in out]


def _at(us):
    return BASE + dt.timedelta(microseconds=us)


def test_debounce_gaps(spark):
    ms = 1000
    times = {"a": [0, 400 * ms, 900 * ms, 1500 * ms], "b": [0, 600 * ms, 601 * ms]}
    rng = random.Random(1)
    day = 86_400_000_000
    # bursts across midnight, where runs of two slices must merge
    times["c"] = [day * k + rng.randrange(-2_000_000, 2_000_000) for k in range(1, 5) for _ in range(40)]
    times["d"] = [day - 300 * ms, day - 1, day, day + 499 * ms, day + 999 * ms + 1]
    df = spark.createDataFrame([(p, _at(t)) for p, ts in times.items() for t in ts], "path string, ts timestamp_ntz")
    base_us = int((BASE - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = {}
    for r in changes.debounce(df).collect():
        assert r.due_us == r.last_us + 500_000
        got.setdefault(r.path, []).append((r.first_us - base_us, r.last_us - base_us, r.n))
    for p, ts in times.items():
        assert sorted(got[p]) == _brute_sessions(ts, 500_000), p


def test_normalize_rename(spark):
    rows = [("b.md", "a.md", "rename", _at(5)), ("a.md", None, "modify", _at(3)), ("c.md", None, "modify", _at(1)), ("c.md", None, "delete", _at(2)), ("a.md", None, "modify", _at(9))]
    df = spark.createDataFrame(rows, "path string, old_path string, op string, ts timestamp_ntz")
    assert {r.path: r.op for r in changes.normalize_changes(df).collect()} == {"a.md": "modify", "b.md": "modify", "c.md": "delete"}


def test_index_roundtrip_and_json(spark, tmp_path):
    notes = _notes(spark, {"a/x.md": ("---\ntags: [p, \"q\"]\nk: 'v \"w\"'\n---\n# H\ntext \"quoted\"\n", 1), "y.md": ("plain\ttab", 2), "e.md": ("  ", 3)})
    files, chunks = src.with_hash(notes).select("path", "hash", "mtime"), chunk_documents(notes)
    index_store.save_index(files, chunks, str(tmp_path / "ix"), 4)
    f2, c2 = index_store.load_index(spark, str(tmp_path / "ix"))
    assert f2.count() == 3 and {r.chunk_id for r in c2.collect()} == {r.chunk_id for r in chunks.collect()}
    exported = {r.path: r for r in index_store.export_files(files, chunks).collect()}
    assert exported["e.md"].chunks_json == "[]"
    one = json.loads(exported["a/x.md"].chunks_json)[0]
    assert one["metadata"] == {"tags": ["p", "q"], "k": 'v "w"'} and one["heading"] == "H" and one["startLine"] == 4
    cache = {
        "version": 2, "chunkStrategy": "section", "chunkMaxTokens": 512, "excludeFolders": "",
        "files": {p: {"hash": r.hash, "mtime": 1700000000000, "chunks": json.loads(r.chunks_json)} for p, r in exported.items()},
    }
    (tmp_path / "cache.json").write_text(json.dumps(cache, ensure_ascii=False))
    meta, files3, chunks3 = index_store.import_json(spark, str(tmp_path / "cache.json"))
    assert meta.select(index_store.is_valid("section", 512)).first()[0] and not meta.select(index_store.is_valid("fixed", 512)).first()[0]
    assert files3.count() == 3
    cols = ["chunk_id", "path", "name", "chunk_index", "content", "heading", "start_line", "end_line", "tokens"]
    assert sorted(map(str, chunks3.select(cols).collect())) == sorted(map(str, chunks.select(cols).collect()))


def test_scan_files(spark, tmp_path):
    root = tmp_path / "my notes"
    (root / "sub dir").mkdir(parents=True)
    (root / "a+b.md").write_text("one\ntwo\n")
    (root / "sub dir" / "ü.md").write_text("# X")
    (root / "skip.txt").write_text("no")
    got = {r.path: r for r in src.scan_files(spark, str(root)).collect()}
    assert set(got) == {"a+b.md", "sub dir/ü.md"}
    assert got["a+b.md"].content == "one\ntwo\n" and got["a+b.md"].size == 8 and got["sub dir/ü.md"].name == "ü"
    assert [r.path for r in src.in_folder(src.scan_files(spark, str(root)), "sub dir").collect()] == ["sub dir/ü.md"]


def test_scan_files_keeps_underscored_names_and_roots(spark, tmp_path, monkeypatch):
    root = tmp_path / "vault" / "a" / "vault"  # a name that comes twice in the path
    for name in ("_template.md", "sub/_index.md", "_dir/x.md", "plain.md", ".hidden.md", ".trash/y.md", "_no.txt", "a+b c%.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name} é")
    want = {n: f"text of {n} é" for n in ("_template.md", "sub/_index.md", "_dir/x.md", "plain.md", "a+b c%.md")}
    monkeypatch.chdir(tmp_path)
    for given in (str(root), f"{root}/", f"file:{root}", f"file://{root}"):
        got = {r.path: r for r in src.scan_files(spark, given).collect()}
        assert {p: r.content for p, r in got.items()} == want, given
        assert all(r.size == len(r.content.encode()) and r.mtime is not None for r in got.values())
    assert {r.name for r in src.scan_files(spark, str(root)).where("path like '%_index.md'").collect()} == {"_index"}


# --- streaming -------------------------------------------------------------------------------


def _feed(spark, tmp_path, batches):
    folder = str(tmp_path / "feed")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, stream.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_debounce_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{rng.choice('abc')}.md", None, "modify", BASE + dt.timedelta(milliseconds=rng.randrange(0, 20_000))) for _ in range(60)]
    rows.sort(key=lambda r: r[3])
    flush = [("zz.md", None, "modify", BASE + dt.timedelta(hours=2))]
    folder = _feed(spark, tmp_path, [rows[:20], rows[20:40], rows[40:], flush])
    q = (
        stream.debounced(stream.read_changes(spark, folder))
        .writeStream.format("memory").queryName("deb").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    got = {(r.path, r.n) for r in spark.table("deb").collect()}
    batch = changes.debounce(spark.createDataFrame(rows, stream.CHANGE_SCHEMA))
    first = {(r.path, r.first.timestamp(), r["last"].timestamp(), r.n) for r in spark.table("deb").collect()}
    want = {(r.path, r.first_us / 1e6, r.last_us / 1e6, r.n) for r in batch.collect()}
    assert {(a, round(b, 3), round(c, 3), n) for a, b, c, n in first} == {(a, round(b, 3), round(c, 3), n) for a, b, c, n in want}
    assert got == {(p, n) for p, _, _, n in want}


def test_stream_keeps_index_equal_to_notes(spark, tmp_path):
    state = {f"d/{i}.md": (f"# T{i}\ntext {i}", 0) for i in range(8)}
    notes = _notes(spark, state)
    store = StoredIndex.create(notes, str(tmp_path / "ix"), IndexSettings(exclude_folders="tmp"))
    vectors = stage(chunk_documents(notes).join(store.files(), "path").select("path", "hash", "chunk_id", F.array(F.lit(1.0)).alias("embedding")))
    state["d/1.md"] = ("# T1\nnew text [[renamed]]", 5)
    state["d/renamed.md"] = state.pop("d/2.md")
    del state["d/3.md"]
    state["d/4.md"] = (state["d/4.md"][0], 9)
    at = lambda s: BASE + dt.timedelta(seconds=s)
    events = [
        [("d/1.md", None, "modify", at(1)), ("d/1.md", None, "modify", at(5)), ("d/renamed.md", "d/2.md", "rename", at(6))],
        [("d/3.md", None, "delete", at(7)), ("d/4.md", None, "modify", at(9)), ("x.txt", None, "modify", at(9))],
    ]
    folder = _feed(spark, tmp_path, events)
    keep = stream.IndexMaintainer(lambda: _notes(spark, state), store)
    q = stream.maintain_index(stream.read_changes(spark, folder), keep, str(tmp_path / "cp2"), interval=None)
    q.awaitTermination(240)
    assert q.exception() is None
    want = {(r.chunk_id, r.content) for r in chunk_documents(_notes(spark, state)).collect()}
    assert {(r.chunk_id, r.content) for r in store.chunks().collect()} == want
    assert {r.path: r.mtime for r in store.files().collect()} == {r.path: r.mtime for r in _notes(spark, state).collect()}
    assert [(r.src, r.dst) for r in store.edges().collect()] == [("d/1.md", "d/renamed.md")]
    same_index(spark, store, _notes(spark, state))
    # changed and removed notes lost their vectors, a touched one kept them
    assert {r.path for r in store.live_vectors(vectors).collect()} == {f"d/{i}.md" for i in (0, 4, 5, 6, 7)}
    # a repeated batch changes nothing, even if the notes have moved on
    state["d/5.md"] = ("# later", 11)
    n = store._files().agg(F.max("batch")).first()[0]
    keep(spark.createDataFrame([("d/5.md", None, "modify", at(1))], stream.CHANGE_SCHEMA), 0)
    assert {(r.chunk_id, r.content) for r in store.chunks().collect()} == want and store._files().agg(F.max("batch")).first()[0] == n
    # a new checkpoint counts batches from 0 again and must not meet the first stream's rows
    state["d/1.md"] = ("# T1\nthird text", 20)
    state["tmp/z.md"] = ("# hidden", 20)
    more = str(tmp_path / "feed2")
    rows = [("d/1.md", None, "modify", at(20)), ("tmp/z.md", None, "modify", at(21))]
    spark.createDataFrame(rows, stream.CHANGE_SCHEMA).coalesce(1).write.parquet(more)
    again = stream.IndexMaintainer(lambda: _notes(spark, state), StoredIndex.open(spark, store.root, store.settings))
    q = stream.maintain_index(stream.read_changes(spark, more), again, str(tmp_path / "cp3"), interval=None)
    q.awaitTermination(240)
    assert q.exception() is None and again.stream != keep.stream
    got = {r.path: r.content for r in store.chunks().where("path in ('d/1.md', 'tmp/z.md')").collect()}
    assert set(got) == {"d/1.md"} and "third text" in got["d/1.md"]


# --- stored index ----------------------------------------------------------------------------


def same_index(spark, store, notes):
    """Postings, frequencies, norms and hits of the store equal those of an index built from the notes."""
    chunks = chunk_documents(notes)
    fresh, kept = text_index.build_index(chunks, "chunk_id", "content", ["path", "chunk_index"]), store.text_index()
    rows = lambda df: sorted(map(str, df.collect()))
    assert kept.n_docs == fresh.n_docs
    assert rows(kept.postings.select("chunk_id", "term", "n", "tf")) == rows(fresh.postings.select("chunk_id", "term", "n", "tf"))
    assert rows(kept.terms.select("term", "df", "idf")) == rows(fresh.terms.select("term", "df", "idf"))
    norm = F.round("norm", 9).alias("norm")
    assert rows(kept.norms.select("chunk_id", "path", "chunk_index", norm)) == rows(fresh.norms.select("chunk_id", "path", "chunk_index", norm))


WORDS = ["# A", "text one", "## B", "more text [[d/3]]", "", "日本語", "alpha beta", "beta gamma"]


def test_stored_index_follows_the_notes(spark, tmp_path):
    rng = random.Random(6)
    state = {f"d/{i}.md": ("\n".join(rng.choices(WORDS, k=7)), 0) for i in range(20)}
    store = StoredIndex.create(_notes(spark, state), str(tmp_path / "ix"))
    same_index(spark, store, _notes(spark, state))
    assert store.update(_notes(spark, state)) is None  # nothing to do, nothing written
    for step in range(1, 4):
        for p in rng.sample(sorted(state), 3):
            state[p] = ("\n".join(rng.choices(WORDS, k=7)), step)
        gone = rng.choice(sorted(state))
        was = state.pop(gone)
        state[f"d/new{step}.md"] = ("# New\nalpha text", step)
        touched = rng.choice(sorted(state))
        state[touched] = (state[touched][0], step)  # a new time, the same text
        assert store.update(_notes(spark, state)) == step
        notes = _notes(spark, state)
        assert sorted(map(str, store.chunks().select("chunk_id", "content", "heading").collect())) == sorted(
            map(str, chunk_documents(notes).select("chunk_id", "content", "heading").collect())
        )
        assert {r.path: r.mtime for r in store.files().collect()} == {r.path: r.mtime for r in notes.collect()}
        assert sorted(map(str, store.edges().collect())) == sorted(map(str, links.note_edges(notes).collect()))
        same_index(spark, store, notes)
        if step == 2:
            state[gone] = (was[0], 9)  # a deleted note comes back
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "日本"), (3, "none of it")], "query_id long, text string")
    found = Retriever.stored(StoredIndex.open(spark, store.root), notes=_notes(spark, state)).search(queries, 4, 0.1)
    want = Retriever.build(chunk_documents(_notes(spark, state))).search(queries, 4, 0.1)
    assert found.count() > 4 and sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))


def test_update_reads_only_the_asked_paths(spark, tmp_path):
    state = {f"{i}.md": (f"text {i}", 0) for i in range(6)}
    store = StoredIndex.create(_notes(spark, state), str(tmp_path / "ix"))
    for i in range(6):
        state[f"{i}.md"] = (f"other {i}", 1)
    asked = spark.createDataFrame([("1.md",), ("1.md",), ("9.md",)], "path string")
    assert store.update(_notes(spark, state), asked) == 1
    assert {r.path: r.content.split()[0] for r in store.chunks().collect()} == {f"{i}.md": "other" if i == 1 else "text" for i in range(6)}
    # what a loss left of an unfinished batch does not count, and the next one replaces it
    half = store.spark.read.parquet(f"{store.root}/terms/batch=1")
    half.write.parquet(f"{store.root}/terms/batch=2")
    store.spark.read.parquet(f"{store.root}/postings/batch=0").write.parquet(f"{store.root}/postings/batch=2")
    now = {p: (v if p == "1.md" else (f"text {p[0]}", 0)) for p, v in state.items()}
    same_index(spark, store, _notes(spark, now))
    assert store.update(_notes(spark, state)) == 2
    same_index(spark, store, _notes(spark, state))


def test_stored_index_is_opened_with_its_settings_only(spark, tmp_path):
    notes = _notes(spark, {"a.md": ("x y", 1), "Old/b.md": ("z", 1)})
    store = StoredIndex.create(notes, str(tmp_path / "ix"), IndexSettings("paragraph", 100, " Old ,Tmp"))
    assert [r.path for r in store.files().collect()] == ["a.md"]
    opened = lambda *a: StoredIndex.open(spark, store.root, IndexSettings(*a)) is not None
    assert opened("paragraph", 100, "Old,Tmp")
    assert not opened("section", 100, "Old,Tmp") and not opened("paragraph", 101, "Old,Tmp") and not opened("paragraph", 100, "Old")
    assert StoredIndex.open(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(ValueError):
        StoredIndex.create(notes, store.root)


def test_stored_index_of_nothing(spark, tmp_path):
    store = StoredIndex.create(_notes(spark, {"a.md": ("x", 1)}).limit(0), str(tmp_path / "ix"))
    assert store.files().count() == store.chunks().count() == store.edges().count() == 0
    assert store.update(_notes(spark, {"a.md": ("word", 1)})) == 1
    same_index(spark, store, _notes(spark, {"a.md": ("word", 1)}))


def test_stream_rename_keeps_both_paths(spark, tmp_path):
    rows = [("b.md", None, "modify", BASE), ("new.md", "b.md", "rename", BASE + dt.timedelta(milliseconds=200))]
    flush = [("zz.md", None, "modify", BASE + dt.timedelta(hours=2))]
    folder = _feed(spark, tmp_path, [rows, flush])
    q = (
        stream.debounced_changes(stream.read_changes(spark, folder))
        .writeStream.format("memory").queryName("ren").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    assert {(r.path, r.op) for r in spark.table("ren").collect()} == {("b.md", "delete"), ("new.md", "modify")}
