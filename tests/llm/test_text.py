"""Quality rules, personal data, pieces, mixing and archives against brute force."""

import collections
import hashlib
import random
import re
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import queries
from noteloom.llm.mixing import mix, take_mix
from noteloom.llm.pieces import CharMap, PieceModel, decode_documents, encode_documents
from noteloom.llm.pii import find_personal_data, redact, reliabilities
from noteloom.llm.quality_rules import judge_quality, keep_good
from noteloom.llm.warc import archive_pages, arc_record, arc_version_block, parse_arc, parse_warc, warc_date, warc_record
from tests.llm.frames import TEXTS, edge_docs, empty_docs, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def base_counts(text):
    w = words(text)
    threes = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if threes[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def quality_rows(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return sorted(((r.doc_id, *[r[n] for n in names]) for r in df.collect()), key=repr)


def test_quality_counts(spark, sf):
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    want = sorted(((i, *base_counts(t)) for i, t in TEXTS), key=repr)
    assert quality_rows(judge_quality(edge_docs(spark), trusted)) == want
    rows = documents(spark, sf)
    assert quality_rows(queries.op2_quality_rules(spark, sf)) == sorted(((i, *base_counts(t)) for i, t in rows), key=repr)


def test_quality_verdict(spark, sf):
    """Against the ratio in plain Python, with the counts of all documents."""
    import math

    import xxhash

    rows, cells, smooth = documents(spark, sf), 1 << 15, 50.0
    good = {r.doc_id for r in queries.good_rows(spark, sf).collect()}
    cell = lambda *parts: _chain(xxhash, parts) % cells

    def grams(t):
        w = words(t)
        shape = t
        for a, b in ((r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"\d+", "0")):
            shape = re.sub(a, b, shape)
        s = words(shape)
        x, y = [_chain(xxhash, [v]) for v in w], [_chain(xxhash, ["shape", v]) for v in s]
        return [h % cells for h in x] + [cell(a, b) for a, b in zip(x, x[1:])] + [cell(a, b) for a, b in zip(y, y[1:])]

    raw, fine, each = collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        each[i] = grams(t)
        raw.update(each[i])
        if i in good:
            fine.update(each[i])
    n, m = sum(raw.values()), sum(fine.values())
    p = lambda c, total: (c + smooth * total / n) / (total * (1 + smooth * cells / n))
    for r in judge_quality(spark.read.parquet(f"{sf}/documents.parquet"), queries.good_rows(spark, sf)).collect():
        ratio = [round(math.log(p(fine[c], m) / p(raw[c], n)) * 1e6) for c in each[r.doc_id]]
        mean = sum(ratio) / max(1, len(ratio)) / 1e6
        assert abs(mean - r.llr) < 1e-5
        assert r.kept == (not r.base_failed and mean >= -0.2)


def test_order_of_words_counts(spark):
    """Usual words in garbage order score lower than the same words in their order."""
    rng = random.Random(9)
    follow = {f"w{k}": [f"w{(7 * k + j) % 60}" for j in range(3)] for k in range(60)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    one = walk(120)
    mixed = rng.sample(one, len(one))
    good = [(k, " ".join(walk(120))) for k in range(40)] + [(100, " ".join(one))]
    bad = [(200 + k, " ".join(rng.sample(w, len(w)))) for k in range(40) for w in [walk(120)]] + [(300, " ".join(mixed))]
    trusted = spark.createDataFrame([(i,) for i, _ in good[:40]], "doc_id long")
    got = {r.doc_id: r.llr for r in judge_quality(edge_docs(spark, good + bad), trusted).collect()}
    assert got[100] > got[300] + 0.05


def _chain(xxhash, parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), seed=seed)
    return seed if seed < 1 << 63 else seed - (1 << 64)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert judge_quality(empty_docs(spark), none).count() == 0
    docs = edge_docs(spark)
    left = keep_good(docs, none)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(i or 0 for i, t in TEXTS if not base_counts(t)[-1])


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    twice = [int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))]
    return kind == "email" or 16 <= len(d) <= 19 and sum(twice) % 10 == 0


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PII = [
    (1, "mail é a.b@c.d-e.fr, x@y ip 1.2.3.4.5.6.7.8 and 300.1.1.1 010.0.0.255 call +1 (269) 555-3296 now"),
    (2, "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111"),
    (3, "+1 (269) 555-3296 4524132264652876 and a@b.c_d@e.f"),
    (4, "1 - 2 -- 3 +12345678.. +1() 9"),
]


def test_personal_data(spark, sf):
    for rows, df in (
        (TEXTS + PII, find_personal_data(edge_docs(spark, TEXTS + PII))),
        (documents(spark, sf), queries.op7_personal_data(spark, sf)),
    ):
        want = sorted(
            (repr(i), *[sum(s.startswith(k) for s in spans) for k in KINDS], hashlib.sha256(",".join(spans).encode()).hexdigest())
            for i, spans in ((i, base_spans(t)) for i, t in rows)
        )
        got = df.collect()
        assert sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        texts = dict(rows)
        for r in got:
            spans = [s for s in r.spans.split(",") if s]
            if list(dict(rows)).count(r.doc_id) == 1 and [i for i, _ in rows].count(r.doc_id) == 1:
                assert set(base_spans(texts[r.doc_id])) <= set(spans)
    assert find_personal_data(empty_docs(spark)).count() == 0


def test_redaction(spark):
    docs = edge_docs(spark, TEXTS + PII)
    clean = redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.where("doc_id in (1, 2, 5)").collect() if r.text != TEXTS[0][1]}
    assert texts[1].startswith("mail é [EMAIL], x@y ip [IP].") and "+1" not in texts[1]
    assert texts[2].startswith("card [CARD] or ") and texts[5] is None


def test_reliabilities():
    """A labeler that votes at random gets no say; agreeing ones do."""
    counts = {(a, a, a, r, 0): 100 for a in (1, -1) for r in (1, -1)}
    belief = reliabilities(counts)
    assert belief[1, 1, 1, -1, 0] > 0.95 and belief[-1, -1, -1, 1, 0] < 0.05


def test_pieces_equal_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for rows, docs in ((TEXTS, edge_docs(spark)), (documents(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))):
        encoded = encode_documents(docs, MODEL)
        got = sorted(((repr(r.doc_id), list(r.ids)) for r in encoded.collect()))
        assert got == sorted((repr(i), library.encode(t or "")) for i, t in rows)
        texts = sorted((repr(r.doc_id), r.text) for r in decode_documents(encoded, MODEL).collect())
        assert texts == sorted((repr(i), library.decode(library.encode(t or ""))) for i, t in rows)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.op3_sentencepiece(spark, sf).collect():
        ids = library.encode(dict(documents(spark, sf))[r.doc_id]) if r.doc_id < 20 else None
        if ids is not None:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert encode_documents(empty_docs(spark), MODEL).count() == 0


def test_piece_spans():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = PieceModel(open(MODEL, "rb").read())
    for text in ["", " ", "a  b", "日本 é👍\n", "x" * 300, "▁ ▁▁x", *[t for _, t in TEXTS[:5]]]:
        ids, starts, ends = model.encode(text.encode())
        pieces = library.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in pieces]


def compiled(pairs):
    """A character map for a few short keys, laid out by search like the real ones."""
    trie = {}
    for key, value in pairs.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = value
    blob, offsets = b"", {}
    for value in pairs.values():
        offsets[value] = len(blob)
        blob += value + b"\0"
    units, used = [0] * 4096, {0}

    def place(node, at):
        labels = [0 if b == -1 else b for b in node]
        base = next(x for x in range(1, 4096) if all((at ^ x) ^ c not in used and (at ^ x) ^ c < 4096 for c in labels) and x < 1 << 21)
        units[at] |= base << 10 | (256 if -1 in node else 0)
        for c in labels:
            used.add(at ^ base ^ c)
        for b, child in node.items():
            spot = at ^ base ^ (0 if b == -1 else b)
            if b == -1:
                units[spot] = 1 << 31 | offsets[child]
            else:
                units[spot] = b
                place(child, spot)

    place(trie, 0)
    raw = struct.pack("<4096I", *units)
    return struct.pack("<I", len(raw)) + raw + blob


def test_character_map():
    table = {b"A": b"a", "ﬁ".encode(): b"fi", b"ab": b"X", "é".encode(): "é".encode(), b"\t": b" "}
    known = CharMap(compiled(table))
    assert known.longest(b"abc", 0) == (2, b"X") and known.longest(b"ac", 0) is None and known.longest(b"zA", 1) == (1, b"a")
    model = PieceModel(open(MODEL, "rb").read())
    model.char_map, model.trim = known, True
    norm, source = model.normalize("  A \tﬁab é ".encode())
    assert norm == "▁a▁fiX▁é"
    # blank in front and A come from byte 2, the ligature's two letters from its first byte
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 5, 8, 10, 10, 10, 11, 11, 11, 13][: len(source)] or source[-1] == 13
    ids, starts, ends = model.encode("  A \tﬁab é ".encode())
    assert starts[0] == 2 and ends[-1] == 13 and (ends >= starts).all()


def brute_targets(rows):
    size = collections.Counter()
    for s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, free, out = sum(size.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        for s in over or free:
            out[s] = 3 * size[s] if over else left * weight[s] / total
        left -= sum(out[s] for s in over)
        free -= set(over) if over else free
    return out


@pytest.mark.parametrize("which", ["edge", "table"])
def test_mixing(spark, sf, which):
    docs = edge_docs(spark) if which == "edge" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    want = brute_targets([(s, n) for _, s, n in rows])
    got = mix(docs).collect()
    assert sorted((repr(r.doc_id), repr(r.source), r["size"]) for r in got) == sorted((repr(i), repr(s), n) for i, s, n in rows)
    taken, biggest = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1
    assert sorted(map(repr, got)) == sorted(map(repr, mix(docs.repartition(5)).collect()))
    assert take_mix(docs).count() == sum(r.copies for r in got)
    assert take_mix(docs).columns == docs.columns


def test_mixing_empty(spark):
    assert mix(empty_docs(spark)).count() == 0
    blank = edge_docs(spark, [(1, None), (2, "")])
    assert [(r.target, r.taken) for r in mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_mixing_keeps_probabilities(spark):
    """Over many seeds every document is taken as often as its rate says."""
    docs = edge_docs(spark, [(i, " ".join(["w"] * (5 + 7 * (i % 5)))) for i in range(40)])
    total = collections.Counter()
    for seed in range(12):
        for r in mix(docs, block=8, seed=seed).collect():
            total[r.doc_id % 5] += r.copies / (r.target / r.source_size)
    assert all(abs(v / (12 * 8) - 1) < 0.35 for v in total.values())


def test_arc_and_warc_formats():
    body = arc_version_block("x.arc", 2)
    block = b"HTTP/1.1 200 OK\r\n\r\nab\r\n\r\nWARC/1.0\r\n"
    data = body + b"\n" + arc_record(2, "x.arc", len(body) + 1, "http://a/", "200102030405", block) + b"\n\n"
    one = list(parse_arc(data))
    assert [(n, f["URL"], f["Archive-length"], b) for n, _, f, b in one] == [("x.arc", "http://a/", str(len(block)), block)]
    old = arc_version_block("y.arc", 1) + b"\nhttp://b/ 1.2.3.4 20010203040506 text/html; charset=x 3\nabc"
    assert [f["Content-type"] for _, _, f, _ in parse_arc(old)] == ["text/html; charset=x"]
    with pytest.raises(ValueError):
        list(parse_arc(data[:-20]))
    assert warc_date("200102030405") == "2001-02-03T04:05:00Z" and warc_date("junk") == "1970-01-01T00:00:00Z"
    two = warc_record("response", [("A", "b")], block) + b"\r\n\r\n" + warc_record("resource", [], b"") + b"\r\n\r\n"
    assert [(h["warc-type"], b) for h, b in parse_warc(two)] == [("response", block), ("resource", b"")]


def test_archive_edges(spark):
    rows = [(1, "http://a b/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "y"), (5, "u", "é\r\n\r\nWARC/1.0\r\n" * 3), (5, "u", "é\r\n\r\nWARC/1.0\r\n" * 3), (6, "u", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string")
    got = archive_pages(pages).collect()
    payload = lambda p: (p or "").encode()
    assert sorted((repr(r.page_id), r.payload_bytes) for r in got) == sorted((repr(i), len(payload(p))) for i, _, p in rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[2, "revisit", 1] == 1 and kinds[4, "revisit", 3] == 1 and kinds[5, "revisit", 5] == 1 and kinds[None, "response", None] == 1
    assert archive_pages(pages.limit(0)).count() == 0


def test_pipeline_drops_near_copies_from_80_percent(spark, sf):
    """104 distinct words, the last ones replaced: 90 of 110 and 88 of 112 shared windows of five words."""
    rows = []
    for k, changed in enumerate((10, 12)):
        w = [f"d{k}w{j}" for j in range(104)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:-changed] + [f"x{k}n{j}" for j in range(changed)]))]
    left = corpus_pipeline.near_duplicates(spark, edge_docs(spark, rows), sf)
    assert sorted(r.doc_id for r in left.collect()) == [0, 10, 11]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf))
        counts.append(docs.count())
        assert name == "token_ids" or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5] > 0
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(max(r.ids, default=0) < library.get_piece_size() for r in docs.limit(20).collect())
    sizes = corpus_pipeline.run(spark, sf).agg(F.count("*")).first()[0]
    assert sizes == counts[-1]


CLASHES = ["_cuts", "_row", "row", "_d", "_t", "_key", "_i", "_text", "_k", "_s", "lead", "root", "n_words", "copies", "uid", "_x"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, sf, stage):
    """Columns named like those inside the operators keep their values, row by row; empty tables stay empty."""
    docs = edge_docs(spark, TEXTS + PII)
    for name in CLASHES:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.concat(F.lit(f"mine {name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    name, run = stage
    out = run(spark, docs, sf)
    assert out.columns == docs.columns
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    known = {str([r[c] for c in others]) for r in docs.collect()}
    got = [str([r[c] for c in others]) for r in out.collect()]
    assert got and set(got) <= known
    nothing = run(spark, docs.limit(0), sf)
    assert nothing.columns == docs.columns and nothing.count() == 0
