"""Near duplicates, repeated passages and near vectors against brute force."""

import math
import random
import re

import numpy as np
import pytest

from noteloom.llm import queries
from noteloom.llm.embed_dedup import most_differences, near_vectors, passes_at, window_pairs
from noteloom.llm.graph import components
from noteloom.llm.minhash import keep_one_of_each, least_matches, minhash_components
from noteloom.llm.substring_dedup import remove_repeats
from tests.llm.frames import TEXTS, edge_docs, empty_docs, prose, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, text) rows to the component's smallest id of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        lead = min(ids) if ids else None
        out.append((i, len(sets[k]), lead, i == lead))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_edge_rows(spark):
    assert result(minhash_components(edge_docs(spark))) == brute(TEXTS)


def test_empty(spark):
    assert minhash_components(empty_docs(spark)).count() == 0
    assert remove_repeats(empty_docs(spark)).count() == 0
    assert keep_one_of_each(empty_docs(spark)).count() == 0


def near_copies():
    rng = random.Random(3)
    base = prose(7, 90, 10_000).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(i, prose(i + 50, 40)) for i in range(30)]


@pytest.mark.parametrize("block", [2048, 16])
def test_dense_group(spark, block):
    """A group of near copies in one task, and cut into pairs of blocks."""
    rows = near_copies()
    docs = edge_docs(spark, rows)
    assert result(minhash_components(docs, block_sets=block)) == brute(rows)


def test_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op10_minhash_near_dedup(spark, sf)) == brute(rows)


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    kept = sorted([(r.doc_id, r.text) for r in left.collect()], key=repr)
    want = {(i, t) for (i, t), row in zip(TEXTS, [brute(TEXTS)] * len(TEXTS))}
    leads = {r[0] for r in brute(TEXTS) if r[3]}
    assert {(i, t) for i, t in kept} == {(i, t) for i, t in want if i in leads and not (i == 2 and t == TEXTS[1][1])}
    assert len(kept) == len(set(kept))


def test_pruning_table():
    looks = least_matches(120, 12, 85, 1e-4)
    assert looks[-1][0] == 120 and all(a <= b for (_, a), (_, b) in zip(looks, looks[1:]))
    # a pair exactly at the threshold passes every look nearly always
    p = 0.85 + 0.15 / 256
    lost = 0.0
    for seen, least in looks:
        lost += sum(math.comb(seen, k) * p**k * (1 - p) ** (seen - k) for k in range(least))
    assert lost < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)] + [(300, 300 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 200: 200} | dict.fromkeys(range(300, 360), 300)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(spark):
    shared = "this passage of more than eight words stands in several documents"
    docs = edge_docs(spark, [(1, f"Alpha beta. {shared}. Gamma."), (2, f"Other begin. {shared.upper()}. end"), (3, f"{shared}\n{shared}"), (4, "a b. a b."), (5, None)])
    got = {r.doc_id: (r.text, [(x.start, x.end) for x in r.removed]) for r in remove_repeats(docs).collect()}
    assert got[1][1] == [] and got[4][1] == [] and got[5] == (None, [])
    assert got[2] == ("Other begin.  end", [(13, 13 + len(shared) + 1)])
    assert [len(got[3][1])] == [2] or got[3][0].strip() == shared


def plain_units(text, least=8):
    """(start, end, words) of every unit, by the four ways to cut."""
    low = (text or "").translate(LOWER)
    stop = r"[.!?][\"')\]]{0,2}[ \t-\r]"
    out = set()
    for breaks in (["\n"], ["\n", stop], [r"\n[ \t\x0b-\r]*(?=\n)"], [r"\n[ \t\x0b-\r]*(?=\n)", stop]):
        cuts = {0, len(low)}
        for b in breaks:
            for hit in re.finditer(b, low):
                cuts.add(hit.end() + (1 if "(?=" in b else 0))
        cuts = sorted(cuts)
        pieces = [[m for m in re.finditer(r"[^ \t-\r]+", low) if a <= m.start() < b] for a, b in zip(cuts, cuts[1:])]
        pieces = [p for p in pieces if p]
        for i in range(len(pieces)):
            run = []
            for p in pieces[i:]:
                run += p
                if len(run) >= least:
                    out.add((run[0].start(), run[-1].end(), tuple(m.group() for m in run)))
                    break
    return sorted(out)


def plain_removal(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        gone = set()
        for start, end, unit in plain_units(text):
            if unit in seen:
                gone |= set(range(start, end))
            seen.add(unit)
        out[i] = "".join(c for k, c in enumerate(text) if k not in gone)
    return out


VERSE = [" ".join(f"v{7 * line + k}" for k in range(7)) for line in range(10)]
PASSAGES = [
    (1, "Own words here.\n" + "\n".join(VERSE) + "\nand an end"),
    (2, "Another start\n" + "\n".join(VERSE).upper() + "\nother"),
    (3, 'He said "stop." Then (all of them left the old house together.) And so it ended for everyone there.\n\nNew  para graph with\nmore than eight words in its lines'),
    (4, "x\n\n \t\nNew para graph\nwith more than eight\nwords in its lines\n\ntail of it"),
    (5, "First. Then (all of them left the old house together.) And so it\nended for everyone there. Last one"),
    (6, "yes\nno\nmaybe\nyes"),
    (7, "no\nyes\nyes\nmaybe"),
]


def test_short_lines_and_paragraphs(spark):
    got = {r.doc_id: r.text for r in remove_repeats(edge_docs(spark, PASSAGES)).collect()}
    assert got == plain_removal(PASSAGES)
    assert got[2] == "Another start\n\nother"  # ten lines of seven words
    assert "para" not in got[4] and got[6] == PASSAGES[5][1] and got[7] == PASSAGES[6][1]


def test_units_equal_plain_ones(spark):
    """Random texts of few words, line ends, stops and closing marks."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        parts = [rng.choice(["a", "b", "c", "é", "B"]) + rng.choice(["", "", "", ".", '."', "?)", "!"]) for _ in range(rng.randrange(40))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "\n", "\n\n", "\n \n", "\t"]) for p in parts)))
    got = {r.doc_id: r.text for r in remove_repeats(edge_docs(spark, rows)).collect()}
    assert got == plain_removal(rows)


def test_passages_on_edge_rows(spark):
    assert remove_repeats(edge_docs(spark)).count() == len(TEXTS)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "v") for r in rows], "vec_id long, embedding array<float>, label int, dim int, cid string, vector string")


def brute_vectors(rows, threshold=0.98):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(np.float64)
        return v / np.linalg.norm(v)

    u = [unit(v) for _, v, _ in rows]
    link = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j])
             and rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        lead = min(ids) if ids else None
        out.append((rows[i][0], len(link[i]), lead, rows[i][0] == lead))
    return sorted(out, key=repr)


def near_rows():
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((6, 16))
    for i in range(150):
        v = centres[i % 6] + rng.standard_normal(16) * (0.05 if i % 3 else 0.5)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(900 + k, rows[0][1], 0) for k in range(3)] + [(901, rows[0][1], 0)]
    rows += [(950, None, 0), (951, [0.0] * 16, 0), (952, [float("nan")] * 16, 0), (953, [None] * 16, 0), (954, rows[0][1], None)]
    rows += [(955, [], 0), (956, [1.0, 2.0], 0), (957, [2.0, 4.0], 0), (None, rows[0][1], 0), (958, [float("inf")] + [1.0] * 15, 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(spark, block):
    rows = near_rows()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows), block=block).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_vector_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op6_embedding_near_dedup(spark, sf).collect()), key=repr)
    assert got == brute_vectors(rows)


def hot_cluster(n=12_000, dim=32, pairs=400):
    """One label, half of it in a narrow cone with cosines near 0.9; pairs at cosine 0.981 stand apart in the cone."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    axis = unit(rng.standard_normal((1, dim)))
    cone = unit(3 * axis + unit(rng.standard_normal((n // 2, dim))))
    left = cone[:pairs]
    aside = rng.standard_normal((pairs, dim))
    aside = unit(aside - (aside * left).sum(1, keepdims=True) * left)
    right = 0.981 * left + math.sqrt(1 - 0.981**2) * aside
    rows = np.concatenate([cone, right, unit(rng.standard_normal((n // 2 - pairs, dim)))]).astype(np.float32)
    return [(i, v.tolist(), 0) for i, v in enumerate(rows)]


def test_pairs_in_a_hot_cluster_are_found(spark):
    rows = hot_cluster()
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = (v @ v.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(vectors(spark, rows)).collect()}
    missed = sum(int(want[i]) - got[i] for i in got)
    assert want.sum() >= 800 and 0 <= missed <= 0.01 * want.sum()


def test_links_do_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        v = rng.standard_normal(32)
        v /= np.linalg.norm(v)
        aside = rng.standard_normal(32)
        aside -= (aside @ v) * v
        near = 0.981 * v + math.sqrt(1 - 0.981**2) * aside / np.linalg.norm(aside)
        rows += [(2 * i, v.tolist(), i % 10), (2 * i + 1, near.tolist(), i % 10)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = sorted((tuple(r) for r in near_vectors(vectors(spark, rows)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == brute_vectors(rows)


def test_passes_grow_slowly():
    assert passes_at(0, 0.98, 0.0005) == 1 < passes_at(8, 0.98, 0.0005) < passes_at(24, 0.98, 0.0005) < 60


def test_signatures_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    most = most_differences(0.98)
    differ = rng.binomial(128, math.acos(0.98) / math.pi, 200_000)
    assert (differ > most).mean() < 1e-4 and most < 40


def test_window_over_the_whole_order():
    """Each pair at most a window apart in one pass and group, once, however the order is cut into batches."""
    rng = np.random.default_rng(7)
    n, window = 300, 5
    rows = {"nid": np.arange(n), "grp": np.repeat([1, 2], n // 2), "pass": np.repeat([0, 1, 0], n // 3), "run": np.arange(n) // 10}
    rows |= {"s0": rng.integers(0, 4, n), "s1": rng.integers(0, 4, n), "long": np.arange(n) // 10 % 7 == 0}
    def near(i, j):
        bits = bin(rows["s0"][i] ^ rows["s0"][j]).count("1") + bin(rows["s1"][i] ^ rows["s1"][j]).count("1")
        inside = rows["long"][i] and rows["run"][i] == rows["run"][j]
        return rows["grp"][i] == rows["grp"][j] and rows["pass"][i] == rows["pass"][j] and bits <= 2 and not inside
    want = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + window + 1)) if near(i, j)}
    assert set(zip(*(x.tolist() for x in window_pairs(rows, window, 2)))) == want
    cut = []
    for a in range(0, n, 17):
        start = max(0, a - window)
        i, j = window_pairs({f: v[start : a + 17] for f, v in rows.items()}, window, 2, a - start)
        cut += [(int(x) + start, int(y) + start) for x, y in zip(i, j)]
    assert len(cut) == len(set(cut)) and set(cut) == want


@pytest.mark.parametrize("window", [1, 6])
def test_a_narrow_window_finds_what_a_wide_one_does(spark, window):
    """Runs longer than the window are compared in full."""
    rows = near_rows()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows), window=window, block=32).collect()), key=repr)
    assert got == brute_vectors(rows)
