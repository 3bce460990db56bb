"""Centroid clustering, URL filter and hard negatives against plain models and their SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.checks.compare import compare
from noteloom.llm import queries
from noteloom.llm.hard_negatives import LOWEST, _Bucket, exact_products, mine_hard_negatives
from noteloom.llm.heap_clusters import cluster_vectors, clusters_with_inertia, component_limit, pop_expired
from noteloom.llm.queries import RULES
from noteloom.llm.url_filter import DAMPING, UNITS, Rule, filter_urls, host_links, propagate, url_parts

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x string, block string, id string, _anchor string"


def frame(spark, rows):
    """Vectors with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, v, label, "c", "x", "b", "i", "a") for i, v, label in rows], VECTORS)


def spread_rows(n, dim, seed, groups=6, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dim)) * 3
    rows = []
    for i in range(n):
        v = centers[i % groups] + rng.standard_normal(dim) * 0.4
        rows.append((int(i), [float(np.float32(c)) for c in v], int(rng.integers(labels))))
    return rows


def odd_rows(dim):
    return [
        (900, None, 1),
        (901, [0.5] * (dim - 1), 1),
        (902, [None] + [0.5] * (dim - 1), 1),
        (903, [float("nan")] + [0.5] * (dim - 1), 1),
        (904, [float("inf")] + [0.5] * (dim - 1), 1),
        (905, [], 1),
        (906, [0.0] * dim, 1),
        (907, [0.0] * dim, 2),
        (700, [0.25] * dim, None),
        (700, [0.25] * dim, 1),
        (700, [0.25] * dim, 1),
        (None, [0.25] * dim, 1),
        (None, [-0.25] * dim, 0),
        (800, [0.3] * dim, 0),
    ]


@pytest.mark.parametrize("name", ["op11_heap_clusters", "op12_url_filter", "op13_hard_negatives", "op1_warc_from_arc", "op4_repeated_passages", "op6_embedding_near_dedup", "op10_minhash_near_dedup"])
def test_sql(spark, sf, name):
    assert compare(spark, sf, queries.QUERIES[name], queries.ORACLES[name]) == ""


# centroid clustering


def plain_clusters(rows, k, rounds, dim, scale=1024):
    limit = component_limit(dim)
    kept = []
    for i, v, _ in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(max(-limit, min(limit, c * scale))) for c in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(centers)):
            own = [x for (_, x), c in zip(kept, of) if c == j]
            if own:
                centers[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=repr), centers


@pytest.mark.parametrize("block,k", [(4096, 5), (16, 5), (7, 1), (50, 40)])
def test_clusters_equal_plain_rounds(spark, block, k):
    rows = spread_rows(120, 4, 1) + odd_rows(4) + [(2000 + i, [1.5, -1.0, 0.0, 2.0], 0) for i in range(60)]
    found = cluster_vectors(frame(spark, rows), k=k, rounds=4, dim=4, block=block)
    want, centers = plain_clusters(rows, k, 4, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()), key=repr) == want
    assert found.centroids == centers


def test_settled_vectors_are_not_scanned_again(spark):
    rows = spread_rows(600, 4, 2, groups=4)
    found = cluster_vectors(frame(spark, rows), k=4, rounds=10, dim=4)
    first, *later = found.rounds
    assert first == (600, 600)
    assert sum(expired for expired, _ in later) < 600 * len(later) / 2
    assert all(moved <= expired for expired, moved in found.rounds)


def test_heap_gives_expired_members_only():
    import heapq

    rng = random.Random(4)
    heap = [(rng.random(), i) for i in range(200)]
    heapq.heapify(heap)
    keys = dict((i, key) for key, i in heap)
    out = pop_expired(heap, 0.3)
    assert sorted(out) == sorted(i for i, key in keys.items() if key <= 0.3)
    assert len(heap) == 200 - len(out) and pop_expired(heap, 0.3) == []


def test_large_components_and_ties(spark):
    rows = [(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, [1.0, 0.0], 0)]
    found = cluster_vectors(frame(spark, rows), k=3, rounds=2, dim=2)
    want, centers = plain_clusters(rows, 3, 2, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()) == want and found.centroids == centers


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 0), (2, [1.0], 0)]):
        got = clusters_with_inertia(frame(spark, rows), dim=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_inertia(spark):
    rows = spread_rows(50, 4, 3)
    got = clusters_with_inertia(frame(spark, rows), k=3, rounds=3, dim=4).collect()
    want, centers = plain_clusters(rows, 3, 3, 4)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


# hard negatives


def plain_negatives(rows, scale=256, k=5, low=80):
    kept = []
    for i, v, label in rows:
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            cap = min(math.floor(math.sqrt((1 << 55) / len(v))), (1 << 31) - 1)
            kept.append((i, label, [math.floor(max(-cap, min(cap, c * scale))) for c in v]))
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (anchor, label, x) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), last(i), i, other == label) for j, (i, other, y) in enumerate(kept) if j != at and len(y) == len(x)]
        scored.sort(key=lambda s: s[:2])
        for s, _, i, _ in [r for r in scored if r[3]][:k]:
            fits = [r for r in scored if not r[3] and low * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(anchor, i, n + 1, r[2], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out, key=repr)


def mined(df, **options):
    return sorted((tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("bucket", [1024, 8])
def test_negatives_equal_brute_force(spark, bucket):
    """Vectors of very different lengths, one very common vector, copies, null ids."""
    rng = random.Random(5)
    rows = [(i * 10, [c * rng.choice([0.1, 1, 5]) for c in v], label) for i, v, label in spread_rows(160, 6, 7)]
    rows += [(10_000 + 10 * i, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0], i % 3) for i in range(60)]
    rows += odd_rows(6) + [(5000, [0.5, 0.25], 1), (5001, [0.5, 0.2], 1), (5002, [0.5, 0.2], 2)]
    want = plain_negatives(rows)
    assert len(want) > 100
    assert mined(frame(spark, rows), bucket=bucket) == want


def test_negatives_in_turns(spark, monkeypatch):
    """Anchors beyond the broadcast bound meet the buckets turn by turn."""
    import noteloom.llm.hard_negatives as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 600)
    rows = [(i * 50, v, label) for i, v, label in spread_rows(40, 4, 9)]
    assert mined(frame(spark, rows), bucket=8) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)])) == []  # no anchor
    assert mined(frame(spark, [(100, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)])) == []  # no positive


def test_coordinates_never_lose_a_row():
    rng = np.random.default_rng(8)
    bucket = _Bucket.__new__(_Bucket)
    bucket.rows = rng.integers(-300, 300, (400, 8)).astype(np.int32)
    x = bucket.rows.astype(np.float64)
    lengths = np.sqrt((x * x).sum(1))
    bucket.unit = x / lengths[:, None]
    bucket.order = np.argsort(bucket.unit, axis=0)
    bucket.lists = np.take_along_axis(bucket.unit, bucket.order, 0)
    tried = 0
    for _ in range(50):
        q = rng.integers(-300, 300, 8)
        length = math.sqrt(int(q @ q))
        scores = exact_products(bucket.rows, q)
        low = int(np.sort(scores)[-5])
        unit = q / length
        slots = bucket.candidates(unit, np.argsort(-np.abs(unit))[:4], low / (length * lengths.max()))
        assert set(np.flatnonzero(scores >= low)) <= set(slots.tolist())
        tried += len(slots)
    assert tried < 50 * 400


def test_exact_beyond_doubles():
    a = np.array([[(1 << 27) + 1, 1 << 27]], np.int64)
    assert exact_products(a, a[0]).tolist() == [((1 << 27) + 1) ** 2 + (1 << 54)]
    assert LOWEST < 0


# url filter


def page(i, url, html=""):
    return (i, url, html, "v", "h", 5, "p")


PAGES = "page_id long, url string, html string, verdict string, host string, n_pages int, path string"


@pytest.mark.parametrize(
    "url,want",
    [
        (None, ("", "")),
        ("no scheme", ("", "")),
        ("", ("", "")),
        ("http://", ("", "")),
        ("HTTP://A.Com", ("a.com", "")),
        ("x://É.com:80/P?q#f", ("É.com:80", "/P")),
        ("a://b?c/d", ("b", "")),
        ("a://b#c?d/e", ("b", "")),
        ("a://b/c#d?e", ("b", "/c")),
        ("a?b#c://d/e", ("d", "/e")),
        ("a://b/c://d/e", ("b", "/c://d/e")),
        ("a:// b /c\n/d", (" b ", "/c\n/d")),
    ],
)
def test_url_parts(spark, url, want):
    host, path = url_parts("u")
    assert tuple(spark.createDataFrame([(url,)], "u string").select(host, path).first()) == want


def test_longest_rule_wins(spark):
    rows = [
        page(1, "http://www.example.com/en/x"),
        page(2, "http://m.example.com/en/x"),
        page(3, "http://example.com/en"),
        page(4, "http://badexample.com/en/"),
        page(5, "http://com"),
        page(6, "http://a.net/es/"),
        page(7, "http://b.net/de/"),
        page(8, None),
        page(8, None),
    ]
    got = sorted(tuple(r) for r in filter_urls(spark.createDataFrame(rows, PAGES), RULES).select("page_id", "rule", "verdict").na.fill("-").collect())
    assert got == [
        (1, "www.example.com/en/", "allow"),
        (2, "example.com/en/", "block"),
        (3, "com/", "allow"),
        (4, "com/", "allow"),
        (5, "-", "allow"),
        (6, "net/es/", "block"),
        (7, "-", "allow"),
        (8, "-", "allow"),
        (8, "-", "allow"),
    ]


def test_links_of_pages(spark):
    html = """<a HREF = 'http://B.org/x'>1</a><a href="//c.org">2</a><img src=https://b.org/y?z><a href="/own">3</a>
    <a href="http://a.org/self">4</a><form action="x://d.org#f"><a href="mailto:x@y.org"> http://not.a.link/ <a href="">"""
    rows = [("a.org", html), ("a.org", html), ("b.org", None), ("", '<a href="http://a.org">')]
    got = host_links(spark.createDataFrame(rows, "host string, html string")).collect()
    assert sorted(tuple(r) for r in got) == [("a.org", "b.org", 2), ("a.org", "c.org", 2), ("a.org", "d.org", 2)]


def plain_ranks(edges, seeds, rounds):
    """edges (kind, src, dst) -> n, seeds (kind, host) -> mass."""
    total = {}
    for (kind, src, _), n in edges.items():
        total[kind, src] = total.get((kind, src), 0) + n
    half_up = lambda x: math.floor(x + 0.5)
    start = {k: half_up(m * (1 - DAMPING)) for k, m in seeds.items()}
    ranks = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for (kind, src, dst), n in edges.items():
            if (kind, src) in ranks:
                new[kind, dst] = new.get((kind, dst), 0) + half_up(ranks[kind, src] * DAMPING / total[kind, src] * n)
        ranks = {k: m for k, m in new.items() if m > 0}
    return ranks


@pytest.mark.parametrize("links_per_task", [200_000, 3])
def test_ranks(spark, links_per_task):
    rng = random.Random(11)
    edges = {(kind, f"h{rng.randrange(12)}", f"h{rng.randrange(40)}"): rng.randrange(1, 9) for _ in range(120) for kind in ("trust", "distrust")}
    seeds = {("trust", "h1"): 10**14, ("trust", "h2"): 10**14, ("distrust", "h3"): 10**14}
    got = propagate(
        spark.createDataFrame([(*k, n) for k, n in edges.items()], "kind string, src string, dst string, n long"),
        spark.createDataFrame([(*k, m) for k, m in seeds.items()], "kind string, host string, mass long"),
        6,
        links_per_task=links_per_task,
    )
    assert {(r.kind, r.host): r.mass for r in got.collect()} == plain_ranks(edges, seeds, 6)


def linked_pages():
    rng = random.Random(12)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(40)]
    rows = []
    for i in range(200):
        host = rng.choice(hosts[:5] if i % 3 == 0 else hosts)
        links = "".join(f'<a href="http://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(6)))
        rows.append(page(i, f"http://{host}/{rng.choice(['en', 'fr', 'es'])}/{i}", links))
    return rows + [page(None, "http://h1.org/", None), page(7, None, '<a href="http://h1.org">'), page(8, "x", "y" * 100_000)]


def test_verdicts_equal_sql_on_a_link_graph(spark):
    """The given tables hold no links between hosts; this fixture does."""
    import pandas as pd

    rows = linked_pages()
    got = filter_urls(spark.createDataFrame(rows, PAGES), RULES)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([r[:3] for r in rows], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    cur = con.execute(queries.urls_sql())
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    judged = [dict(zip(names, r)) for r in want if dict(zip(names, r))["rule"] is None]
    assert {r["verdict"] for r in judged} == {"allow", "block"} and any(r["trust"] and r["distrust"] for r in judged)


def test_a_host_that_links_to_blocked_hosts_is_blocked(spark):
    link = '<a href="http://bad.net/fr/1">'
    rows = [page(1, "http://bad.net/fr/1"), page(2, "http://friend.org/", link), page(3, "http://other.org/", '<a href="http://good.com/">'), page(4, "http://good.com/", '<a href="http://liked.org">'), page(5, "http://liked.org/", "")]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert got[2].verdict == "block" and got[3].verdict == got[5].verdict == "allow"
    assert got[5].trust > 0 and got[2].distrust > 0 and got[1].distrust <= UNITS


def test_no_pages(spark):
    got = filter_urls(spark.createDataFrame([], PAGES), [Rule(True, "com", "/")])
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"] and got.count() == 0
