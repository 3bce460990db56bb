"""Registered queries: text index, text, vector and hybrid search, proximity."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.checks import sqltext as S
from noteloom.checks import tables as X
from noteloom.checks.notes_checks import _SECTION_CTES, LINK_CTES
from noteloom.functions import text as t
from noteloom.operators import hybrid, links, proximity, text_index, text_search, vector_search
from noteloom.operators.chunking import chunk_documents
from noteloom.operators.vector_index import VectorIndex
from noteloom.plans.retriever import Retriever
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


def tf_ctes(docs: str, key: str, text: str) -> str:
    return f"""n_docs as (select count(*)::double as n from {docs}),
dt as (select {key}, unnest({S.tokens(text)}) as term from {docs}),
dc as (select {key}, term, count(*)::bigint as n from dt group by all),
tf as (select {key}, term, n, n / (max(n) over (partition by {key}))::double as tf from dc),
st as (select term, count(*)::bigint as df, ln(((select n from n_docs) + 1) / (count(*) + 1)) + 1 as idf from dc group by term),
w as (select {key}, tf.term, tf * idf as w from tf join st using (term)),
norms as (select {key}, sqrt(sum(w * w)) as norm from w group by {key})"""


def hit_ctes(docs: str, key: str, text: str, queries: str, min_score: float) -> str:
    return f"""{tf_ctes(docs, key, text)},
qt as (select query_id, unnest({S.tokens('text')}) as term from {queries}),
qc as (select query_id, term, count(*) as n from qt group by all),
qw as (select query_id, term, n / (max(n) over (partition by query_id))::double * coalesce(idf, ln((select n from n_docs) + 1)) as q from qc left join st using (term)),
qn as (select query_id, sqrt(sum(q * q)) as qnorm from qw group by query_id),
dots as (select query_id, {key}, sum(q * w) as dot from qw join w using (term) group by all),
hits as (select query_id, {key}, round(dot / (qnorm * norm), 9) as score from dots join qn using (query_id) join norms using ({key}) where round(dot / (qnorm * norm), 9) >= {min_score})"""


_BENCH_Q = "queries as (select item_id as query_id, text from benchmark)"


def _docs(spark, sf):
    return spread(X.table(spark, sf, "documents")).select("doc_id", "text")


@query(f"with {tf_ctes('documents', 'doc_id', 'text')} select doc_id, term, n, round(tf, 9) as tf from tf")
def term_frequency(spark, sf):
    return text_index.term_frequencies(_docs(spark, sf), "doc_id", "text").select(
        "doc_id", "term", F.col("n").cast("long").alias("n"), F.round("tf", 9).alias("tf")
    )


@query(f"with {tf_ctes('documents', 'doc_id', 'text')} select term, df, round(idf, 9) as idf from st")
def idf(spark, sf):
    docs = _docs(spark, sf)
    n = docs.agg(F.count("*")).scalar()
    df = text_index.document_frequencies(text_index.term_frequencies(docs, "doc_id", "text"))
    return df.withColumn("idf", F.round(text_index.idf(F.col("df"), n), 9))


@query(f"with {tf_ctes('documents', 'doc_id', 'text')} select doc_id, term, round(w, 9) as weight, round(norm, 9) as norm from w join norms using (doc_id)")
def tfidf(spark, sf):
    index = text_index.build_index(_docs(spark, sf), "doc_id", "text")
    return text_index.weighted_postings(index).select(
        "doc_id", "term", F.round("weight", 9).alias("weight"), F.round("norm", 9).alias("norm")
    )


@query(
    f"""with {_BENCH_Q}, {hit_ctes('documents', 'doc_id', 'text', 'queries', 0.3)}
    select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits) where rank <= 5"""
)
def tfidf_search(spark, sf):
    docs = _docs(spark, sf)
    index = text_index.build_index(docs, "doc_id", "text")
    return _long_rank(text_search.text_search(X.queries(spark, sf), index, docs, "text", 5, 0.3))


def _long_rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with queries as (select item_id as query_id, lower({S.trim('right(text, 2)')}) as q from benchmark where len({S.tokens('right(text, 2)')}) = 0),
    found as (select query_id, doc_id, round(least(1.0::double, ((length(lower(text)) - length(replace(lower(text), q, ''))) / length(q)) * {S.utf16('q')}
        / greatest({S.utf16('lower(text)')}, 100)::double), 9) as score
      from queries join documents on contains(lower(text), q))
    select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from found) where rank <= 5"""
)
def substring_search(spark, sf):
    """The last two characters of every benchmark text: mostly a letter and a full stop, no token."""
    q = X.queries(spark, sf).select("query_id", F.expr("right(text, 2)").alias("text"))
    hits = text_search.substring_hits(q, _docs(spark, sf), "doc_id", "text", k=5)
    return _long_rank(text_search.top_k(hits, 5, ["doc_id"]))


_COSINE = """round(case when q.norm * v.norm = 0 then 0 else list_dot_product(q.e, v.e) / (q.norm * v.norm) end, 9)"""
_VECS = "vecs as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings)"


@query(
    f"""with {_VECS}, scored as (select q.vec_id as query_id, v.vec_id, {_COSINE} as score from vecs q cross join vecs v where q.norm > 0)
    select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10"""
)
def vector_topk(spark, sf):
    e = spread(X.table(spark, sf, "embeddings"))
    return _long_rank(vector_search.vector_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, "vec_id", 10))


_VECTOR_HITS = f"""with {_VECS}, scored as (select q.vec_id as query_id, v.vec_id, {_COSINE} as score from vecs q cross join vecs v where q.norm > 0 and q.vec_id % 20 = 0)
    select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10"""


@query(_VECTOR_HITS)
def vector_index_search(spark, sf):
    """Every twentieth vector as a query against an index of all of them."""
    e = X.table(spark, sf, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _long_rank(VectorIndex.build(e, "vec_id").search(queries, 10)[0])


_RRF_CTES = f"""{_BENCH_Q}, {hit_ctes('documents', 'doc_id', 'text', 'queries', 0.1)}, {_VECS},
tl as (select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits) where rank <= 50),
vs as (select q.vec_id as query_id, v.vec_id as doc_id, {_COSINE} as score from vecs q join queries on q.vec_id = queries.query_id cross join vecs v where q.norm > 0 and v.vec_id in (select doc_id from documents)),
vl as (select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs) where rank <= 50),
fused as (select coalesce(tl.query_id, vl.query_id) as query_id, coalesce(tl.doc_id, vl.doc_id) as doc_id, tl.rank as tr, vl.rank as vr,
  round(coalesce(1 / (60 + tl.rank)::double, 0) + coalesce(1 / (60 + vl.rank)::double, 0), 9) as score
  from tl full join vl on tl.query_id = vl.query_id and tl.doc_id = vl.doc_id)"""


@query(
    f"""with {_RRF_CTES} select query_id, doc_id, score, case when vr is null then 'text' when tr is null then 'semantic' else 'hybrid' end as match_type, rank
    from (select *, row_number() over (partition by query_id order by score desc, tr nulls last, vr) as rank from fused) where rank <= 10"""
)
def rrf_hybrid(spark, sf):
    """Text list over documents fused with the neighbours of the vector that shares the query's id."""
    docs = _docs(spark, sf)
    q = X.queries(spark, sf)
    index = text_index.build_index(docs, "doc_id", "text")
    pool = hybrid.pool_size(10)
    text = text_search.text_search(q, index, docs, "text", pool, 0.1)
    vectors = X.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q_vectors = vectors.join(q.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    known = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")  # vectors of missing documents take no place
    near = vector_search.vector_topk(q_vectors, known, "doc_id", pool)
    return _long_rank(hybrid.fuse(text, near, "doc_id", 10, known=docs))


# --- proximity -------------------------------------------------------------------------------

_PAIRS = """
select a.path as anchor, a.mtime as anchor_mtime, b.path as target, b.mtime as target_mtime from {customer} c
  join {notes} a on a.basename = c.c_name
  join {customer} d on d.c_custkey = cast(floor(c.c_custkey / 2.0) as bigint) join {notes} b on b.basename = d.c_name
union all select a.path, a.mtime, b.path, b.mtime from {customer} c join {notes} a on a.basename = c.c_name
  join {customer} d on d.c_custkey = cast(floor(c.c_custkey / 4.0) as bigint) join {notes} b on b.basename = d.c_name
union all select a.path, a.mtime, b.path, b.mtime from {customer} c join {notes} a on a.basename = c.c_name
  join {nation} on n_nationkey = c_nationkey join {notes} b on b.basename = n_name
union all select a.path, a.mtime, b.path, b.mtime from {customer} c join {notes} a on a.basename = c.c_name
  join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey join {notes} b on b.basename = r_name
union all select path, mtime, path, mtime from {notes}
"""
_PAIRS_SQL = f"{S.WITH_NOTES}, pairs as ({_PAIRS.format(customer='customer', notes='notes', nation='nation', region='region')})"


def _pairs(spark, sf, notes=None):
    t3 = {n: X.table(spark, sf, n) for n in ("customer", "nation", "region")}
    return spark.sql(_PAIRS, notes=notes or X.stored_notes(spark, sf), **t3)


_LINK_SCORE_SQL = """case when p.anchor = p.target then 1.0 when exists (select 1 from graph g where g.src = p.anchor and g.dst = p.target) then 0.8
 when exists (select 1 from graph g join graph h on g.dst = h.src where g.src = p.anchor and h.dst = p.target) then 0.4 else 0.0 end::double"""
_FOLDER_SQL = """(select case when greatest(len(a), len(b)) = 0 then 1.0::double else
  len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) / greatest(len(a), len(b))::double end
  from (select case when contains(p.anchor, '/') then string_split(regexp_replace(p.anchor, '/[^/]*$', ''), '/') else []::varchar[] end as a,
   case when contains(p.target, '/') then string_split(regexp_replace(p.target, '/[^/]*$', ''), '/') else []::varchar[] end as b))"""
_BG = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_NAME_SQL = f"""(select case when len(a) = 0 and len(b) = 0 then 1.0::double when len(a) = 0 or len(b) = 0 then 0.0::double else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double end
  from (select {_BG.format('x')} as a, {_BG.format('y')} as b from (select lower(regexp_extract(p.anchor, '([^/]*)\\.md$', 1)) as x, lower(regexp_extract(p.target, '([^/]*)\\.md$', 1)) as y)))"""


@query(f"{_PAIRS_SQL}, {LINK_CTES}, p as (select distinct anchor, target from pairs) select anchor, target, {_LINK_SCORE_SQL} as link from p")
def link_score(spark, sf):
    notes = X.stored_notes(spark, sf)
    graph = links.link_graph(links.note_edges(notes))
    return proximity.link_scores(_pairs(spark, sf, notes), stage(graph))


@query(f"{_PAIRS_SQL} select anchor, target, round({_FOLDER_SQL}, 9) as folder from pairs p")
def folder_score(spark, sf):
    return _pairs(spark, sf).select("anchor", "target", F.round(proximity.folder_score("anchor", "target"), 9).alias("folder"))


@query(f"{_PAIRS_SQL} select anchor, target, round({_NAME_SQL}, 9) as name from pairs p")
def name_score(spark, sf):
    score = proximity.name_score(t.base_name("anchor"), t.base_name("target"))
    return _pairs(spark, sf).select("anchor", "target", F.round(score, 9).alias("name"))


@query(f"{_PAIRS_SQL} select anchor, target, round(exp(-abs(epoch_us(anchor_mtime) - epoch_us(target_mtime)) / 86400000000.0::double / 7), 9) as time from pairs p")
def time_score(spark, sf):
    score = proximity.time_score("anchor_mtime", "target_mtime")
    return _pairs(spark, sf).select("anchor", "target", F.round(score, 9).alias("time"))


CHUNK_CTES = f"""{_SECTION_CTES},
chunks as (select path || '::' || (row_number() over (partition by path order by start_line) - 1) as chunk_id, path,
  row_number() over (partition by path order by start_line) - 1 as chunk_index, regexp_extract(path, '([^/]*)\\.md$', 1) as name,
  content, heading, start_line::bigint as start_line, end_line::bigint as end_line from raw where content <> '')"""

NOTE_QUERIES = "queries as (select n_nationkey::bigint as query_id, n_name || ' segment customer' as text, r_name || '/' || n_name || '.md' as anchor from nation join region on n_regionkey = r_regionkey)"

FOUND_CTES = f"""{NOTE_QUERIES}, {CHUNK_CTES}, {hit_ctes('chunks', 'chunk_id', 'content', 'queries', 0.2)},
found as (select * from (select hits.*, chunks.* exclude (chunk_id), row_number() over (partition by query_id order by score desc, path, chunk_index) as rank
  from hits join chunks using (chunk_id)) where rank <= 5)"""


def note_queries(spark, sf):
    nation, region = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("query_id"),
        F.concat("n_name", F.lit(" segment customer")).alias("text"),
        F.concat_ws("/", "r_name", F.concat("n_name", F.lit(".md"))).alias("anchor"),
    )


def note_retriever(spark, sf, with_graph: bool = False) -> Retriever:
    notes = X.stored_notes(spark, sf)
    parts = {}
    if with_graph:
        parts = {"notes": notes, "graph": stage(links.link_graph(links.note_edges(notes)))}
    return Retriever.build(chunk_documents(notes, "section", 512), **parts)


@query(f"{S.WITH_NOTES}, {FOUND_CTES} select query_id, chunk_id, path, heading, score, 'text' as match_type, rank from found")
def search(spark, sf):
    found = note_retriever(spark, sf).search(note_queries(spark, sf).select("query_id", "text"), 5, 0.2)
    return _long_rank(found.select("query_id", "chunk_id", "path", "heading", "score", "match_type", "rank"))


@query(
    f"""{S.WITH_NOTES}, {LINK_CTES}, {FOUND_CTES},
    p as (select f.*, q.anchor, f.path as target, a.mtime as am, b.mtime as bm from found f join queries q using (query_id) left join notes a on a.path = q.anchor left join notes b on b.path = f.path),
    scored as (select query_id, chunk_id, rank as rank_before, score as text_score, round(0.4::double * {_LINK_SCORE_SQL} + 0.3::double * {_FOLDER_SQL} + 0.15::double * {_NAME_SQL}
      + 0.15::double * exp(-abs(epoch_us(am) - epoch_us(bm)) / 86400000000.0::double / 7), 9) as proximity from p),
    boosted as (select *, round(text_score * (1 + 0.5::double * proximity), 9) as score from scored)
    select query_id, chunk_id, proximity, score, row_number() over (partition by query_id order by score desc, rank_before) as rank from boosted"""
)
def proximity_rerank(spark, sf):
    q = note_queries(spark, sf)
    found = note_retriever(spark, sf, True).search(q.select("query_id", "text"), 5, 0.2, anchors=q.select("query_id", "anchor"), boost=0.5)
    return _long_rank(found.select("query_id", "chunk_id", "proximity", "score", "rank"))
