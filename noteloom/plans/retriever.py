"""Search façade: text or hybrid retrieval for a batch of queries, with optional proximity re-rank."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators.hybrid import fuse, pool_size
from noteloom.operators.proximity import proximity_rerank
from noteloom.operators.text_index import TextIndex, build_index
from noteloom.operators.text_search import text_search
from noteloom.operators.vector_index import VectorIndex
from noteloom.operators.vector_search import vector_topk
from noteloom.runtime import checked, spread, stage, staged_once
from noteloom.sources.stored_index import StoredIndex

# Of a chunk, what a search reads and returns; front matter is neither parsed nor written for it.
COLUMNS = ("chunk_id", "path", "name", "chunk_index", "content", "heading", "start_line", "end_line")
DEFAULTS = {"k": 5, "min_score": 0.3, "boost": 0.5}


@dataclass
class Retriever:
    """Searchable corpus: chunks with their text index, optionally vectors, notes and link graph."""

    chunks: DataFrame
    index: TextIndex
    vectors: DataFrame | None = None
    notes: DataFrame | None = None
    graph: DataFrame | None = None
    near: VectorIndex | None = None  # set by with_vector_index

    def with_vector_index(self) -> Retriever:
        """Index the vectors once, for sessions that search them often; results do not change."""
        return replace(self, near=VectorIndex.build(self.vectors, "chunk_id"))

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame | None = None, **parts) -> Retriever:
        """Stage and index the chunks. Vectors whose chunk is gone are dropped here, once, so that they
        cannot take a place in any ranked list."""
        chunks = spread(staged_once(chunks, *COLUMNS))
        if vectors is not None:
            vectors = stage(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
        return cls(chunks, build_index(chunks, "chunk_id", "content", ["path", "chunk_index"]), vectors, **parts)

    @classmethod
    def stored(cls, store: StoredIndex, vectors: DataFrame | None = None, notes: DataFrame | None = None) -> Retriever:
        """Search over a stored index: nothing is chunked or tokenised. ``vectors`` (chunk_id, path, hash, embedding) of
        replaced texts are dropped."""
        if vectors is not None:
            vectors = stage(store.live_vectors(vectors))
        graph = stage(store.graph()) if notes is not None else None
        return cls(store.chunks(), store.text_index(), vectors, notes, graph)

    def ranked(
        self, queries: DataFrame, k: int, min_score: float, query_vectors: DataFrame | None = None, pool: int | None = None
    ) -> DataFrame:
        """(query_id, chunk_id, score, match_type, rank) without chunk text.

        ``pool`` is the number of candidates of each list before fusion (default :func:`pool_size`).
        Queries without a vector, and every query when there are no vectors at all, fall back to
        the text list.
        """
        if self.vectors is None or query_vectors is None:
            hits = text_search(queries, self.index, self.chunks, "content", k, min_score)
            return hits.withColumn("match_type", F.lit("text"))
        pool = pool or pool_size(k)
        text = text_search(queries, self.index, self.chunks, "content", pool, min_score)
        near = self.near.search(query_vectors, pool)[0] if self.near else vector_topk(query_vectors, self.vectors, "chunk_id", pool)
        return fuse(text, near, "chunk_id", k)

    def search(
        self,
        queries: DataFrame,
        k: int = DEFAULTS["k"],
        min_score: float = DEFAULTS["min_score"],
        query_vectors: DataFrame | None = None,
        anchors: DataFrame | None = None,
        boost: float = DEFAULTS["boost"],
        pool: int | None = None,
    ) -> DataFrame:
        """Result rows with their chunk. The at most k winners per query meet the texts at the end, by
        a broadcast of the winners unless the batch is very large."""
        if k < 1:
            raise ValueError("k must be at least 1")
        ranked = checked(self.ranked(queries, k, min_score, query_vectors, pool))
        found = self.chunks.select(*COLUMNS).join(ranked, "chunk_id")
        if anchors is None:
            return found
        if self.notes is None or self.graph is None:
            raise ValueError("a proximity re-rank needs notes and the link graph")
        return proximity_rerank(found, anchors, self.notes, self.graph, boost)

    def tool_search(self, queries: DataFrame, k: int | None = None, **options) -> DataFrame:
        return self.search(queries, k or DEFAULTS["k"], **options)
