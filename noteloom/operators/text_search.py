"""Batch text search: TF-IDF cosine with threshold and top-k, plus the substring fallback."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.functions.text import js_trim, tokenize, utf16_length
from noteloom.operators.text_index import TextIndex, term_counts
from noteloom.runtime import BROADCAST_ROWS, bounded_rows, checked, rounded, stage

# A query list up to this size is shipped as literals; longer ones are looked up by runs of characters.
FALLBACK_QUERIES = 200
GRAM = 3
DENSE = 1 << 19  # products and scores (documents times queries) that a task holds at a time, one document's at least
_LEVELLED = 2e-9  # scores further apart differ after rounding to 9 digits
_PIECE = 1 << 14  # characters of a text that are cut into runs at a time


def top_k(scored: DataFrame, k: int, ties: list[str], by: str = "query_id", score: str = "score") -> DataFrame:
    """Best ``k`` rows per query. Each task keeps k rows before the shuffle (group limit)."""
    order = [F.desc(score)] + [F.asc(t) for t in ties]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def query_weights(queries: DataFrame, index: TextIndex, min_score: float) -> DataFrame:
    """(query_id, term, w, qnorm, common): query weights times the term's idf; unseen terms enlarge the norm.

    ``common`` marks the query's most frequent terms as long as their joint share of the query
    norm stays below ``min_score``: a document that matches nothing else cannot reach the threshold
    (Cauchy-Schwarz), so these terms never have to produce candidates.
    """
    counted = queries.select("query_id", term_counts(tokenize("text")).alias("c"))
    terms = counted.select(
        "query_id",
        F.array_max(F.transform("c", lambda c: c["n"])).alias("peak"),
        F.explode("c").alias("c"),
    ).select("query_id", F.col("c.term").alias("term"), (F.col("c.n") / F.col("peak")).alias("tf"))
    unseen = math.log(index.n_docs + 1.0)
    weighted = terms.join(index.terms.select("term", "idf"), "term", "left").withColumn(
        "q", F.col("tf") * F.coalesce("idf", F.lit(unseen))
    )
    # A query's terms are one text's distinct words; the windows stay as small as that.
    by_query = Window.partitionBy("query_id")
    square = F.col("q") * F.col("q")
    most_frequent_first = by_query.orderBy(F.asc_nulls_last("idf"), "term").rowsBetween(Window.unboundedPreceding, 0)
    return (
        weighted.withColumn("qnorm", F.sqrt(F.sum(square).over(by_query)))
        .withColumn("_share", F.sqrt(F.sum(square).over(most_frequent_first)) / F.col("qnorm"))
        .where(F.col("idf").isNotNull())
        .select(
            "query_id",
            "term",
            (F.col("q") * F.col("idf")).alias("w"),
            "qnorm",
            (F.col("_share") < F.lit(min_score - 1e-6)).alias("common"),
        )
    )


def _rows_of(names: np.ndarray, n: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns ordered by ``names`` (0 to n - 1), after the places where each name's rows start."""
    order = np.argsort(names, kind="stable")
    return (np.concatenate([[0], np.cumsum(np.bincount(names, minlength=n))]), *(c[order] for c in columns))


def _spelled_out(starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a list of names: the place in the list and the row, for every row of every name."""
    counts = starts[names + 1] - starts[names]
    at = np.repeat(np.arange(len(names)), counts)
    return at, np.arange(len(at)) + np.repeat(starts[names] - np.cumsum(counts) + counts, counts)


def _in_order(docs: pa.RecordBatch, ties: list[str]) -> np.ndarray:
    """Each document's place in the order of ``ties``, as Spark sorts them: nulls first, texts by their bytes."""
    order = pc.sort_indices(docs.select(ties), sort_keys=[(t, "ascending") for t in ties], null_placement="at_start").to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def _contenders(query: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best ``k`` of their query once scores are rounded to 9 digits and ties are ordered by ``place``.

    A row is left out only if k others of its query are surely before it: their scores are higher by more than rounding can
    level, or equal and their places earlier.
    """
    order = np.lexsort((place, -score, query))
    q, s = query[order], score[order]
    n = np.arange(len(q))
    new_query = np.r_[True, q[1:] != q[:-1]][: len(q)]
    new_score = new_query | np.r_[True, s[1:] != s[:-1]][: len(q)]
    first = np.maximum.accumulate(np.where(new_query, n, 0))
    kth = np.minimum(first + k - 1, len(q) - 1)
    behind = (n - first >= k) & (s < s[kth] - _LEVELLED)
    return order[~behind & (n - np.maximum.accumulate(np.where(new_score, n, 0)) < k)]


def _scorer(weights: pa.Table, terms: pa.Array, columns: list[str], min_score: float, k: int | None = None, ties: list[str] | None = None):
    """Function from batches of documents (columns, norm, matched terms) to their rows (query_id, columns, score); with ``k``
    only to those that can be among the best k of their query."""
    ids = weights.column("query_id").combine_chunks()
    asked = ids.unique()
    query = pc.index_in(ids, value_set=asked).to_numpy(zero_copy_only=False)
    term = pc.index_in(weights.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
    w, common = weights.column("w").to_numpy(), weights.column("common").to_numpy()
    norms = np.ones(len(asked))
    norms[query] = weights.column("qnorm").to_numpy()
    by_term, of_query, of_w = _rows_of(term[~common], len(terms), query[~common], w[~common])
    place, frequent = np.full(len(terms), -1), np.unique(term[common])
    place[frequent] = np.arange(len(frequent))
    by_query, more_at, more_w = _rows_of(query[common], len(asked), place[term[common]], w[common])
    most = np.bincount(query[common], w[common], minlength=len(asked))  # tf is 1 at most
    wide = max(len(asked), len(frequent), 1)
    least = min_score - 1e-8  # rounded and compared by Spark

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("_m")
        t = lists.flatten().field("t").to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        work = np.concatenate([[0], np.cumsum(by_term[t + 1] - by_term[t])])[ends]  # products up to each document
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(work, work[at] + DENSE, side="right")) - 1 - at
            n = max(1, min(n, DENSE // wide))
            yield batch.slice(at, n)
            at += n

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in cut(batch):
                lists, norm = docs.column("_m"), docs.column("norm").to_numpy()
                doc = np.repeat(np.arange(len(norm)), pc.list_value_length(lists).to_numpy())
                flat = lists.flatten()
                t, tf = flat.field("t").to_numpy(), flat.field("tf").to_numpy()
                entry, row = _spelled_out(by_term, t)
                dots = np.bincount(doc[entry] * len(asked) + of_query[row], tf[entry] * of_w[row], minlength=len(norm) * len(asked))
                pairs = np.flatnonzero(dots)  # weights are positive: these share a distinctive term
                d, q = pairs // len(asked), pairs % len(asked)
                dot, scale = dots[pairs], norms[q] * norm[d]
                near = dot + most[q] >= least * scale
                d, q, dot, scale = d[near], q[near], dot[near], scale[near]
                if len(frequent):
                    held = np.zeros((len(norm), len(frequent)))
                    known = place[t] >= 0
                    held[doc[known], place[t[known]]] = tf[known]
                    entry, row = _spelled_out(by_query, q)
                    dot = dot + np.bincount(entry, held[d[entry], more_at[row]] * more_w[row], minlength=len(dot))
                found = dot >= least * scale
                d, q, scores = d[found], q[found], (dot / scale)[found]
                if k is not None and len(q) > k:
                    best = _contenders(q, scores, _in_order(docs, ties)[d], k)
                    d, q, scores = d[best], q[best], scores[best]
                d, q = pa.array(d), pa.array(q)
                out = [asked.take(q), *[docs.column(c).take(d) for c in columns], pa.array(scores)]
                yield pa.RecordBatch.from_arrays(out, ["query_id", *columns, "score"])

    return score


def _score_block(index: TextIndex, weights: DataFrame, min_score: float, k: int | None = None) -> DataFrame:
    """Scores of one block of query terms, which is bounded and travels to every task.

    The postings are bucketed by document, so the terms asked for, their list per document, the norm and the products all stay
    in the scan's own tasks, without a shuffle. Only distinctive terms produce candidates; common ones are added for those.
    A document whose terms, each at its best for any query, stay below the threshold never leaves for Python (an exact bound).
    """
    key, spark = index.key, weights.sparkSession
    table = weights.select("query_id", "term", "w", "qnorm", "common").toArrow()
    terms = table.column("term").combine_chunks().unique()
    most = np.zeros(len(terms))  # of a query's score that the term can bring to a document of norm 1
    at = pc.index_in(table.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
    np.maximum.at(most, at, table.column("w").to_numpy() / table.column("qnorm").to_numpy())
    named = spark.createDataFrame(pa.table({"term": terms, "t": pa.array(range(len(terms)), pa.int32()), "most": most}))
    lists = (
        index.postings.select(key, "term", "tf")
        .join(F.broadcast(named), "term")
        .groupBy(key)
        .agg(F.collect_list(F.struct("t", "tf")).alias("_m"), F.sum(F.col("tf") * F.col("most")).alias("_most"))
    )
    columns = [key, *[t for t in index.ties if t != key]]
    reached = F.col("_most") >= F.lit(min_score - 1e-6) * F.col("norm")
    docs = lists.join(index.norms.hint("shuffle_hash"), key).where(reached).select(*columns, "norm", "_m")
    schema = T.StructType([T.StructField("query_id", weights.schema["query_id"].dataType), *[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType())])
    kinds = [docs.schema[t].dataType for t in index.ties]
    best = k if all(x == T.StringType() or isinstance(x, T.IntegralType) for x in kinds) else None  # Arrow orders these as Spark does
    scored = docs.mapInArrow(_scorer(table, terms, columns, min_score, best, index.ties), schema)
    return scored.withColumn("score", rounded(F.col("score"))).where(F.col("score") >= min_score)


def cosine_hits(
    queries: DataFrame, index: TextIndex, min_score: float, block_terms: int = BROADCAST_ROWS, k: int | None = None
) -> DataFrame:
    """All (query_id, key, rank columns, score) with a shared term and ``score >= min_score``; with ``k`` at least those
    among the best k of their query (by score, then the index's ties): a task leaves out what k of its own rows surely precede.

    Queries are handled in blocks of bounded size, each sent to the tasks of the postings, so the query
    batch may be arbitrarily large.
    """
    weights = stage(query_weights(queries, index, min_score))
    blocks = max(1, math.ceil(weights.count() / block_terms))
    parts = [
        weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        for b in range(blocks)
    ]
    out = _score_block(index, parts[0], min_score, k)
    for part in parts[1:]:
        out = out.unionByName(_score_block(index, part, min_score, k))
    return out


def _zero_fill(queries: DataFrame, hits: DataFrame, docs: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """Zero-score rows for ``min_score <= 0``.

    A query with fewer than k hits is filled in tie order. The first k documents hold enough
    non-hits whatever the query matched, so at most k rows are combined with each query.
    """
    columns = [key, *[t for t in ties if t != key]]
    first = docs.select(*columns).orderBy(*ties).limit(k).collect()
    values = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in columns]) for r in first])
    with_tokens = queries.where(F.size(tokenize("text")) > 0).select("query_id")
    filler = with_tokens.select("query_id", F.explode(values).alias("d")).select("query_id", "d.*")
    return filler.join(hits.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))


def substring_hits(
    queries: DataFrame, docs: DataFrame, key: str, text: str, ties: list[str] | None = None, k: int | None = None
) -> DataFrame:
    """Case-insensitive literal matches for queries that yield no token (punctuation, one CJK character...).

    score = min(1, occurrences * query length / max(document length, 100)). The threshold of the
    token search does not apply here. Queries with the same text have the same hits: each text is looked up and counted once
    and, with ``k``, only its best k rows (in the order of ``ties``) meet the queries.
    """
    plain = (
        queries.where((js_trim("text") != "") & (F.size(tokenize("text")) == 0))
        .select("query_id", F.lower(js_trim("text")).alias("q"))
        .where(F.col("q") != "")
    )
    ties = ties or [key]
    extra = [t for t in ties if t != key]
    lower = docs.select(key, *extra, F.lower(text).alias("_low"))
    low = lower.select("*", F.char_length("_low").alias("_chars"), F.greatest(utf16_length("_low"), F.lit(100)).alias("_size"))
    few = bounded_rows(plain, FALLBACK_QUERIES)
    if few is not None and not few:
        id_type = plain.schema["query_id"].dataType
        return lower.where(F.lit(False)).select(F.lit(None).cast(id_type).alias("query_id"), key, *extra, F.lit(0.0).alias("score"))
    if few is not None:
        known = F.array(*[F.lit(q) for q in sorted({r["q"] for r in few})])
        pairs = low.select("*", F.explode(F.filter(known, lambda q: F.contains(F.col("_low"), q))).alias("q"))
    else:
        pairs = _gram_matches(plain, low, key)
    gone = F.char_length(F.replace(F.col("_low"), F.col("q"), F.lit("")))
    times = ((F.col("_chars") - gone) / F.char_length("q")).cast("long")
    score = F.least(F.lit(1.0), times * utf16_length("q") / F.col("_size"))
    scored = pairs.select("q", key, *extra, rounded(score).alias("score"))
    if k is not None:
        scored = top_k(scored, k, ties, by="q").drop("rank")
    return scored.join(checked(plain), "q").select("query_id", key, *extra, "score")


def _runs(chars: Column, n: int) -> Column:
    """All runs of ``n`` neighbours of an array of characters, joined."""
    starts = F.sequence(F.lit(1), F.size(chars) - (n - 1))
    whole = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.size(chars) >= n, whole).otherwise(F.array().cast("array<string>"))


def _gram_postings(low: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """(key, gram): which documents hold which of the ``needed`` runs of characters.

    Texts are read in pieces that overlap by what a run needs, so the work per text is linear and a very long
    text never becomes one array.
    """
    lengths = [n for n in range(1, GRAM + 1) if needed.where(F.char_length("gram") == n).limit(1).count()]
    pieces = low.where(F.col("_low") != "").select(
        key, "_low", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("_low") - 1) / _PIECE).cast("int"))).alias("_at")
    )
    piece = F.substring("_low", F.col("_at") * _PIECE + 1, F.lit(_PIECE + GRAM - 1))
    chars = pieces.select(key, F.split(piece, "").alias("_chars"))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_runs(F.col("_chars"), n) for n in lengths]))
    found = chars.select(key, F.explode(grams).alias("gram")).join(needed, "gram", "left_semi")
    return found.distinct()


def _gram_matches(plain: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """Matching (document, query text) pairs for many fallback queries, by postings of character runs.

    A query of up to 3 characters is a run itself; of a longer one the run that the fewest documents hold produces the
    candidates, which are verified. A query with a run that no document holds has none. Equal queries are looked up
    once. Only ids and runs are shuffled; the texts meet the candidates at the end.
    """
    texts = plain.select("q").distinct()
    parts = F.when(F.char_length("q") <= GRAM, F.array("q")).otherwise(F.array_distinct(_runs(F.split("q", ""), GRAM)))
    runs = stage(texts.select("q", F.explode(parts).alias("gram")))
    postings = stage(_gram_postings(low, checked(runs.select("gram").distinct()), key))
    held = postings.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = (
        runs.join(held, "gram", "left")
        .groupBy("q")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .where("best.n > 0")
        .select("q", F.col("best.gram").alias("gram"))
    )
    candidates = checked(postings.join(checked(rarest), "gram").select(key, "q"))
    return low.join(candidates, key).where(F.contains(F.col("_low"), F.col("q")))


def _gram_pairs(plain: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """The matches of every query: equal texts share theirs."""
    return _gram_matches(plain, low, key).join(checked(plain), "q")


def text_search(
    queries: DataFrame,
    index: TextIndex,
    docs: DataFrame,
    text: str,
    k: int = 5,
    min_score: float = 0.3,
) -> DataFrame:
    """(query_id, key, score, rank) for every query with text; blank queries have no rows."""
    key, ties = index.key, index.ties
    hits = cosine_hits(queries, index, min_score, k=k if min_score > 0 else None)
    if min_score <= 0:
        hits = stage(hits)
        hits = hits.unionByName(_zero_fill(queries, hits, docs, key, ties, k))
    scored = hits.unionByName(substring_hits(queries, docs, key, text, ties, k).select(hits.columns))
    return top_k(scored, k, ties).select("query_id", key, "score", F.col("rank").cast("int").alias("rank"))
