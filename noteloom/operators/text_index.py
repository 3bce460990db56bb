"""TF-IDF index: postings, document frequencies, norms.

The index keeps ``tf`` and ``df`` only; weights depend on the corpus size and are computed when
read, so an incremental update never has to rewrite untouched postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import tokenize
from noteloom.runtime import dealt, lookup_parts, stage, stage_bucketed

_COUNTS = "array<struct<term:string,n:int>>"


def term_counts(tokens: Column | str) -> Column:
    """Distinct tokens with their counts: sort, find run starts, subtract. Linear after the sort. A text that repeats no
    token needs none of this."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens

    def runs(ordered):
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return F.element_at(
            F.transform(
                F.array(starts),
                lambda s: F.transform(
                    s,
                    lambda at, j: F.struct(
                        F.get(ordered, at).alias("term"),
                        (F.coalesce(F.get(s, j + 1), size) - at).cast("int").alias("n"),
                    ),
                ),
            ),
            1,
        )

    counted = F.element_at(F.transform(F.array(F.sort_array(tokens)), runs), 1)
    once = F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
    repeats = F.size(F.array_distinct(tokens)) < F.size(tokens)
    return F.when(F.size(tokens) > 0, F.when(repeats, counted).otherwise(once)).otherwise(F.array().cast(_COUNTS))


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n, tf): counts scaled by the document's highest count. A narrow projection."""
    counted = docs.select(key, tokenize(text).alias("_tokens")).select(key, term_counts("_tokens").alias("_c"))
    peak = F.array_max(F.transform("_c", lambda c: c["n"]))
    return (
        counted.select(key, "_c", peak.alias("_peak"))
        .select(key, "_peak", F.explode_outer("_c").alias("c"))
        .where(F.col("c").isNotNull())  # outer: keeps the optimizer from tokenising twice for a size check
        .select(key, F.col("c.term").alias("term"), F.col("c.n").alias("n"), (F.col("c.n") / F.col("_peak")).alias("tf"))
    )


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df); postings hold a term once per document, so a plain count is the distinct count."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n_docs: int | Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


@dataclass
class TextIndex:
    """``postings(key, term, n, tf)`` and ``norms(key, norm, rank columns)``, both bucketed by key, and
    ``terms(term, df, idf)``. ``ties`` are the columns that order equal scores."""

    key: str
    ties: list[str]
    n_docs: int
    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    n_terms: int


def weighted_parts(postings: DataFrame, terms: DataFrame, n_terms: int | None = None) -> list[DataFrame]:
    """Postings with their idf and weight, in parts: those of frequent terms stay in their buckets, only those of rare terms
    are shuffled. Very frequent terms never meet in one task."""
    parts = lookup_parts(postings, terms, ["term"], weight="df", dim_rows=n_terms)
    return [p.withColumn("weight", F.col("tf") * F.col("idf")) for p in parts]


def weighted_postings(index: TextIndex) -> DataFrame:
    """Postings of an index with idf, weight and their document's norm; each part meets the norms where it lies."""
    first, *rest = [p.join(index.norms, index.key) for p in weighted_parts(index.postings, index.terms, index.n_terms)]
    for part in rest:
        first = first.unionByName(part)
    return first


def build_index(docs: DataFrame, key: str, text: str, ties: list[str] | None = None) -> TextIndex:
    """Index ``docs``: one pass over the texts, then only the compact postings are read again. The texts are dealt to the
    buckets, not the postings, which are several times as long.

    Rank columns are stored beside the norms, so that a search orders ties without the documents.
    """
    postings = stage_bucketed(term_frequencies(dealt(docs.select(key, text), key), key, text), key, is_dealt=True)
    return assemble_index(postings, document_frequencies(postings), docs, docs.count(), key, ties)


def assemble_index(
    postings: DataFrame, frequencies: DataFrame, docs: DataFrame, n_docs: int, key: str, ties: list[str] | None = None
) -> TextIndex:
    """The index over bucketed ``postings`` whose ``frequencies`` (term, df) are known; texts are not read.

    Weights and norms depend on the number of documents and on every df, so they are computed here and
    never stored.
    """
    ties = ties or [key]
    terms = stage(frequencies.withColumn("idf", idf(F.col("df"), n_docs)))
    n_terms = terms.count()
    # Squares are summed per part before the parts meet: a row per document, not one per posting.
    squares = [p.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("_sq")) for p in weighted_parts(postings, terms, n_terms)]
    if len(squares) == 1:
        norms = squares[0].select(key, F.sqrt("_sq").alias("norm"))
    else:
        norms = squares[0].unionByName(squares[1]).groupBy(key).agg(F.sqrt(F.sum("_sq")).alias("norm"))
    extra = [t for t in ties if t != key]
    if extra:
        norms = norms.join(docs.select(key, *extra), key)
    return TextIndex(key, ties, n_docs, postings, terms, stage_bucketed(norms, key), n_terms)


def frequency_changes(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(term, d): by how much the df of each touched term changes when postings leave and arrive."""
    both = removed.select("term", F.lit(-1).alias("d")).unionByName(added.select("term", F.lit(1).alias("d")))
    return both.groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0")


def summed_frequencies(changes: DataFrame) -> DataFrame:
    """(term, df) from all signed changes (term, d) since the index was empty."""
    return changes.groupBy("term").agg(F.sum("d").alias("df")).where(F.col("df") > 0)


def updated_document_frequencies(df_old: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """New (term, df) from the old one plus the postings that left and arrived.

    Both deltas are aggregated before they meet the old table, so only touched terms move.
    """
    return summed_frequencies(df_old.select("term", F.col("df").alias("d")).unionByName(frequency_changes(removed, added)))
