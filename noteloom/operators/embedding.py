"""Embedding and completion jobs around user functions; vectors' upkeep and cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.runtime import checked, stage

# --- fixed values: model catalogue (provider, model, dims, reduced dims, price per million tokens) ---
MODELS = [
    ("openai", "text-embedding-3-small", 1536, 512, 0.02),
    ("openai", "text-embedding-3-large", 3072, 512, 0.13),
    ("gemini", "gemini-embedding-001", 3072, 768, 0.0),
    ("ollama", "nomic-embed-text", 768, None, 0.0),
    ("ollama", "mxbai-embed-large", 1024, None, 0.0),
]
BATCH, QUEUE = 100, 100
ATTEMPTS = 3
OUT_CELLS = 1 << 20  # numbers of vectors that a task holds before it passes them on: 4 MB
# -----------------------------------------------------------------------------------------------------

Embedder = Callable[[list[str]], "tuple[Sequence[Sequence[float]], int]"]


class RateLimited(Exception):
    """Raised by a user function when it should be retried after a growing pause."""


class ServerFailure(Exception):
    """Raised by a user function when it should be retried after one second."""


def embedding_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MODELS, "provider string, model string, dims int, reduced_dims int, price double"
    )


def model_dims(model: str, compact: bool = False) -> int:
    """Vector width of a catalogue model; ``compact`` picks its reduced width where it has one."""
    for _, name, dims, reduced, _ in MODELS:
        if name == model:
            return reduced if compact and reduced else dims
    raise ValueError(f"unknown embedding model {model!r}")


def with_retry(call: Callable, argument, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep):
    """Up to ``attempts`` calls: rate limits wait 2**n seconds, server failures 1, others raise."""
    for n in range(attempts):
        try:
            return call(argument)
        except RateLimited:
            if n == attempts - 1:
                raise
            pause(2.0**n)
        except ServerFailure:
            if n == attempts - 1:
                raise
            pause(1.0)
    raise ValueError("attempts must be positive")


def pending_embeddings(chunks: DataFrame, vectors: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """Chunks without a vector of exactly this provider, model and width.

    A model change therefore re-embeds everything, and older vectors stay readable. Ids are
    compared first; the texts of the pending chunks follow without a shuffle while those are few.
    """
    have = vectors.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims))
    ids = checked(chunks.select("chunk_id").join(have.select("chunk_id"), "chunk_id", "left_anti"))
    return chunks.join(ids, "chunk_id", "left_semi")


def embed_queue(pending: DataFrame, edited: DataFrame, size: int = QUEUE) -> DataFrame:
    """Next work: every pending chunk of an edited file, then others up to ``size`` in total."""
    first = pending.join(edited.select("path").distinct(), "path", "left_semi").withColumn("priority", F.lit(True))
    first = stage(first)
    others = pending.join(edited.select("path").distinct(), "path", "left_anti").withColumn("priority", F.lit(False))
    room = max(0, size - first.count())
    return first.unionByName(others.orderBy("path", "chunk_index").limit(room))


def embed_chunks(
    pending: DataFrame, embed: Embedder, provider: str, model: str, key: str = "chunk_id", text: str = "content", batch: int = BATCH,
    attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Run a user function over the texts in slices of ``batch``.

    A slice that fails for good yields rows with status 'failed' and no vector; the job goes on.
    ``tokens`` carries the slice's reported total on its first row, so a sum is the total used.
    """
    schema = T.StructType(
        [
            pending.schema[key],
            T.StructField("provider", T.StringType()),
            T.StructField("model", T.StringType()),
            T.StructField("dims", T.IntegerType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("tokens", T.LongType()),
            T.StructField("status", T.StringType()),
        ]
    )

    def table(keys: list, vectors: list, tokens: list[int], states: list[str]) -> pd.DataFrame:
        dims = pd.array([None if v is None else len(v) for v in vectors], "Int32")
        return pd.DataFrame(
            {key: keys, "provider": provider, "model": model, "dims": dims, "embedding": vectors, "tokens": tokens, "status": states}
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, texts = frame[key].tolist(), frame[text].tolist()
            vectors, tokens, states, first, cells = [], [], [], 0, 0
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                try:
                    found, used = with_retry(embed, part, attempts, pause)
                    if len(found) != len(part):
                        raise ValueError("one vector per text expected")
                    found = [None if v is None else np.array([float(x) for x in v], np.float32) for v in found]
                    status = "ok"
                except Exception:  # noqa: BLE001 - any failure of the user's function skips its slice
                    found, used, status = [None] * len(part), 0, "failed"
                vectors += found
                tokens += [used] + [0] * (len(part) - 1)
                states += [status] * len(part)
                cells += sum(len(v) for v in found if v is not None)
                if cells >= OUT_CELLS:  # wide vectors leave in parts, narrow ones a frame at a time
                    yield table(keys[first : first + len(vectors)], vectors, tokens, states)
                    first, vectors, tokens, states, cells = first + len(vectors), [], [], [], 0
            if vectors:
                yield table(keys[first:], vectors, tokens, states)

    return pending.select(key, text).mapInPandas(run, schema)


def embed_queries(queries: DataFrame, embed_query: Embedder, key: str = "query_id") -> DataFrame:
    """(query_id, embedding) for search queries; models may treat queries and documents differently,
    hence a function of its own. Queries whose call failed are left out and use the text list."""
    done = embed_chunks(queries, embed_query, "", "", key, "text")
    return done.where(F.col("status") == "ok").select(key, "embedding")


def vectors_for(vectors: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored vectors of the given ids; ids without a vector have no row."""
    return vectors.join(checked(ids.select(key).distinct()), key, "left_semi")


def tokens_used(embedded: DataFrame) -> DataFrame:
    return embedded.groupBy("provider", "model").agg(F.sum("tokens").alias("tokens_used"))


def batch_complete(prompts: DataFrame, complete: Callable[[str], str], key: str = "request_id", attempts: int = ATTEMPTS) -> DataFrame:
    """(key, content, status) of a user completion function over prompts (key, prompt)."""
    schema = T.StructType([prompts.schema[key], T.StructField("content", T.StringType()), T.StructField("status", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for prompt in frame["prompt"]:
                try:
                    out.append((with_retry(complete, prompt, attempts), "ok"))
                except Exception:  # noqa: BLE001
                    out.append((None, "failed"))
            yield pd.DataFrame({key: frame[key].to_numpy(), "content": [c for c, _ in out], "status": [s for _, s in out]})

    return prompts.select(key, "prompt").mapInPandas(run, schema)


def upsert_vectors(existing: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("chunk_id", "provider", "model", "dims")) -> DataFrame:
    """Existing vectors with updates applied; the highest ``seq`` of a key wins."""
    latest = stage(updates.groupBy(*keys).agg(F.max_by("embedding", "seq").alias("embedding")))
    return existing.join(checked(latest.select(*keys)), list(keys), "left_anti").select(*keys, "embedding").unionByName(latest.select(*keys, "embedding"))


def index_stats(notes: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of index statistics; each table is one aggregate."""
    n = F.count("*")
    vector_row = vectors.agg(
        F.count("*").alias("vectors"),
        F.coalesce(F.sum(F.ceil(F.col("dims") * 4 * 1.33)), F.lit(0)).cast("long").alias("vector_bytes"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens_used"),
    )
    return vector_row.select(
        notes.agg(n).scalar().alias("total_files"),
        chunks.agg(n).scalar().alias("total_chunks"),
        files.agg(n).scalar().alias("indexed_files"),
        "vectors",
        "vector_bytes",
        "tokens_used",
    )


def embedding_cost(models: DataFrame, chunks: DataFrame, tokens_used: int, max_tokens: int = 512) -> DataFrame:
    """Per model: the rule-of-thumb estimate (half the token limit per chunk), the estimate from the
    chunks' own tokens, and the cost of the tokens already used."""
    n = chunks.agg(F.count("*")).scalar()
    exact = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    per_million = F.col("price") / 1_000_000
    return models.select(
        "provider",
        "model",
        (n * (max_tokens // 2) * per_million).alias("estimate"),
        (exact * per_million).alias("exact_estimate"),
        (F.lit(tokens_used) * per_million).alias("used_cost"),
    )
