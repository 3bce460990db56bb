"""A text index that is kept between sessions: chunks, postings, term counts, links and file states.

Every table is append-only Parquet, one folder per batch of changes; batch 0 is the full build. A file's rows are valid
in the batch that last wrote them, so readers drop what later batches have replaced, by a join with the
(usually few) paths that were touched since the build. Document frequencies are signed changes per
batch and are summed when read; weights and norms depend on all of them and are computed from the postings when the
index is opened for search. Texts are tokenised once, when their note changes.

A batch's file states are written last and name the batch's tag. A batch that is repeated after a loss finds its
tag and does nothing, or finds no tag and overwrites its own folders. There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.changes import detect_changes
from noteloom.operators.chunking import chunk_documents
from noteloom.operators.links import link_graph, note_edges_of, written_links
from noteloom.operators.text_index import (
    TextIndex,
    assemble_index,
    frequency_changes,
    summed_frequencies,
    term_frequencies,
)
from noteloom.runtime import checked, exists, stage, stage_bucketed
from noteloom.sources.index_store import VERSION, is_valid
from noteloom.sources.notes import not_excluded

_CONTENT = ("chunks", "postings", "links")


@dataclass(frozen=True)
class IndexSettings:
    """What an index depends on besides the notes; another value makes a stored index useless."""

    chunk_strategy: str = "section"
    chunk_max_tokens: int = 512
    exclude_folders: str = ""

    @property
    def folders(self) -> str:
        return ",".join(f.strip() for f in self.exclude_folders.split(",") if f.strip())


class StoredIndex:
    """A stored index below ``root``. Use :meth:`create` or :meth:`open`."""

    def __init__(self, spark: SparkSession, root: str, settings: IndexSettings):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    # --- build, open, update -----------------------------------------------------------------

    @classmethod
    def create(cls, notes: DataFrame, root: str, settings: IndexSettings = IndexSettings()) -> StoredIndex:
        """Index all ``notes`` (path, name, content, mtime) as batch 0 of an empty folder."""
        spark = notes.sparkSession
        store = cls(spark, root, settings)
        if exists(spark, f"{store.root}/settings"):
            raise ValueError(f"{root} already holds an index")
        row = asdict(settings) | {"exclude_folders": settings.folders, "version": VERSION}
        none = notes.select("path", F.lit("").alias("hash"), "mtime").limit(0)
        store._write_batch(0, notes, detect_changes(store._included(notes), none), none, None)
        # the settings come last: without them there is no index
        spark.createDataFrame([row], "chunk_strategy string, chunk_max_tokens int, exclude_folders string, version int").coalesce(
            1
        ).write.parquet(f"{store.root}/settings")
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, settings: IndexSettings = IndexSettings()) -> StoredIndex | None:
        """The index below ``root``; None if there is none or if it was built with other settings or by another version."""
        store = cls(spark, root, settings)
        if not exists(spark, f"{store.root}/settings/_SUCCESS"):
            return None
        fits = is_valid(settings.chunk_strategy, settings.chunk_max_tokens, settings.exclude_folders)
        row = spark.read.parquet(f"{store.root}/settings").select(F.coalesce(fits, F.lit(False))).first()
        return store if row and row[0] else None

    def update(self, notes: DataFrame, paths: DataFrame | None = None, tag: str | None = None) -> int | None:
        """Bring the index up to date with ``notes`` and return the number of the batch written, None if nothing changed.

        With ``paths`` (path) only those are looked at; one that ``notes`` does not have is deleted. Unchanged files are
        neither read nor written. ``tag`` names the batch: a tag that was written before is not applied again.
        """
        if tag is not None and self.has(tag):
            return None
        known, current = self.files(), self._included(notes)
        if paths is not None:
            asked = checked(paths.select("path").distinct())
            known, current = known.join(asked, "path", "left_semi"), current.join(asked, "path", "left_semi")
        known = stage(known)
        found = stage(detect_changes(current, known.select("path", "hash", "mtime")))
        old = known.select("path", F.col("mtime").alias("_was"))
        found = stage(found.join(old, "path", "left").where((F.col("status") != "unchanged") | (F.col("mtime") != F.col("_was"))).drop("_was"))
        if found.isEmpty():
            return None
        batch = 1 + (self._files().agg(F.max("batch")).first()[0] or 0)
        self._write_batch(batch, notes, found, known, tag)
        return batch

    def has(self, tag: str) -> bool:
        return not self._files().where(F.col("tag") == f"t-{tag}").isEmpty()

    def _included(self, notes: DataFrame) -> DataFrame:
        return notes.where(not_excluded(F.col("path"), self.settings.folders))

    def _write_batch(self, batch: int, notes: DataFrame, found: DataFrame, known: DataFrame, tag: str | None) -> None:
        where = lambda name: f"{self.root}/{name}/batch={batch}"
        found = stage(found)
        stale = checked(found.where(F.col("status").isin("modified", "deleted")).select("path"))
        fresh = checked(found.where(F.col("status").isin("added", "modified")).select("path"))
        changed = notes.join(fresh, "path", "left_semi")
        put = lambda df, name: df.write.mode("overwrite").parquet(where(name))
        put(chunk_documents(changed, self.settings.chunk_strategy, self.settings.chunk_max_tokens), "chunks")
        chunks = self.spark.read.parquet(where("chunks"))
        counted = chunks.select("path", F.struct("chunk_id", "path").alias("of"), "content")
        postings = term_frequencies(counted, "of", "content").select("of.chunk_id", "of.path", "term", "n", "tf")
        put(postings, "postings")
        new = self.spark.read.parquet(where("postings"))
        gone = self.postings(batch).join(stale, "path", "left_semi") if batch else new.limit(0)
        put(frequency_changes(gone, new), "terms")
        put(written_links(changed), "links")
        sizes = chunks.groupBy("path").agg(F.count("*").alias("n_chunks"))
        if "since" not in known.columns:
            known = known.withColumn("since", F.lit(0)).withColumn("n_chunks", F.lit(0).cast("long"))
        before = known.select("path", F.col("since").alias("_since"), F.col("n_chunks").alias("_n"))
        kept = F.col("status") == "unchanged"  # its chunks stay where they are, only the time is new
        states = found.join(before, "path", "left").join(sizes, "path", "left").select(
            "path",
            "hash",
            "mtime",
            (F.col("status") == "deleted").alias("deleted"),
            F.when(kept, F.col("_since")).otherwise(F.lit(batch)).cast("int").alias("since"),
            F.when(kept, F.col("_n")).otherwise(F.coalesce("n_chunks", F.lit(0))).cast("long").alias("n_chunks"),
        )
        states.write.mode("overwrite").parquet(f"{where('files')}/tag={'none' if tag is None else 't-' + tag}")

    # --- reading -----------------------------------------------------------------------------

    def _files(self, before: int | None = None) -> DataFrame:
        """All file states; batch and tag are folder names, so asking for them alone reads no file."""
        files = self.spark.read.parquet(f"{self.root}/files")
        return files if before is None else files.where(F.col("batch") < before)

    def _touched(self, before: int | None) -> DataFrame | None:
        """(path, last, since) of the paths written after the build; None if there are none."""
        later = self._files(before).where("batch > 0")
        if later.isEmpty():
            return None
        return checked(later.groupBy("path").agg(F.max("batch").alias("_last"), F.max_by("since", "batch").alias("_since")))

    def _live(self, name: str, before: int | None) -> DataFrame:
        """Rows of a content table in the batch that is valid for their path."""
        parts = self.spark.read.parquet(f"{self.root}/{name}")
        parts = parts if before is None else parts.where(F.col("batch") < before)
        touched = self._touched(before)
        if touched is None:
            return parts.where("batch = 0").drop("batch")
        valid = parts.join(touched, "path", "left").where(F.col("batch") == F.coalesce("_since", F.lit(0)))
        return valid.drop("batch", "_last", "_since")

    def files(self) -> DataFrame:
        """(path, hash, mtime, since, n_chunks) of every indexed file."""
        files, touched = self._files(), self._touched(None)
        if touched is not None:
            files = files.join(touched.drop("_since"), "path", "left").where(F.col("batch") == F.coalesce("_last", F.lit(0)))
        return files.where(~F.col("deleted")).select("path", "hash", "mtime", "since", "n_chunks")

    def chunks(self) -> DataFrame:
        return self._live("chunks", None)

    def postings(self, before: int | None = None) -> DataFrame:
        """(chunk_id, path, term, n, tf) of the current chunks, or of those before a batch."""
        return self._live("postings", before)

    def links(self) -> DataFrame:
        """(path, pos, target): the links of every file as they are written."""
        return self._live("links", None)

    def frequencies(self) -> DataFrame:
        """(term, df) over the current chunks, from the signed changes of all batches."""
        committed = self._files().select("batch").distinct()
        return summed_frequencies(self.spark.read.parquet(f"{self.root}/terms").join(F.broadcast(committed), "batch", "left_semi"))

    def edges(self) -> DataFrame:
        """(src, dst, n): links resolved against the files there are now, so a new note also answers old links."""
        return note_edges_of(self.links(), self.files())

    def graph(self) -> DataFrame:
        return link_graph(self.edges())

    def text_index(self) -> TextIndex:
        """Ready for search; only postings, term changes and chunk keys are read, no text."""
        keys = self.chunks().select("chunk_id", "path", "chunk_index")
        n_docs = self.files().agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
        postings = stage_bucketed(self.postings().select("chunk_id", "term", "n", "tf"), "chunk_id")
        return assemble_index(postings, self.frequencies(), keys, n_docs, "chunk_id", ["path", "chunk_index"])

    def live_vectors(self, vectors: DataFrame) -> DataFrame:
        """The rows of ``vectors`` (path, hash, ...) whose text is still the indexed one."""
        return vectors.join(self.files().select("path", "hash"), ["path", "hash"], "left_semi")
