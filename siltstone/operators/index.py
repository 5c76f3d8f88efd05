"""The chunk index as stored tables, built once from the files and read by every query.

``chunks`` has each chunk with its vector, spread by folder and path so that a filter on either reads few row groups;
``postings`` and ``lengths`` are the inverted index of whole texts and of names with texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import with_char_vector
from siltstone.operators import ranking, store
from siltstone.schema import CHUNKS
from siltstone.tables import Versions


class ChunkIndex:
    """Tables below ``root``; each is a sequence of versions of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, table: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{table}")

    def table(self, table: str) -> DataFrame:
        found = self.versions(table).read()
        if found is None:
            raise LookupError(f"{self.root} has no table {table}: build the index first")
        return found

    def ensure(self) -> None:
        """Makes an empty chunk table where there is none; changes nothing otherwise."""
        own = self.versions("chunks")
        if not own.done():
            own.write(self.spark.createDataFrame([], CHUNKS), 0)

    def build(self, files: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None = None, only: str | None = None) -> ChunkIndex:
        """A new version of every table (or the ``only`` one named) from ``files (doc_id, path, text, mtime, size)``. ``vectors``
        adds the column ``vector`` to rows with ``text``; the character encoder does without it."""
        if only in (None, "chunks"):
            add = vectors or (lambda rows: with_char_vector(rows, F.col("text")))
            chunks = store.chunk_table(files).repartitionByRange("carpeta_top", "path").sortWithinPartitions("carpeta_top", "path", "page")
            self._next("chunks", add(chunks))
        for name in ("", "_named"):
            if only in (None, f"postings{name}"):
                self._next(f"postings{name}", self._postings(files, name))
            if only in (None, f"lengths{name}"):
                self._next(f"lengths{name}", ranking.lengths(self.table(f"postings{name}")))
        return self

    def _next(self, table: str, rows: DataFrame) -> None:
        own = self.versions(table)
        done = own.done()
        own.write(rows, done[-1] + 1 if done else 0)

    @staticmethod
    def _postings(files: DataFrame, name: str) -> DataFrame:
        text = F.concat_ws(" ", F.substring_index("path", "/", -1), "text") if name else F.col("text")
        return ranking.postings(files.select(F.col("doc_id").alias("id"), text.alias("text")))

    def replace(self, files: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """What the index has of these files goes, chunks and postings, and what they are now comes in; a file that lost
        its text leaves nothing behind. Tables that were never built stay so."""
        add = vectors or (lambda rows: with_char_vector(rows, F.col("text")))
        if self.versions("chunks").done():
            self._next("chunks", store.replace_file(self.table("chunks"), add(store.chunk_table(files)), files))
        self._repost(files, files)

    def remove(self, files: DataFrame) -> None:
        """What the index has of ``files (doc_id, path)`` goes, chunks and postings."""
        if self.versions("chunks").done():
            self._next("chunks", self.table("chunks").join(files.select("path").distinct(), "path", "left_anti"))
        self._repost(files, None)

    def _repost(self, gone: DataFrame, files: DataFrame | None) -> None:
        ids = gone.select(F.col("doc_id").alias("id")).distinct()
        for name in ("", "_named"):
            for table in (f"postings{name}", f"lengths{name}"):
                if not self.versions(table).done():
                    continue
                old = self.table(table)
                kept = old.join(ids, "id", "left_anti").select(*old.columns)
                if files is not None:
                    new = self._postings(files, name)
                    kept = kept.unionByName(new if table.startswith("postings") else ranking.lengths(new))
                self._next(table, kept)


class FolderCache:
    """The distinct folders of a chunk table, asked for anew after ``seconds``."""

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self._rows: DataFrame | None = None
        self._at = 0.0

    def folders(self) -> DataFrame:
        if self._rows is None or self.clock() - self._at >= self.seconds:
            if self._rows is not None:
                self._rows.unpersist()
            self._rows = self.read().select("carpeta_top").distinct().cache()
            self._at = self.clock()
        return self._rows
