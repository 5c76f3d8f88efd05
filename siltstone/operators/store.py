"""The chunk table: building it, keyed changes, lookups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import extension, folder_top, point_id, word_slices, words
from siltstone.schema import PREVIEW_CHARS, SNIPPET_STORED
from siltstone.tables import Versions


def chunk_table(files: DataFrame, text_of: str = "text") -> DataFrame:
    """Chunks of ``files (path, text, mtime, size)``: pages of 500 words with their keys."""
    split = files.select("path", "mtime", "size", words(F.col(text_of)).alias("words"))
    pages = split.select("path", "mtime", "size", F.posexplode(word_slices(F.col("words"))).alias("at", "text"))
    return page_table(pages.withColumn("page", (F.col("at") + 1).cast("int")).withColumn("chunk_idx", F.lit(0)))


def page_table(pages: DataFrame) -> DataFrame:
    """Chunk rows of ``pages (path, page, chunk_idx, text, mtime, size)``."""
    idx = F.col("chunk_idx")
    return pages.select(point_id(F.col("path"), F.col("page"), idx).alias("point_id"), "path", folder_top(F.col("path")).alias("carpeta_top"), F.substring_index("path", "/", -1).alias("filename"), extension(F.col("path")).alias("ext"), "page", idx.alias("chunk_idx"), "text", F.substring("text", 1, SNIPPET_STORED).alias("snippet"), "mtime", "size")


def extracted_chunks(extracted: DataFrame) -> DataFrame:
    """Chunk rows of what ``sources.files.extract`` returns: files with status ``ok``, several chunks of a page numbered
    from 0 in their order. Other files give none."""
    rows = extracted.where("status = 'ok'").select("path", "mtime", "size", F.posexplode("pages").alias("ord", "p")).select("path", "mtime", "size", "ord", F.col("p.page").cast("int").alias("page"), F.col("p.text").alias("text"))
    counter = (F.row_number().over(Window.partitionBy("path", "page").orderBy("ord")) - 1).cast("int")
    return page_table(rows.withColumn("chunk_idx", counter))


def file_rows(extracted: DataFrame) -> DataFrame:
    """File rows of what ``extract`` returns: counts of chunks, status, and whether there is a full text."""
    full = F.size("pages") > 0
    return extracted.select("path", F.substring_index("path", "/", -1).alias("filename"), extension(F.col("path")).alias("ext"), "mtime", "size", F.size("pages").alias("n_chunks"), F.unix_millis(F.current_timestamp()).cast("double").alias("indexed_at"), "status", F.lit("").alias("preview"), full.alias("fully_extracted"))


def corpus_files(documents: DataFrame) -> DataFrame:
    """The test table ``documents`` as files."""
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", path.alias("path"), "text", (F.lit(1.7e9) + F.col("doc_id")).alias("mtime"), F.length("text").cast("long").alias("size"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id", seq: str = "seq") -> DataFrame:
    """``stored`` with the rows of ``new``; of several new rows of a key the one of highest ``seq`` counts."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    fresh = new.withColumn("__last", last).where("__last = 1").select(*stored.columns)
    return stored.join(fresh.select(key), key, "left_anti").select(*stored.columns).unionByName(fresh)


def replace_file(stored: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All chunks of the files in ``new`` are replaced, so that a shorter file leaves none behind; with ``files (path)``
    those of all these files, also of one that has no chunk any more."""
    gone = (new if files is None else files).select("path").distinct()
    return stored.join(gone, "path", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def delete_path(stored: DataFrame, path: str) -> DataFrame:
    """All rows but those of ``path``; rows without a path stay."""
    return stored.where(~F.col("path").eqNullSafe(F.lit(path)))


def unseen(listing: DataFrame, known: DataFrame, tolerance: float = 0.001, inclusive: bool = True, same_size: bool = False) -> DataFrame:
    """Listed files that are not known by path and time; ``inclusive`` says whether the tolerance itself counts."""
    k = known.select(F.col("path").alias("k_path"), F.col("mtime").alias("k_mtime"), *([F.col("size").alias("k_size")] if same_size else [])).distinct()
    gap = F.abs(F.col("mtime") - F.col("k_mtime"))
    same = (F.col("path") == F.col("k_path")) & ((gap <= tolerance) if inclusive else (gap < tolerance))
    if same_size:
        same = same & (F.col("size") == F.col("k_size"))
    return listing.join(k, same, "left_anti")


def backfill(chunks: DataFrame, column: str, derived: Column) -> DataFrame:
    """Rows whose ``column`` differs from what it should be: ``point_id, old, new``."""
    return chunks.select("point_id", F.coalesce(F.col(column), F.lit("")).alias("old"), derived.alias("new")).where("old <> new")


def backfill_counts(chunks: DataFrame, column: str, derived: Column) -> DataFrame:
    """One row, what a dry run says: rows in all, rows to change, and those of them that have no value yet."""
    old, new = F.coalesce(F.col(column), F.lit("")), derived
    return chunks.agg(F.count("*").alias("rows"), F.count_if(old != new).alias("to_fix"), F.count_if((old != new) & (old == "")).alias("empty"))


def set_column(chunks: DataFrame, column: str, derived: Column) -> DataFrame:
    """``chunks`` with ``column`` as it should be and nothing else changed."""
    return chunks.withColumn(column, derived)


def run_backfill(table: Versions, column: str, derived: Column, snapshot: str) -> int:
    """Old and new values of the rows to change go to ``snapshot`` as JSON lines, then a new version of the table is
    written; returns how many rows changed. With nothing to change nothing is written."""
    rows = table.read()
    if rows is None:
        return 0
    changed = backfill(rows, column, derived)
    n = changed.count()
    if n:
        changed.write.mode("overwrite").json(snapshot)
        table.write(set_column(rows, column, derived), table.done()[-1] + 1)
    return n


def with_missing_columns(rows: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of an older table in the columns of ``schema``: what they lack is added, null or by ``defaults``; columns that
    the schema doesn't have come last."""
    given = defaults or {}
    own = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*(c.alias(f.name) for c, f in zip(own, schema.fields, strict=True)), *(c for c in rows.columns if c not in schema.names))


def collection_info(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: points, files, and the length of their vectors (the largest; 0 without any)."""
    return chunks.agg(F.count("*").alias("points"), F.count_distinct("path").alias("files"), F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("long").alias("vector_size"))


def read_pages(chunks: DataFrame, path: str, first: int, last: int, span: int = 20) -> DataFrame:
    """``page, text`` of a file's pages, at most ``span`` of them, each page's chunks in order."""
    last = min(last, first + span - 1)
    own = chunks.where((F.col("path") == path) & F.col("page").between(first, last))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "snippet")))
    return own.groupBy("page").agg(F.array_join(F.transform(ordered, lambda x: x["snippet"]), "\n").alias("text"))


def read_marked(chunks: DataFrame, path: str, first: int, last: int, span: int = 20) -> DataFrame:
    """One row ``text``: the pages as ``read_pages`` gives them, each under a line with its number."""
    pages = read_pages(chunks, path, first, last, span)
    block = F.concat(F.lit("[Pagina "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    rows = pages.agg(F.sort_array(F.collect_list(F.struct("page", block.alias("b")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["b"]), "\n\n").alias("text"))


def extension_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def index_stats(files: DataFrame) -> DataFrame:
    """One row of counts by status and of chunks, in one pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    return files.agg(n("ok").alias("files_ok"), n("sin_texto").alias("files_sin_texto"), F.count_if(F.col("status").startswith("error")).alias("files_err"), F.sum("n_chunks").cast("long").alias("chunks"))


def lite_rows(new: DataFrame, known: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Preview rows (page 0) for ``new (path, filename, mtime, size, preview)``: none for files that ``known``
    (with ``fully_extracted``) has in full and unchanged; a file without a preview is found by its name."""
    full = known.where("fully_extracted").select(F.col("path").alias("k_path"), F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size"))
    same = (F.col("path") == F.col("k_path")) & (F.col("size") == F.col("k_size")) & (F.abs(F.col("mtime") - F.col("k_mtime")) < tolerance)
    own = F.substring(F.coalesce("preview", F.lit("")), 1, PREVIEW_CHARS)
    return new.join(full, same, "left_anti").select("path", "filename", F.lit(0).alias("page"), F.when(own == "", F.col("filename")).otherwise(own).alias("text"))


def promote(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Chunks of the files that have only a preview so far, of all or of those in ``paths (path)``."""
    pending = files.where("not fully_extracted")
    return chunk_table(pending if paths is None else pending.join(paths.select("path").distinct(), "path", "left_semi"))


def promotion_state(paths: DataFrame, files: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """``path, state`` of ``paths (path, mtime, size)``: ``ya_estaba`` where the file is there in full and unchanged, else
    ``pendiente``."""
    full = files.where("fully_extracted").select(F.col("path").alias("k_path"), F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size")).distinct()
    same = (F.col("path") == F.col("k_path")) & (F.col("size") == F.col("k_size")) & (F.abs(F.col("mtime") - F.col("k_mtime")) < tolerance)
    new = paths.join(full, same, "left_anti").select("path", F.lit("pendiente").alias("state"))
    return paths.join(full, same, "left_semi").select("path", F.lit("ya_estaba").alias("state")).unionAll(new)


def run_tally(results: DataFrame) -> DataFrame:
    """Files and chunks of an ingest run by status."""
    return results.groupBy("status").agg(F.count("*").alias("files"), F.sum("n_chunks").cast("long").alias("chunks"))


def log_no_hits(queries: DataFrame, path: str) -> None:
    """Appends queries without hits as JSON lines; texts are cut to 500 characters."""
    queries.withColumns({"query": F.substring("query", 1, 500), "ts": F.current_timestamp()}).write.mode("append").json(path)
