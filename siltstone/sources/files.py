"""Files as tables: listing, what is supported, and text extraction."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.text import extension
from siltstone.schema import EXCLUDED_PATHS, LOCK_PREFIX, PREVIEW_CHARS, SUPPORTED_EXT, WORDS_PER_CHUNK

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def is_supported(path: Column) -> Column:
    """A supported extension, no excluded part, and no lock file of an office program."""
    low = F.lower(path)
    excluded = F.lit(False)
    for part in EXCLUDED_PATHS:
        excluded = excluded | F.contains(low, F.lit(part))
    return extension(path).isin(SUPPORTED_EXT) & ~excluded & ~F.substring_index(path, "/", -1).startswith(LOCK_PREFIX)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below ``root`` with their content: ``path, mtime, size, content``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(is_supported(F.col("path"))).select("path", (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"), "content")


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").load(root)``: one partition for each top folder. A folder or file that can't
    be read gives one row with an ``error`` and fails nothing else. For mounted folders; ``walk`` lists any store that
    Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, mtime double, size long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        tops = sorted(e.path for e in os.scandir(self.root) if e.is_dir())
        return [_Folder(self.root, False), *(_Folder(t, True) for t in tops)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        failed: list[OSError] = []
        for folder, below, names in os.walk(partition.path, onerror=failed.append):
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                    yield (path, stat.st_mtime, stat.st_size, None)
                except OSError as err:
                    failed.append(err)
            for err in failed:
                yield (err.filename or folder, None, None, str(err)[:500])
            failed.clear()
            if not partition.deep:
                below.clear()
        for err in failed:
            yield (err.filename or partition.path, None, None, str(err)[:500])


def decode_text(content: bytes) -> str:
    """UTF-16 with a byte order mark, UTF-8, then Windows-1252, then Latin-1."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def _paragraph(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _blocks(body: ET.Element) -> Iterator[str]:
    for node in body:
        if node.tag == f"{_W}p":
            yield _paragraph(node)
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [" ".join(filter(None, map(_paragraph, c.iter(f"{_W}p")))) for c in row.findall(f"{_W}tc")]
                yield " | ".join(cells)


def docx_text(content: bytes) -> str:
    """Headers and footers, then paragraphs and tables in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        edges = [_paragraph(ET.fromstring(z.read(n))) for n in sorted(names) if n.startswith(("word/header", "word/footer"))]
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        lines = [x for x in _blocks(body if body is not None else ET.Element("x")) if x.strip()]
    head = [f"[HEADER/FOOTER]\n{' '.join(e for e in edges if e.strip())}"] if any(e.strip() for e in edges) else []
    return "\n".join(head + lines)


def _word_pages(text: str) -> list[tuple[int, str]]:
    words = text.split()
    return [(i // WORDS_PER_CHUNK + 1, " ".join(words[i : i + WORDS_PER_CHUNK])) for i in range(0, len(words), WORDS_PER_CHUNK)]


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """Text of each page that has any, in visual order, with the rows of its tables behind. Needs PyMuPDF."""
    import fitz

    out = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, start=1):
            rows = [" | ".join(str(c or "").strip() for c in row) for table in page.find_tables().tables for row in table.extract()]
            body = "\n\n[TABLAS]\n".join(x for x in (page.get_text(sort=True).strip(), "\n".join(rows)) if x)
            if body:
                out.append((number, body))
    return out


def doc_text(content: bytes, programs: tuple[tuple[str, ...], ...] = (("antiword", "{file}"), ("catdoc", "{file}"))) -> str:
    """Text of an old Word file by the first of the programs that is installed and succeeds."""
    tried = []
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(content)
        f.flush()
        for command in programs:
            if shutil.which(command[0]):
                done = subprocess.run([a.format(file=f.name) for a in command], capture_output=True, timeout=120, check=False)
                if not done.returncode and done.stdout.strip():
                    return decode_text(done.stdout)
            tried.append(command[0])
    raise RuntimeError(f"none of {', '.join(tried)} could read the file")


#: Extension -> function from content to pages. PDF and DOC need a library or program that may be missing; then files
#: of these kinds become rows with an error.
EXTRACTORS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {
    ".txt": lambda content: _word_pages(decode_text(content)),
    ".docx": lambda content: _word_pages(docx_text(content)),
    ".doc": lambda content: _word_pages(doc_text(content)),
    ".pdf": pdf_pages,
}


def head_text(content: bytes, kind: str) -> str:
    """Text from the beginning of a file that is enough for a preview: of a text file its first bytes, of a PDF its first
    page with text, of other kinds their whole text."""
    if kind == ".txt":
        head = content[: 16 * PREVIEW_CHARS]
        if len(head) < len(content) and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            head = head[: max(head.rfind(b" "), head.rfind(b"\n"))] or head
        return decode_text(head)
    pages = EXTRACTORS[kind](content)
    return pages[0][1] if pages else ""


PREVIEWED = "path string, mtime double, size long, status string, preview string"


def extract_previews(files: DataFrame) -> DataFrame:
    """One row for each of ``files (path, mtime, size, content)`` with its first characters; a file that fails has a status
    that says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    preview = head_text(bytes(r.content), os.path.splitext(r.path)[1].lower()).strip()[:PREVIEW_CHARS]
                    status = "ok" if preview else "sin_texto"
                except Exception as err:  # noqa: BLE001  a bad file must not stop the others
                    status, preview = f"error:{type(err).__name__}: {err}"[:50], ""
                out.append((r.path, r.mtime, r.size, status, preview))
            yield pd.DataFrame(out, columns=["path", "mtime", "size", "status", "preview"])

    return files.select("path", "mtime", "size", "content").mapInPandas(run, PREVIEWED)


def marked_text(extracted: DataFrame) -> DataFrame:
    """``path, text, pages`` of what ``extract`` returns: the pages as one text, each under its number; empty and 0 where
    extraction failed."""
    block = F.transform("pages", lambda p: F.concat(F.lit("[Pag "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    return extracted.select("path", F.array_join(block, "\n\n").alias("text"), F.size("pages").alias("pages"))


def candidates(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Supported files of a listing, at most ``limit`` of them, the first by path."""
    found = listing.where(is_supported(F.col("path")))
    return found if limit is None else found.orderBy("path").limit(limit)


def write_checkpoint(spark: SparkSession, tally: DataFrame, path: str) -> dict:
    """Counts of a run by status (``operators.store.run_tally``) as one JSON line at ``path``, in place of the last run's."""
    row = tally.agg(F.map_from_entries(F.collect_list(F.struct("status", "files"))).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("overwrite").json(path)
    done = spark.read.json(path).first()
    return {"files": {k: v for k, v in done["files"].asDict().items() if v} if "files" in done and done["files"] else {}, "chunks": done["chunks"]}

EXTRACTED = "path string, mtime double, size long, status string, error string, preview string, pages array<struct<page: int, text: string>>"


def extract(files: DataFrame, extractors: dict[str, Callable] | None = None) -> DataFrame:
    """One row for each of ``files (path, mtime, size, content)``: status ``ok``, ``sin_texto`` or ``error``, pages
    and preview. A file that fails is a row with its error; a kind without an extractor is one, too."""
    known = EXTRACTORS if extractors is None else extractors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                status, error, pages = "ok", None, []
                try:
                    pages = known[os.path.splitext(r.path)[1].lower()](bytes(r.content))
                    status = "ok" if pages else "sin_texto"
                except Exception as err:  # noqa: BLE001  a bad file must not stop the others
                    status, error = "error", f"{type(err).__name__}: {err}"[:500]
                preview = pages[0][1].strip()[:PREVIEW_CHARS] if pages else ""
                out.append((r.path, r.mtime, r.size, status, error, preview, [{"page": p, "text": t} for p, t in pages]))
            yield pd.DataFrame(out, columns=["path", "mtime", "size", "status", "error", "preview", "pages"])

    return files.select("path", "mtime", "size", "content").mapInPandas(run, EXTRACTED)
