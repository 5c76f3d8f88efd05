import io
import os
import uuid
import zipfile

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import store
from siltstone.schema import POINT_NAMESPACE
from siltstone.sources.files import FolderListing, decode_text, extract, walk
from siltstone.streaming.ingest import stream_ingest
from siltstone.tables import VersionedTable

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx() -> bytes:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t>first</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {_NS}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def _tree(root):
    (root / "a").mkdir()
    (root / "a" / "one.txt").write_text("uno dos tres")
    (root / "a" / "~$one.txt").write_text("lock")
    (root / "a" / "two.docx").write_bytes(_docx())
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "empty.TXT").write_text("  ")
    (root / "scan.pdf").write_bytes(b"%PDF")
    (root / "image.png").write_bytes(b"x")


def test_walk_and_extract(spark, tmp_path):
    _tree(tmp_path)
    rows = {os.path.basename(r.path): r for r in extract(walk(spark, str(tmp_path))).collect()}
    assert sorted(rows) == ["bad.docx", "empty.TXT", "one.txt", "scan.pdf", "two.docx"]
    assert (rows["one.txt"].status, rows["one.txt"].pages[0].text) == ("ok", "uno dos tres")
    assert rows["two.docx"].pages[0].text == "[HEADER/FOOTER] head first a | b last"
    assert rows["empty.TXT"].status == "sin_texto"
    assert rows["bad.docx"].status == rows["scan.pdf"].status == "error"


def test_listing_has_a_partition_for_each_folder(spark, tmp_path):
    _tree(tmp_path)
    spark.dataSource.register(FolderListing)
    found = spark.read.format("folder_listing").load(str(tmp_path))
    assert found.where("error is null").count() == 7
    assert found.rdd.getNumPartitions() == 2


def test_decoding():
    assert decode_text("ñandú".encode()) == decode_text("ñandú".encode("cp1252")) == decode_text("ñandú".encode("utf-16")) == "ñandú"


def test_keys_equal_name_based_uuids(spark):
    got = spark.range(50).select("id", text.point_id(F.concat(F.lit("/x/"), "id"), F.col("id"), F.lit(0)).alias("p")).collect()
    assert all(r.p == str(uuid.uuid5(uuid.UUID(POINT_NAMESPACE), f"/x/{r.id}|{r.id}|0")) for r in got)


def test_chunks_of_blank_and_long_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "w " * 501)], "id int, t string").select("id", text.word_chunks(F.col("t")).alias("c")).collect()
    assert [len(r.c) for r in rows] == [0, 0, 2] and rows[2].c[1] == "w"


def test_upsert_takes_the_last_of_equal_keys(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, v int")
    new = spark.createDataFrame([("a", 3, 0), ("a", 4, 1), ("c", 5, 0)], "point_id string, v int, seq int")
    assert sorted(map(tuple, store.upsert(stored, new).collect())) == [("a", 4), ("b", 2), ("c", 5)]


def _rows(df):
    return {r.id: r.v for r in df.collect()}


def test_stream_ingest_is_incremental(spark, tmp_path):
    """Three runs on one root: what is there, with a file more, with nothing new."""
    source, root = tmp_path / "t.parquet", f"file://{tmp_path}/table"
    spark.range(5).withColumn("v", F.lit(1)).coalesce(1).write.parquet(str(source))
    run = lambda: _rows(stream_ingest(spark, str(source), key="id", root=root))
    assert run() == dict.fromkeys(range(5), 1)
    spark.range(2, 8).withColumn("v", F.lit(2)).coalesce(1).write.mode("append").parquet(str(source))
    want = {0: 1, 1: 1, **dict.fromkeys(range(2, 8), 2)}
    assert run() == want
    assert run() == want and len(want) == 8


def test_stream_ingest_of_one_file(spark, tmp_path):
    spark.range(4).withColumn("v", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/raw")
    (part,) = (tmp_path / "raw").glob("part-*.parquet")
    part.rename(tmp_path / "one.parquet")
    assert stream_ingest(spark, f"{tmp_path}/one.parquet", key="id").count() == 4


def test_versions_replay_and_half_written_ones(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/versions", "id")
    assert table.read() is None
    for n, v in enumerate((1, 2)):
        table.upsert(spark.range(n * 5, 10 + n * 5).withColumn("v", F.lit(v)), n)
    want = {**dict.fromkeys(range(5), 1), **dict.fromkeys(range(5, 15), 2)}
    assert _rows(table.read()) == want
    table.upsert(spark.range(3).withColumn("v", F.lit(9)), 1)  # the same batch again
    assert _rows(VersionedTable(spark, f"file://{tmp_path}/versions", "id").read()) == want
    (tmp_path / "versions" / "v2").mkdir()  # of a driver that was lost
    assert table.done() == [0, 1] and _rows(table.read()) == want
    table.upsert(spark.createDataFrame([(None, 7), (0, 5), (0, 6)], "id long, v int"), 2)
    table.upsert(spark.createDataFrame([(None, 8)], "id long, v int"), 3)
    assert _rows(table.read()) == {**want, 0: 6, None: 8}
    table.keep(newest=1)
    assert table.done() == [3] and _rows(table.read())[0] == 6
    keys = VersionedTable(spark, f"file://{tmp_path}/keys", "id")
    keys.upsert(spark.range(3), 0)
    assert keys.read().count() == 3


def test_delete_path_keeps_rows_without_one(spark):
    rows = spark.createDataFrame([("/a", 1), (None, 2), ("/b", 3)], "path string, v int")
    assert sorted(r.v for r in store.delete_path(rows, "/a").collect()) == [2, 3]


def test_index_is_built_read_and_changed(spark, tmp_path):
    from siltstone.operators.index import ChunkIndex, FolderCache

    files = spark.createDataFrame([(1, "/a/x.txt", "uno dos " * 400, 1.0, 9), (2, "/b/y.txt", "tres", 1.0, 4), (3, "/b/z.txt", None, 1.0, 0)], "doc_id long, path string, text string, mtime double, size long")
    index = ChunkIndex(spark, f"file://{tmp_path}/index")
    index.ensure()
    index.ensure()
    assert index.versions("chunks").done() == [0] and index.table("chunks").count() == 0
    index.build(files)
    assert {(r.path, r.page) for r in index.table("chunks").collect()} == {("/a/x.txt", 1), ("/a/x.txt", 2), ("/b/y.txt", 1)}
    assert {(r.term, r.id): r.tf for r in index.table("postings").collect()} == {("uno", 1): 400, ("dos", 1): 400, ("tres", 2): 1}
    assert {r.id: r.dl for r in index.table("lengths_named").collect()} == {1: 802, 2: 3, 3: 2}
    index.replace(files.where("doc_id = 1").withColumn("text", F.lit("corto")))
    assert {(r.path, r.page) for r in index.table("chunks").collect()} == {("/a/x.txt", 1), ("/b/y.txt", 1)}
    assert store.collection_info(index.table("chunks")).first().asDict() == {"points": 2, "files": 2, "vector_size": 36}
    assert {(r.term, r.id): r.tf for r in index.table("postings").collect()} == {("corto", 1): 1, ("tres", 2): 1}
    assert {r.id: r.dl for r in index.table("lengths_named").collect()} == {1: 3, 2: 3, 3: 2}
    now, asked = [0.0], []
    cache = FolderCache(lambda: asked.append(1) or index.table("chunks"), 60, lambda: now[0])
    assert {r[0] for r in cache.folders().collect()} == {"a", "b"} and cache.folders() is cache.folders() and len(asked) == 1
    now[0] = 61.0
    cache.folders()
    assert len(asked) == 2
    index.replace(files.where("doc_id = 2").withColumn("text", F.lit("")))
    assert [r.path for r in index.table("chunks").collect()] == ["/a/x.txt"] and {r.id for r in index.table("lengths").collect()} == {1}
    index.remove(files.where("doc_id = 1"))
    assert not index.table("chunks").count() and not index.table("postings").count() and {r.id for r in index.table("lengths_named").collect()} == {2, 3}


def test_index_changes_only_tables_it_has(spark, tmp_path):
    from siltstone.operators.index import ChunkIndex

    files = spark.createDataFrame([(1, "/a/x.txt", "uno", 1.0, 3)], "doc_id long, path string, text string, mtime double, size long")
    index = ChunkIndex(spark, f"file://{tmp_path}/index")
    index.build(files, only="postings")
    index.replace(files.withColumn("text", F.lit("dos dos")))
    assert [tuple(r) for r in index.table("postings").select("term", "id", "tf").collect()] == [("dos", 1, 2)]
    assert not index.versions("chunks").done() and not index.versions("lengths").done()


def test_backfill_writes_a_snapshot_and_a_version(spark, tmp_path):
    from siltstone.tables import Versions

    table = Versions(spark, f"file://{tmp_path}/chunks")
    table.write(spark.createDataFrame([("p", "/a/x", None), ("q", "/b/y", "b"), ("r", "/c/z", "old")], "point_id string, path string, carpeta_top string"), 0)
    run = lambda: store.run_backfill(table, "carpeta_top", text.folder_top(F.col("path")), f"file://{tmp_path}/before")
    assert run() == 2 and run() == 0 and table.done() == [0, 1]
    assert {(r.point_id, r.carpeta_top) for r in table.read().collect()} == {("p", "a"), ("q", "b"), ("r", "c")}
    assert {(r.point_id, r.old) for r in spark.read.json(f"{tmp_path}/before").collect()} == {("p", ""), ("r", "old")}


def test_missing_columns_are_added(spark):
    from siltstone.schema import FILES

    old = spark.createDataFrame([("/a", 3, "x")], "path string, size int, extra string")
    out = store.with_missing_columns(old, FILES, {"fully_extracted": False, "preview": ""})
    row = out.first()
    assert out.columns == [*FILES.names, "extra"] and row.fully_extracted is False and row.preview == "" and row.mtime is None and row["size"] == 3


def test_extraction_previews_marks_and_tallies(spark, tmp_path):
    from siltstone.sources import files as sources

    rows = [("/d/a.txt", 1.0, 5, ("palabra " * 1200).encode()), ("/d/b.txt", 1.0, 0, b""), ("/d/c.pdf", 1.0, 3, b"no pdf"), ("/d/d.doc", 1.0, 3, b"no doc"), ("/d/e.txt", 1.0, 9, ("ñandú " * 9000).encode())]
    found = spark.createDataFrame(rows, "path string, mtime double, size long, content binary")
    done = sources.extract(found).cache()
    assert {r.path[-5:]: r.status for r in done.collect()} == {"a.txt": "ok", "b.txt": "sin_texto", "c.pdf": "error", "d.doc": "error", "e.txt": "ok"}
    pages = lambda content: [(1, "uno"), (1, "otro"), (3, content.decode())]  # noqa: E731  a PDF reader of a test
    told = {r.path: r for r in sources.marked_text(sources.extract(found, {".pdf": pages})).collect()}
    assert told["/d/c.pdf"].text == "[Pag 1]\nuno\n\n[Pag 1]\notro\n\n[Pag 3]\nno pdf" and told["/d/a.txt"].pages == 0 and told["/d/a.txt"].text == ""
    chunks = store.extracted_chunks(sources.extract(found, {".pdf": pages})).collect()
    assert sorted((r.page, r.chunk_idx, r.text) for r in chunks) == [(1, 0, "uno"), (1, 1, "otro"), (3, 0, "no pdf")]
    assert {r.path[-5:]: (r.n_chunks, r.fully_extracted) for r in store.file_rows(done).collect()} == {"a.txt": (3, True), "b.txt": (0, False), "c.pdf": (0, False), "d.doc": (0, False), "e.txt": (18, True)}
    lite = {r.path[-5:]: r for r in sources.extract_previews(found).collect()}
    assert lite["a.txt"].preview == ("palabra " * 1200)[:750] and lite["e.txt"].preview == ("ñandú " * 9000)[:750] and lite["b.txt"].status == "sin_texto"
    assert lite["c.pdf"].status.startswith("error:") and len(lite["c.pdf"].status) <= 50
    assert [r.path for r in sources.candidates(found.select("path"), 2).collect()] == ["/d/a.txt", "/d/b.txt"]
    tally = store.run_tally(done.select("status", F.size("pages").alias("n_chunks")))
    for _ in range(2):
        assert sources.write_checkpoint(spark, tally, f"file://{tmp_path}/run") == {"files": {"ok": 2, "sin_texto": 1, "error": 2}, "chunks": 21}


def test_no_hit_log_appends(spark, tmp_path):
    for n in range(2):
        store.log_no_hits(spark.createDataFrame([("x" * 600, f"f{n}")], "query string, carpeta string"), f"{tmp_path}/log")
    rows = spark.read.json(f"{tmp_path}/log").collect()
    assert sorted(r.carpeta for r in rows) == ["f0", "f1"] and all(len(r.query) == 500 and r.ts for r in rows)


def test_normal_forms(spark):
    samples = ["Ａｂｃ①", "ﬁn ﬂor", "e\u0301te\u0301", "ÀÉÎõü  Ñ\u00a0x", "ªº", None, "straße"]
    want = ["abc①", "fin flor", "ete", "aeiou n x", "ao", "", "straße"]
    got = spark.createDataFrame(list(enumerate(samples)), "i int, t string").select("i", text.normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.i)] == want
