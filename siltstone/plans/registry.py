"""Names of the queries on the reference tables, and their DuckDB counterparts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import analysis, models, text
from siltstone.functions.text import strings
from siltstone.operators import conversation, ranking, store
from siltstone.operators.index import ChunkIndex
from siltstone.operators.nearest import BLOCK_ROWS
from siltstone.plans import cases
from siltstone.plans.cases import spark_frame, sql_values
from siltstone.streaming.ingest import stream_ingest
from siltstone.tables import shared_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunk_table(store.corpus_files(_table(spark, sf_dir, "documents")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.corpus_files(_table(spark, sf_dir, "documents"))


def _stored(spark: SparkSession, sf_dir: str, table: str = "chunks") -> DataFrame:
    """A table of the index over ``documents``, built at its first use and read from then on. The index lies in the shared
    folder under a name that changes with the files of ``documents``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)]
    index = ChunkIndex(spark, f"{shared_dir(spark)}/index-{hashlib.sha1(repr(sorted(status)).encode()).hexdigest()[:20]}")
    needed = ["postings" + table.removeprefix("lengths"), table] if table.startswith("lengths") else [table]
    for name in needed:
        if not index.versions(name).done():
            plain = name in ("postings", "lengths")  # these need no path
            index.build(_table(spark, sf_dir, "documents").select("doc_id", "text") if plain else _files(spark, sf_dir), only=name)
    return index.table(table)


_FILES = """files AS (SELECT doc_id, '/'||source||'/'||lang||'/doc_'||doc_id||'.txt' AS path, source AS carpeta_top,
 'doc_'||doc_id||'.txt' AS filename, text, 1.7e9 + doc_id AS mtime, length(text) AS size FROM documents)"""
_CHUNKS = (
    _FILES
    + """, split AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM files),
chunks0 AS (SELECT path, carpeta_top, filename, mtime, size, unnest(range(1, CAST(ceil(len(w) / 500.0) AS BIGINT) + 1)) AS page, w FROM split),
chunks1 AS (SELECT path, carpeta_top, filename, mtime, size, CAST(page AS INT) AS page, 0 AS chunk_idx, array_to_string(w[(page-1)*500+1 : page*500], ' ') AS text,
 sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(path||'|'||page||'|0')) AS h FROM chunks0),
chunks AS (SELECT *, left(text, 800) AS snippet, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h,17,1)), 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id FROM chunks1)"""
)


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


_NORM = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) BETWEEN 2 AND 30)"
_Q = "q(qid, t) AS (" + sql_values(cases.QUERIES) + ")"


def _cases(spark: SparkSession) -> DataFrame:
    return spark_frame(spark, cases.QUERIES, "qid int, t string")


# --- chunks, keys, previews ------------------------------------------------------------------------------------


@_query(_with(_CHUNKS) + "SELECT path, page, text FROM chunks")
def chunk_by_words(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "page", "text")


@_query(_with(_FILES) + "SELECT doc_id, left(trim(text), 750) AS preview FROM files")
def preview_750(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


@_query("SELECT l_orderkey, l_linenumber, split_part(ltrim(replace(p, '\\', '/'), '/'), '/', 1) AS folder FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'solo.txt' WHEN l_linenumber % 2 = 0 THEN '/dir'||l_suppkey||'/x/'||l_orderkey||'.txt' ELSE '\\dir'||l_suppkey||'\\y.txt' END AS p FROM lineitem)")
def folder_top(spark, sf_dir):
    p = F.when(F.col("l_linenumber") == 1, "solo.txt").when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/dir"), "l_suppkey", F.lit("/x/"), "l_orderkey", F.lit(".txt"))).otherwise(F.concat(F.lit("\\dir"), "l_suppkey", F.lit("\\y.txt")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.folder_top(p).alias("folder"))


@_query(_with(_CHUNKS) + "SELECT path, page, point_id FROM chunks")
def point_id(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "page", "point_id")


@_query("SELECT page_id, path, split_part(path, '/', 2) AS root FROM (SELECT page_id, '/vol/' || replace(replace(url, '://', '/'), '\\', '/') AS path FROM pages)")
def virtual_path(spark, sf_dir):
    path = text.virtual_path(F.replace("url", F.lit("://"), F.lit("/")), "/vol")
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.split_part(path, F.lit("/"), F.lit(2)).alias("root"))


@_query("SELECT event_id, round(epoch_ms(date_trunc('second', ts)) / 1000.0, 3) AS mtime FROM events UNION ALL SELECT -1, 0.0")
def mtime_epoch(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("s"))
    e = e.unionAll(spark_frame(spark, [(-1, "no date")], "event_id long, s string"))
    return e.select("event_id", text.epoch_seconds(F.col("s")).alias("mtime"))


# --- text functions --------------------------------------------------------------------------------------------


@_query("SELECT doc_id, " + _NORM.format("text") + " AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@_query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]{2,}'), ' ') AS clean FROM documents")
def sanitize_query(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text")).alias("clean"))


_STOP = ", ".join(f"'{w}'" for w in text.KEYWORD_STOP)


@_query(
    "SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: lower(trim(w, '.,;:¿?¡!\"''()'))), lambda w: length(w) >= 2 AND w NOT IN ("
    + _STOP
    + ") AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS kws FROM conversations"
)
def keywords(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("kws"))


_COUNTS = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9', ' '), lambda c: CAST(length(lower({0})) - length(replace(lower({0}), c, '')) AS DOUBLE))"
_UNIT = "list_transform({0}, lambda x: x / CASE WHEN list_dot_product({0}, {0}) > 0 THEN sqrt(list_dot_product({0}, {0})) ELSE 1 END)"


@_query(_with(_CHUNKS, "counted AS (SELECT path, page, " + _COUNTS.format("text") + " AS c FROM chunks)", "u AS (SELECT path, page, " + _UNIT.format("c") + " AS v FROM counted)") + "SELECT path, page, len(v) AS dim, round(v[1], 6) AS v_a, round(v[5], 6) AS v_e, round(v[20], 6) AS v_t, round(list_dot_product(v, v), 6) AS norm FROM u")
def char_encoder(spark, sf_dir):
    u = text.with_char_vector(_chunks(spark, sf_dir).select("path", "page", "text"), F.col("text"), "v")
    at = lambda i: F.round(F.get("v", F.lit(i)), 6)
    return u.select("path", "page", F.size("v").cast("long").alias("dim"), at(0).alias("v_a"), at(4).alias("v_e"), at(19).alias("v_t"), F.round(text.dot(F.col("v"), F.col("v")), 6).alias("norm"))


# --- vector search ---------------------------------------------------------------------------------------------

_TOP = "SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s {}) WHERE rank <= 20"

#: Of the whole table every hundredth id is a query, against all rows.
_SCORED = "s AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.label, q.label AS q_label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"
_BLOCK_QUERIES = 256


def _embedded(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    return asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@_query(_with(_SCORED) + _TOP.format(""))
def vector_topk(spark, sf_dir):
    return ranking.top_k(*_embedded(spark, sf_dir), 20, block=BLOCK_ROWS)


@_query(_with(_SCORED) + _TOP.format("WHERE label = q_label"))
def vector_topk_scoped(spark, sf_dir):
    return ranking.top_k(*_embedded(spark, sf_dir), 20, same=("label", "q_label"), block=BLOCK_ROWS)


@_query(_with(_SCORED) + "SELECT qid, label, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3")
def topk_per_label(spark, sf_dir):
    return ranking.top_k(*_embedded(spark, sf_dir), 3, per="label", block=BLOCK_ROWS)


@_query(_with(_SCORED) + "SELECT qid, id + 1 AS pos, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s")
def rerank_pool(spark, sf_dir):
    """The whole table as each query's pool."""
    asked, vectors = _embedded(spark, sf_dir)
    return ranking.rerank(asked, vectors.withColumn("pos", F.col("id") + 1), block=_BLOCK_QUERIES)


# --- full text -------------------------------------------------------------------------------------------------

_TERMS = "string_split_regex(" + _NORM.format("{}") + ", '[^\\p{{L}}\\p{{N}}]+')"
_INDEX = (
    "post AS (SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TERMS.format("text") + ") AS term FROM documents) WHERE term <> '' GROUP BY 1, 2), "
    "asked AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(" + _TERMS.format("text") + ", lambda t: length(t) >= 2)) AS term FROM benchmark)"
)


_BM25 = (
    "len AS (SELECT id, sum(tf) AS dl FROM post GROUP BY 1)",
    "corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len)",
    "df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)",
    "scored AS (SELECT qid, id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN post USING (term) JOIN df USING (term) JOIN len USING (id), corpus GROUP BY 1, 2)",
)
_BEST = "SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM scored) WHERE rank <= 5"
_ALL_TERMS = "SELECT qid, id FROM asked JOIN post USING (term) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.qid = asked.qid)"
_INDEX_NAMED = _INDEX.replace("FROM documents)", "FROM (SELECT doc_id, 'doc_'||doc_id||'.txt '||coalesce(text, '') AS text FROM documents))")


def _asked_terms(spark, sf_dir):
    terms = F.filter(ranking.terms_of(F.col("text")), lambda t: F.length(t) >= 2)
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(terms).alias("term")).distinct()


@_query(_with(_INDEX, *_BM25) + _BEST)
def fts_bm25(spark, sf_dir):
    """All terms of every item, over the texts."""
    return ranking.bm25(_stored(spark, sf_dir, "postings"), _asked_terms(spark, sf_dir), 5, all_terms=False, length=_stored(spark, sf_dir, "lengths"))


@_query(_with(_INDEX_NAMED, *_BM25) + _BEST)
def fts_bm25_names(spark, sf_dir):
    """The same over file names and texts."""
    return ranking.bm25(_stored(spark, sf_dir, "postings_named"), _asked_terms(spark, sf_dir), 5, all_terms=False, length=_stored(spark, sf_dir, "lengths_named"))


@_query(_with(_INDEX) + _ALL_TERMS)
def fts_and_match(spark, sf_dir):
    """Documents that hold all terms of an item."""
    return ranking.and_match(_stored(spark, sf_dir, "postings"), _asked_terms(spark, sf_dir))


_NAMED_TERMS = "asked(qid, term) AS (VALUES (1, 'doc'), (1, '12'), (2, 'txt'), (2, 'that'), (3, 'zzzz'))"


@_query(_with(_INDEX_NAMED.split("asked AS")[0].rstrip(", "), _NAMED_TERMS) + _ALL_TERMS)
def fts_and_names(spark, sf_dir):
    """Documents of which name and text together hold all terms."""
    asked = spark_frame(spark, [(1, "doc"), (1, "12"), (2, "txt"), (2, "that"), (3, "zzzz")], "qid int, term string")
    return ranking.and_match(_stored(spark, sf_dir, "postings_named"), asked)


@_query(_with(_FILES) + "SELECT path FROM files WHERE list_contains(" + _TOKENS.format("path") + ", 'src1') AND list_contains(" + _TOKENS.format("path") + ", 'de')")
def token_match(spark, sf_dir):
    return _files(spark, sf_dir).where(text.matches_all(text.file_tokens(F.col("path")), strings(["src1", "de"]))).select("path")


_KWS = ["the", "que", "die", "thing", "doc"]
_KW_LIST = "['" + "', '".join(_KWS) + "']"


@_query(_with(_CHUNKS) + f"SELECT path, page, CAST(len(list_filter({_KW_LIST}, lambda k: contains(lower(filename || ' ' || snippet), k))) AS INT) AS n, round(CAST(0.08 AS DOUBLE) * len(list_filter({_KW_LIST}, lambda k: contains(lower(filename || ' ' || snippet), k))), 6) AS boost FROM chunks")
def keyword_boost(spark, sf_dir):
    n = ranking.keyword_matches(strings(_KWS))
    return _stored(spark, sf_dir).select("path", "page", n.alias("n"), F.round(ranking.KEYWORD_BOOST * n, 6).alias("boost"))


_NAME_KW = "kw(kw, ord) AS (VALUES ('doc', 0), ('12', 1), ('doc 7', 2), ('txt', 3), ('zzz', 4))"
_NAME_ROWS = [("doc", 0), ("12", 1), ("doc 7", 2), ("txt", 3), ("zzz", 4)]
_NAME_MET = "met AS (SELECT c.*, kw, ord, row_number() OVER (PARTITION BY kw ORDER BY point_id) AS place FROM chunks c, kw WHERE len(" + _TOKENS.format("kw") + ") > 0 AND list_has_all(" + _TOKENS.format("filename") + ", " + _TOKENS.format("kw") + "))"


@_query(_with(_CHUNKS, _NAME_KW, _NAME_MET) + "SELECT path, page, count(*) AS kw_matches, 1 + CAST(0.1 AS DOUBLE) * count(*) AS score FROM met WHERE place <= 25 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25")
def filename_hits(spark, sf_dir):
    return ranking.name_hits(_stored(spark, sf_dir), spark_frame(spark, _NAME_ROWS, "kw string, ord int"))


@_query(_with(_CHUNKS, _NAME_KW, _NAME_MET) + "SELECT path, CAST(s.ord AS INT) AS ord FROM (SELECT path, min({'ord': ord, 'place': place}) AS s FROM met WHERE place <= 15 AND length(kw) >= 3 GROUP BY 1) ORDER BY s, path LIMIT 5")
def files_similar(spark, sf_dir):
    return ranking.similar_names(_stored(spark, sf_dir), spark_frame(spark, _NAME_ROWS, "term string, ord int"))


# --- fusion ----------------------------------------------------------------------------------------------------

_QTEXT = "the thing that was on"
_VECS = (
    "vecs AS (SELECT point_id, path, page, filename, " + _COUNTS.format("text") + " AS c FROM chunks), unit AS (SELECT point_id, path, page, filename, " + _UNIT.format("c") + " AS v FROM vecs), "
    f"qc AS (SELECT {_COUNTS.format(repr(_QTEXT))} AS c), qv AS (SELECT {_UNIT.format('c')} AS q FROM qc), "
    "sem AS (SELECT point_id, path, page, filename, round(list_dot_product(q, v), 6) AS score FROM unit, qv)"
)


def _question(spark):
    asked = spark_frame(spark, [(0, _QTEXT)], "qid long, t string")
    return text.with_char_vector(asked, F.col("t"), "q").select("qid", "q")


def _hybrid_sql(scope: str) -> str:
    return (
        _with(
            _CHUNKS,
            _VECS,
            f"own AS (SELECT * FROM chunks WHERE {scope}), "
            "h1 AS (SELECT point_id, 'semantic' AS channel, 0 AS ord, row_number() OVER (ORDER BY score DESC, point_id) AS r, score, 1.0 AS weight FROM sem WHERE point_id IN (SELECT point_id FROM own)), "
            "terms(t, ord, w) AS (VALUES ('12', 1, 1.5), ('doc 7', 2, 1.5)), "
            "h2 AS (SELECT point_id, 'filename:'||t AS channel, ord, row_number() OVER (PARTITION BY t ORDER BY point_id) AS r, 1.0 AS score, w AS weight FROM own, terms WHERE list_has_all(" + _TOKENS.format("filename") + ", " + _TOKENS.format("t") + ")), "
            "h3 AS (SELECT point_id, 'expte:src3' AS channel, 3 AS ord, row_number() OVER (ORDER BY point_id) AS r, 1.0 AS score, 1.8 AS weight FROM chunks WHERE list_contains(" + _TOKENS.format("path") + ", 'src3')), "
            "h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3), "
            "b AS (SELECT point_id, channel, round(score * weight, 6) AS final, ord * 1000000 + r AS place FROM h WHERE r <= 20), "
            "best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY final DESC, place) AS rn, min(place) OVER (PARTITION BY point_id) AS first FROM b)",
        )
        + "SELECT CAST(0 AS BIGINT) AS qid, point_id AS key, final, channel, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY final DESC, first) AS rank FROM best WHERE rn = 1) WHERE rank <= 30"
    )


@_query(_hybrid_sql("true"))
def hybrid_3channel(spark, sf_dir):
    """Semantic, file-name and case-number channels with their weights, one list."""
    return ranking.hybrid(_question(spark), _stored(spark, sf_dir), names=("12", "doc 7"), cases=("src3",)).where("rank <= 30")


@_query(_hybrid_sql("carpeta_top = 'src1' OR list_contains(" + _TOKENS.format("path") + ", 'src1')"))
def hybrid_scoped(spark, sf_dir):
    """The same within a folder: vectors and file names in its scope, case numbers everywhere."""
    return ranking.hybrid(_question(spark), _stored(spark, sf_dir), folder="src1", names=("12", "doc 7"), cases=("src3",)).where("rank <= 30")


@_query(_with(_CHUNKS) + "SELECT point_id, path FROM chunks WHERE carpeta_top = 'src2' OR list_contains(" + _TOKENS.format("path") + ", 'src2') OR list_has_all(" + _TOKENS.format("path") + ", ['doc', '17'])")
def scope_filter(spark, sf_dir):
    """A folder, or terms of the path; terms of one character don't count."""
    return _stored(spark, sf_dir).where(ranking.scope_filter("src2", ("doc 17", "x"))).select("point_id", "path")


_BAG = (
    "bag AS (SELECT path, page, 'vector' AS source, score, row_number() OVER (ORDER BY score DESC, point_id) AS ordinal, 0 AS kw_matches FROM sem QUALIFY row_number() OVER (ORDER BY score DESC, point_id) <= 60 "
    "UNION ALL SELECT path, page, 'filename', 1 + 0.1 * n, 1000 + row_number() OVER (ORDER BY n DESC, path, page), n FROM (SELECT path, page, count(*) AS n FROM met WHERE place <= 25 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25)), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY path, page ORDER BY (source = 'filename') DESC, score DESC, ordinal) AS rn, min(ordinal) OVER (PARTITION BY path, page) AS first_ord FROM bag), "
    "fused AS (SELECT path, page, source, score, kw_matches, first_ord FROM ranked WHERE rn = 1)"
)


def _fused(spark, sf_dir):
    chunks = _stored(spark, sf_dir)
    sem = ranking.top_k(_question(spark), chunks.select(F.col("point_id").alias("id"), "path", "page", "vector"), 60, carry=("path", "page"))
    vector = sem.select("path", "page", F.lit("vector").alias("source"), "score", F.col("rank").cast("long").alias("ordinal"), F.lit(0).cast("long").alias("kw_matches"))
    names = ranking.name_hits(chunks, spark_frame(spark, _NAME_ROWS, "kw string, ord int"))
    place = F.row_number().over(Window.orderBy(F.desc("kw_matches"), "path", "page")) + 1000  # at most 25 rows
    return ranking.fuse_sources(vector.unionAll(names.select("path", "page", F.lit("filename").alias("source"), "score", place.cast("long").alias("ordinal"), "kw_matches")))


@_query(_with(_CHUNKS, _VECS, _NAME_KW, _NAME_MET, _BAG) + "SELECT path, page, source, round(score, 6) AS score, CAST(kw_matches AS BIGINT) AS kw_matches, first_ord FROM fused")
def rag_fuse_dedup(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 6))


@_query(
    _with(
        _CHUNKS,
        _VECS,
        _NAME_KW,
        _NAME_MET,
        _BAG,
        "fn AS (SELECT path, page, source, row_number() OVER (ORDER BY kw_matches DESC, score DESC, first_ord) AS slot FROM fused WHERE source = 'filename' QUALIFY slot <= 5)",
        "vx AS (SELECT path, page, source, row_number() OVER (ORDER BY score DESC, first_ord) AS place FROM fused WHERE source = 'vector')",
    )
    + "SELECT path, page, source, CAST(slot AS INT) AS slot FROM fn UNION ALL SELECT path, page, source, CAST(place + (SELECT count(*) FROM fn) AS INT) FROM vx WHERE place <= 10 - (SELECT count(*) FROM fn)"
)
def slot_merge(spark, sf_dir):
    return ranking.slots(_fused(spark, sf_dir))


# --- context and reading ---------------------------------------------------------------------------------------

_BLOCK = "'--- Pag. '||c.page||CASE WHEN c.page = h.page THEN ' [PAG ACTUAL]' ELSE '' END||' ---'||chr(10)||left(trim(c.snippet), 1800)"


@_query(_with(_CHUNKS) + f"SELECT h.path, h.page, string_agg({_BLOCK}, chr(10)||chr(10) ORDER BY c.page) AS context FROM chunks h JOIN chunks c ON h.path = c.path AND c.page BETWEEN h.page - 1 AND h.page + 1 WHERE trim(c.snippet) <> '' GROUP BY 1, 2")
def context_window(spark, sf_dir):
    """Each chunk of the table is a hit."""
    chunks = _stored(spark, sf_dir)
    hits = chunks.select(F.struct("path", "page").alias("hid"), "path", "page")
    return ranking.context(hits, chunks).select("hid.path", "hid.page", "context")


@_query(_with(_CHUNKS) + "SELECT page, snippet AS text FROM chunks WHERE path = (SELECT path FROM files ORDER BY size DESC, path LIMIT 1) AND page = 2")
def read_page(spark, sf_dir):
    path = _files(spark, sf_dir).orderBy(F.desc("size"), "path").select("path").first()[0]
    return store.read_pages(_stored(spark, sf_dir), path, 2, 2)


@_query(_with(_CHUNKS) + "SELECT page, snippet AS text FROM chunks WHERE path = (SELECT path FROM files ORDER BY size DESC, path LIMIT 1) AND page BETWEEN 2 AND 21")
def read_range(spark, sf_dir):
    path = _files(spark, sf_dir).orderBy(F.desc("size"), "path").select("path").first()[0]
    return store.read_pages(_stored(spark, sf_dir), path, 2, 60)


# --- the store -------------------------------------------------------------------------------------------------


@_query("SELECT DISTINCT source AS carpeta_top FROM documents")
def distinct_folders(spark, sf_dir):
    return _chunks_folders(spark, sf_dir)


def _chunks_folders(spark, sf_dir):
    return _files(spark, sf_dir).select(text.folder_top(F.col("path")).alias("carpeta_top")).distinct()


@_query(_with(_FILES, "known AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN mtime + 0.0005 ELSE mtime + 1 END AS m FROM files WHERE doc_id % 2 = 0)") + "SELECT doc_id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = f.path AND abs(f.mtime - k.m) <= 0.001)")
def incremental_antijoin(spark, sf_dir):
    files = _files(spark, sf_dir)
    late = F.when(F.col("doc_id") % 3 == 0, F.col("mtime") + 0.0005).otherwise(F.col("mtime") + 1)
    known = files.where("doc_id % 2 = 0").select("path", late.alias("mtime"), "size")
    return store.unseen(files, known).select("doc_id", "path")


_LISTED = "listed(path, mtime, size) AS (" + sql_values(cases.LISTED) + "), known(path, mtime, size) AS (" + sql_values(cases.KNOWN) + ")"


@_query("WITH " + _LISTED + " SELECT path, mtime, 'path_mtime' AS rule FROM listed l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = l.path AND abs(l.mtime - k.mtime) <= 0.001) UNION ALL SELECT path, mtime, 'with_size' FROM listed l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = l.path AND abs(l.mtime - k.mtime) < 0.001 AND k.size = l.size)")
def exists_path_mtime(spark, sf_dir):
    kind = "path string, mtime double, size long"
    listed, known = spark_frame(spark, cases.LISTED, kind), spark_frame(spark, cases.KNOWN, kind)
    one = store.unseen(listed, known).select("path", "mtime", F.lit("path_mtime").alias("rule"))
    return one.unionAll(store.unseen(listed, known, inclusive=False, same_size=True).select("path", "mtime", F.lit("with_size").alias("rule")))


@_query(
    _with(_CHUNKS, "new AS (SELECT point_id, path, page, 'v1' AS snippet, 1 AS seq FROM chunks WHERE page = 1 UNION ALL SELECT point_id, path, page, 'v2', 2 FROM chunks WHERE page = 1 AND ends_with(path, '0.txt'))", "last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) = 1)")
    + "SELECT point_id, path, page, snippet FROM last UNION ALL SELECT point_id, path, page, snippet FROM chunks WHERE point_id NOT IN (SELECT point_id FROM last)"
)
def upsert_latest(spark, sf_dir):
    stored = _stored(spark, sf_dir).select("point_id", "path", "page", "snippet")
    first = stored.where("page = 1")
    new = first.withColumns({"snippet": F.lit("v1"), "seq": F.lit(1)}).unionAll(first.where(F.col("path").endswith("0.txt")).withColumns({"snippet": F.lit("v2"), "seq": F.lit(2)}))
    return store.upsert(stored, new)


@_query(_with(_CHUNKS) + "SELECT point_id, path FROM chunks WHERE path <> (SELECT min(path) FROM files)")
def delete_by_path(spark, sf_dir):
    path = _files(spark, sf_dir).agg(F.min("path")).first()[0]
    return store.delete_path(_stored(spark, sf_dir), path).select("point_id", "path")


@_query(_with(_CHUNKS, "new AS (SELECT path, page, snippet FROM chunks WHERE page = 1 AND carpeta_top = 'src1')") + "SELECT path, page, 'new' AS origin FROM new UNION ALL SELECT path, page, 'old' FROM chunks WHERE path NOT IN (SELECT path FROM new)")
def replace_file(spark, sf_dir):
    stored = _stored(spark, sf_dir).select("path", "page", F.lit("old").alias("origin"))
    new = _stored(spark, sf_dir).where("page = 1 AND carpeta_top = 'src1'").select("path", "page", F.lit("new").alias("origin"))
    return store.replace_file(stored, new)


@_query(_with(_CHUNKS) + "SELECT point_id, CASE WHEN page % 2 = 0 THEN '' ELSE 'x' || carpeta_top END AS old, carpeta_top AS new FROM chunks WHERE page <> 3")
def backfill_diff(spark, sf_dir):
    old = F.when(F.col("page") == 3, F.col("carpeta_top")).when(F.col("page") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("x"), "carpeta_top"))
    chunks = _stored(spark, sf_dir).select("point_id", "path", old.alias("stored"))
    return store.backfill(chunks, "stored", text.folder_top(F.col("path")))


_PAGE_EXT = "lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1))"


@_query(f"SELECT {_PAGE_EXT} AS ext, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def ext_breakdown(spark, sf_dir):
    return store.extension_breakdown(_table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size")))


@_query("SELECT count(*) FILTER (WHERE quality = 1) AS files_ok, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS files_sin_texto, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS files_err, CAST(sum(quality) AS BIGINT) AS chunks FROM labels")
def index_stats(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "error:x").otherwise("sin_texto")
    return store.index_stats(_table(spark, sf_dir, "labels").select(status.alias("status"), F.col("quality").alias("n_chunks")))


@_query("SELECT path, ext IN ('.pdf', '.docx', '.doc', '.txt') AND NOT contains(lower(path), '#recycle/') AND NOT contains(lower(path), 'thumbs.db') AND NOT starts_with(name, '~$') AS supported FROM (SELECT path, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS name FROM (SELECT CASE doc_id % 5 WHEN 0 THEN '/a/#recycle/' WHEN 1 THEN '/a/~$' ELSE '/a/' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.png' END AS path FROM documents))")
def supported_files(spark, sf_dir):
    from siltstone.sources.files import is_supported

    head = F.when(F.col("doc_id") % 5 == 0, "/a/#recycle/").when(F.col("doc_id") % 5 == 1, "/a/~$").otherwise("/a/")
    tail = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".png")
    return _table(spark, sf_dir, "documents").select(F.concat(head, "doc_id", tail).alias("path")).select("path", is_supported(F.col("path")).alias("supported"))


# --- query analysis --------------------------------------------------------------------------------------------


@_query("WITH e(qid, numbers) AS (" + sql_values([(2, "88412/2031,640218"), (7, "73310/2032,557301"), (16, "73310"), (19, "30998877665"), (21, "AB-12/9"), (22, "13-0655"), (23, "4455"), (24, "12345")]) + "), " + _Q + " SELECT q.qid, coalesce(numbers, '') AS numbers FROM q LEFT JOIN e USING (qid)")
def extract_case_numbers(spark, sf_dir):
    return _cases(spark).select("qid", F.array_join(analysis.case_numbers(F.col("t")), ",").alias("numbers"))


_CAPS_STOP = ", ".join(f"'{w}'" for w in analysis.CAPS_STOP)


@_query("SELECT doc_id, list_sort(list_distinct(list_filter(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-ZÁÉÍÓÚÑ]{4,}')), lambda w: w NOT IN (" + _CAPS_STOP + ")))) AS names FROM documents")
def extract_caps_names(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sort_array(analysis.caps_names(F.col("text"))).alias("names"))


def _sql_any(hay: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({hay}, '{w}')" for w in words) + ")"


_CASE_HIT, _CONCEPT_HIT = _sql_any("n", analysis.CASE_WORDS), _sql_any("n", analysis.CONCEPT_WORDS)


@_query(
    f"WITH {_Q}, m AS (SELECT qid, t, {_NORM.format('t')} AS n FROM q) SELECT qid, CASE WHEN {_CASE_HIT} AND NOT {_CONCEPT_HIT} THEN 'caso' WHEN {_CONCEPT_HIT} AND NOT {_CASE_HIT} THEN 'concepto' ELSE 'mixto' END AS intent, {_sql_any('n', analysis.FOLLOW_WORDS)} AS follow_up, {_sql_any('lower(t)', analysis.DRAFT_VERBS)} AND {_sql_any('lower(t)', analysis.DRAFT_KINDS)} AS draft FROM m"
)
def intent(spark, sf_dir):
    t = F.col("t")
    return _cases(spark).select("qid", analysis.intent(t).alias("intent"), analysis.follow_up(t).alias("follow_up"), analysis.wants_draft(t).alias("draft"))


_TRIV = ", ".join(f"'{w}'" for w in text.TRIVIAL)


@_query(
    f"WITH {_Q}, s AS (SELECT qid, trim(regexp_replace(lower(trim(t)), '[?!.]+$', '')) AS x FROM q) SELECT qid, length(x) <= 2 OR x IN ({_TRIV}) OR (len(string_split_regex(x, '\\s+')) <= 3 AND len(list_filter(string_split_regex(x, '\\s+'), lambda w: NOT (w IN ({_TRIV}) OR length(w) <= 3))) = 0) AS trivial FROM s"
)
def trivial(spark, sf_dir):
    return _cases(spark).select("qid", text.is_trivial(F.col("t")).alias("trivial"))


@_query("WITH e(qid, negated) AS (" + sql_values([(4, "Molinos"), (11, "por el puente|Taller Oeste"), (25, "Viento Norte"), (26, "eso")]) + "), " + _Q + " SELECT q.qid, coalesce(negated, '') AS negated FROM q LEFT JOIN e USING (qid)")
def negations(spark, sf_dir):
    return _cases(spark).select("qid", F.array_join(analysis.negations(F.col("t")), "|").alias("negated"))


_FOLDER_TEXT = [
    (1, "Molinos", "Que dice la demanda de VALDERRAMA"),
    (2, None, "mandame el Expte. y el N°"),
    (7, None, "FMZ contra OLMEDO y OLMEDO, numero"),
    (12, "Faros", "listar revisar"),
    (13, None, "Áéíóú Ñandú Über"),
    (16, None, "planilla y 733104 sueltas"),
    (19, None, "el saldo es 90.117/2033 segun CUIT"),
    (21, None, "Expediente ."),
    (22, None, "CUIJ ; expte"),
    (23, None, "N"),
    (24, None, "cinco y otra vez"),
    (27, "Lanas Finas", "buscame algo"),
    (28, "Viejos", "lo ultimo"),
]


@_query("WITH e(qid, folder, semantic) AS (" + sql_values(_FOLDER_TEXT) + "), " + _Q + " SELECT q.qid, e.folder, coalesce(semantic, t) AS semantic FROM q LEFT JOIN e USING (qid)")
def folder_and_semantic_text(spark, sf_dir):
    t = F.col("t")
    return _cases(spark).select("qid", analysis.folder_phrase(t).alias("folder"), analysis.semantic_text(t, analysis.case_numbers(t)).alias("semantic"))


_CASCADE = [
    (1, "molinos", "Molinos", 1),
    (2, "FÁROS", "Documentos Faros", 2),
    (3, "documentos", "Documentos Faros", 2),
    (4, "lamas finaz", "Lanas Finas", 5),
    (5, "zzz", "zzz", 6),
    (6, "depositos viejos", "Deposito", 2),
    (7, "finas telas", "Lanas Finas", 3),
    (8, "norteño del viento", "Viento del Norte", 3),
    (9, "xx molin yy", "Molinos", 4),
    (10, "xx olino", "Molinos", 4),
    (11, "depsito", "Deposito", 5),
    (12, "a", "Lanas Finas", 2),
    (13, "lan", "Lanas Finas", 2),
    (14, "qq posit ww", "Deposito", 4),
    (15, "vientos", "Viento del Norte", 5),
]


@_query("SELECT * FROM (" + sql_values(_CASCADE) + ") e(qid, raw, folder, level)")
def folder_cascade(spark, sf_dir):
    return analysis.match_folder(spark_frame(spark, cases.ASKED, "qid int, raw string"), spark_frame(spark, cases.FOLDERS, "folder string"))


_CTX = [
    (1, 0, "Molinos", "88412", "VALDERRAMA"),
    (1, 1, "Molinos", "88412", "VALDERRAMA"),
    (1, 2, "Molinos", "557301", ""),
    (1, 3, None, "557301", ""),
    (2, 0, None, "", "OLMEDO"),
    (2, 1, None, "", "OLMEDO"),
    (2, 2, "Lanas", "", "OLMEDO"),
    (3, 0, "Deposito", "1,22222", ""),
    (3, 1, "Deposito", "1", "QUIROGA"),
    (3, 2, "Deposito", "33333", "SORIA"),
    (3, 3, "Deposito", "33333", ""),
    (4, 0, None, "", ""),
    (4, 1, None, "", ""),
]


@_query("SELECT conv, turn, carpeta, expedientes, nombres FROM (" + sql_values(_CTX) + ") e(conv, turn, carpeta, expedientes, nombres)")
def context_fold(spark, sf_dir):
    rows = spark_frame(spark, cases.CONTEXTS, "conv int, turn long, carpeta string, expedientes array<string>, nombres array<string>, negated array<string>")
    out = analysis.fold_context(rows)
    return out.select("conv", F.col("turn").cast("int").alias("turn"), "carpeta", F.array_join("expedientes", ",").alias("expedientes"), F.array_join("nombres", ",").alias("nombres"))


#: conv, turn, text_semantic, carpeta, expedientes, nombres, intent, follow_up, negations
_ANALYSED = [
    (1, 0, "que hay demanda de VALDERRAMA N°", "Molinos", "640218", "VALDERRAMA", "caso", False, ""),
    (1, 1, "dame el segundo", "Molinos", "640218", "VALDERRAMA", "mixto", True, ""),
    (1, 2, "y el Expte. ?", "Molinos", "88412/2031", "VALDERRAMA", "mixto", False, ""),
    (1, 3, "no dije molinos, seguí", None, "88412/2031", "VALDERRAMA", "mixto", True, "molinos"),
    (1, 4, "¿qué es la regla?", None, "88412/2031", "VALDERRAMA", "concepto", False, ""),
    (2, 0, "los casos de Lanas Finas", "Lanas Finas", "", "", "caso", False, ""),
    (2, 1, "ahora OLMEDO", "Lanas Finas", "", "OLMEDO", "mixto", False, ""),
    (2, 2, "yo no hablé de olmedo.", "Lanas Finas", "", "", "mixto", False, "olmedo"),
    (2, 3, "planos", "Documentos Faros", "", "", "mixto", False, ""),
    (2, 4, "", None, "", "", "mixto", False, ""),
    (2, 5, "otro", "Documentos Faros", "", "", "mixto", True, ""),
    (3, 0, "", None, "", "", "mixto", False, ""),
    (3, 1, "definicion de oficio y del escrito", None, "", "", "mixto", False, ""),
    (3, 2, "ver", "Inventada", "", "", "mixto", False, ""),
    (3, 3, "todo de viento del norte y lanas finas", "Viento del Norte", "", "", "mixto", False, ""),
    (4, 0, "mirá el depósito: y 733104", "Deposito", "73310", "", "mixto", False, ""),
    (4, 1, "depositos", "Deposito", "73310", "", "mixto", False, ""),
    (4, 2, "no pregunté por 73310, gracias", "Deposito", "", "", "mixto", False, "por 73310"),
    (5, 0, "hola", None, "", "", "mixto", False, ""),
    (5, 1, "", None, "", "", "mixto", False, ""),
    (5, 2, "PARA TODOS QUIROGA", None, "", "QUIROGA", "mixto", False, ""),
    (5, 3, "cual es el articulo 44", None, "", "QUIROGA", "concepto", False, ""),
]


@_query("SELECT * FROM (" + sql_values(_ANALYSED) + ") e(conv, turn, text_semantic, carpeta, expedientes, nombres, intent, follow_up, negations)")
def analyze_query(spark, sf_dir):
    """Whole conversations: what each turn says, its folder against the known ones, and what earlier turns hand on."""
    turns, folders = spark_frame(spark, cases.TURNS, "conv int, turn int, text string"), spark_frame(spark, cases.FOLDERS, "folder string")
    joined = {c: F.array_join(c, ",") for c in ("expedientes", "nombres", "negations")}
    out = analysis.analyze_queries(turns, folders).withColumns(joined)
    return out.select("conv", F.col("turn").cast("int").alias("turn"), "text_semantic", "carpeta", "expedientes", "nombres", "intent", "follow_up", "negations")


_VAR = "asking(qid, text) AS (" + sql_values(cases.ASKING) + "), given(qid, ord, text) AS (" + sql_values(cases.VARIANTS) + "), usable AS (SELECT qid, ord, trim(trim(text, '-•* ')) AS text FROM given WHERE qid IN (SELECT qid FROM asking)), placed AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ord) AS INT) AS variant, text FROM usable WHERE length(text) BETWEEN 3 AND 200), v AS (SELECT qid, 0 AS variant, text FROM asking UNION ALL SELECT * FROM placed WHERE variant <= 3)"


def _variants(spark):
    return ranking.with_variants(spark_frame(spark, cases.ASKING, "qid int, text string"), spark_frame(spark, cases.VARIANTS, "qid int, ord int, text string"))


@_query("WITH " + _VAR + " SELECT qid, variant, text FROM v")
def query_variants(spark, sf_dir):
    return _variants(spark)


@_query(
    "WITH " + _VAR + ", w AS (SELECT qid, variant, list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: lower(trim(w, '.,;:¿?¡!\"''()'))), lambda w: length(w) >= 2 AND w NOT IN ("
    + _STOP
    + ") AND NOT regexp_full_match(w, '[0-9]+')) AS ks FROM v), u AS (SELECT qid, variant, unnest(ks) AS k, generate_subscripts(ks, 1) AS spot FROM w), f AS (SELECT qid, k, min(variant * 1000 + spot) AS place FROM u GROUP BY 1, 2) SELECT qid, string_agg(k, ' ' ORDER BY place) AS keywords FROM f GROUP BY 1"
)
def variant_keywords(spark, sf_dir):
    """Keywords of a request and its variants in order, each once."""
    return ranking.variant_keywords(_variants(spark)).select("qid", F.array_join("keywords", " ").alias("keywords"))


# --- models, results as text -----------------------------------------------------------------------------------


def _letter_model():
    """A stand-in for an encoder: letters and digits counted in Python."""
    import numpy as np

    return lambda texts: np.array([[t.lower().count(c) for c in text.LETTERS] for t in texts], dtype=np.float32)


@_query(_with(_CHUNKS, "counted AS (SELECT path, page, " + _COUNTS.format("snippet") + " AS c FROM chunks)", "u AS (SELECT path, page, " + _UNIT.format("c") + " AS v FROM counted)") + "SELECT path, page, round(v[1], 4) AS v_a, round(v[5], 4) AS v_e FROM u")
def encoder_udf(spark, sf_dir):
    """A pluggable encoder over all snippets."""
    v = models.encoder(F.col("snippet"), "letters", _letter_model)
    return _stored(spark, sf_dir).select("path", "page", v.alias("v")).select("path", "page", *(F.round(F.get("v", F.lit(i)).cast("double"), 4).alias(n) for i, n in ((0, "v_a"), (4, "v_e"))))


def _overlap_model():
    """A stand-in for a cross-encoder: distinct words of the query that the text has."""
    return lambda pairs: [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in pairs]


@_query(
    _with(_CHUNKS)
    + f", h AS (SELECT page % 7 AS qid, row_number() OVER (PARTITION BY page % 7 ORDER BY point_id) AS rank, point_id, left(filename || ' ' || snippet, 2000) AS hit FROM chunks), s AS (SELECT *, CAST(len(list_intersect(list_distinct(string_split('{_QTEXT}', ' ')), list_distinct(string_split_regex(lower(hit), '\\s+')))) AS DOUBLE) AS ce_score FROM h) SELECT * FROM (SELECT qid, point_id, ce_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY ce_score DESC, rank) AS INT) AS rank FROM s) WHERE rank <= 10"
)
def cross_encoder_rerank(spark, sf_dir):
    """Each seventh of the pages as the pool of one query, reordered by a pluggable scorer."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("point_id"))
    hits = _stored(spark, sf_dir).select((F.col("page") % 7).alias("qid"), F.lit(_QTEXT).alias("query"), "filename", "snippet", "point_id").withColumn("rank", rank)
    scorer = models.pair_scorer(F.col("query"), F.col("hit_text"), "overlap", _overlap_model)
    return ranking.rerank_pairs(hits, scorer, 10).select("qid", "point_id", "ce_score", "rank")


@_query("SELECT vec_id, octet_length(b) AS bytes, ok FROM (SELECT vec_id, 4 * len(embedding) AS n, true AS ok, encode(repeat('x', CAST(4 * len(embedding) AS INT))) AS b FROM embeddings)")
def vector_blobs(spark, sf_dir):
    """Vectors as bytes and back."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", models.vector_bytes(F.col("embedding")).alias("b"))
    return rows.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (models.vector_of_bytes(F.col("b")) == F.col("embedding")).alias("ok"))


_HIT_ROWS = "h(qid, rank, filename, page, channel, snippet, path, score, context) AS (" + sql_values(cases.HITS) + ")"
_HIT_KIND = "qid int, rank int, filename string, page int, channel string, snippet string, path string, score double, context string"


@_query("WITH " + _HIT_ROWS + " SELECT qid, rank, '[' || rank || '] ' || coalesce(filename, '?') || CASE WHEN coalesce(page, 0) = 0 THEN ' (preview)' ELSE ' (pag. ' || page || ')' END || CASE WHEN coalesce(channel, 'semantic') = 'semantic' THEN '' ELSE ' [' || channel || ']' END || ' - ' || left(coalesce(snippet, ''), 300) || chr(10) || '    path: ' || coalesce(path, '?') AS line FROM h")
def result_lines(spark, sf_dir):
    return ranking.result_lines(spark_frame(spark, cases.HITS, _HIT_KIND))


@_query("WITH " + _HIT_ROWS + " SELECT qid, '## CONTEXTO' || chr(10) || chr(10) || string_agg(chr(10) || '### [' || rank || '] ' || filename || ' — pag. ' || page || ' (score ' || format('{:,.2f}', score) || ')' || chr(10) || '_Ruta: ' || path || '_' || chr(10) || chr(10) || context || chr(10), chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) AS block FROM h WHERE filename IS NOT NULL GROUP BY qid")
def context_block(spark, sf_dir):
    return ranking.context_block(spark_frame(spark, cases.HITS, _HIT_KIND).where("filename is not null"))


@_query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(CAST(l_quantity AS INT) - 5, 10)) AS INT) AS top_k, CAST(greatest(greatest(1, least(CAST(l_quantity AS INT) - 5, 10)), 20) AS INT) AS pool FROM lineitem")
def top_k_clamp(spark, sf_dir):
    k = ranking.clamp_top_k(F.col("l_quantity").cast("int") - 5)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("top_k"), ranking.pool_size(k).alias("pool"))


@_query(_with(_CHUNKS) + "SELECT count(*) AS points, count(DISTINCT path) AS files, CAST(36 AS BIGINT) AS vector_size FROM chunks")
def collection_info(spark, sf_dir):
    return store.collection_info(_stored(spark, sf_dir))


@_query(_with(_CHUNKS) + "SELECT count(*) AS rows, count(*) FILTER (WHERE page <> 3) AS to_fix, count(*) FILTER (WHERE page <> 3 AND page % 2 = 0) AS empty FROM chunks")
def backfill_counts(spark, sf_dir):
    """What a dry run of the backfill says."""
    old = F.when(F.col("page") == 3, F.col("carpeta_top")).when(F.col("page") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("x"), "carpeta_top"))
    return store.backfill_counts(_stored(spark, sf_dir).select("path", old.alias("stored")), "stored", text.folder_top(F.col("path")))


@_query(_with(_CHUNKS) + "SELECT point_id, carpeta_top FROM chunks")
def backfill_set(spark, sf_dir):
    """The column that the backfill sets, after it, where it was wrong before."""
    stored = _stored(spark, sf_dir).select("point_id", "path", F.lit("wrong").alias("carpeta_top"))
    return store.set_column(stored, "carpeta_top", text.folder_top(F.col("path"))).select("point_id", "carpeta_top")


@_query(_with(_CHUNKS) + "SELECT string_agg('[Pagina ' || page || ']' || chr(10) || snippet, chr(10) || chr(10) ORDER BY page) AS text FROM chunks WHERE path = (SELECT path FROM files ORDER BY size DESC, path LIMIT 1) AND page BETWEEN 2 AND 21")
def read_range_marked(spark, sf_dir):
    path = _files(spark, sf_dir).orderBy(F.desc("size"), "path").select("path").first()[0]
    return store.read_marked(_stored(spark, sf_dir), path, 2, 60)


@_query(_with(_FILES, "known AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN mtime ELSE mtime + 1 END AS mtime, size, doc_id % 3 <> 0 AS fully_extracted FROM files WHERE doc_id % 2 = 0)") + "SELECT f.path, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.path = f.path AND fully_extracted AND k.size = f.size AND abs(k.mtime - f.mtime) < 0.001) THEN 'ya_estaba' ELSE 'pendiente' END AS state FROM files f")
def promotion_state(spark, sf_dir):
    return store.promotion_state(_files(spark, sf_dir), _known_full(spark, sf_dir))


_FORWARDED = [(1, "text:hola::|image_url::" + cases.PNG + ":low"), (2, "image_url::https://x.example/a.png:"), (3, ""), (4, "image_url::" + cases.PNG + ":|text:::")]


@_query("SELECT * FROM (" + sql_values(_FORWARDED) + ") e(mid, forwarded)")
def forwarded_parts(spark, sf_dir):
    """Parts of a message that are passed on: texts, and images at valid addresses with a known detail."""
    rows = spark_frame(spark, cases.PARTS, "mid int, parts array<struct<type: string, text: string, url: string, detail: string>>")
    nested = F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.struct(p["url"].alias("url"), p["detail"].alias("detail")).alias("image_url")))
    said = lambda p: F.concat_ws(":", *(F.coalesce(p[c], F.lit("")) for c in ("type", "text", "url", "detail")))
    return rows.select("mid", F.array_join(F.transform(text.forwarded_parts(nested), said), "|").alias("forwarded"))


# --- conversations and citations -------------------------------------------------------------------------------

_TOK = "greatest(1, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT))"


@_query(f"SELECT conv_id, CAST(sum({_TOK}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1")
def token_total(spark, sf_dir):
    return conversation.token_totals(_table(spark, sf_dir, "conversations"))


@_query(
    f"WITH c AS (SELECT *, sum({_TOK}) OVER (PARTITION BY conv_id) AS tokens, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id) AS others, row_number() OVER (PARTITION BY conv_id, role <> 'system' ORDER BY turn DESC) AS back FROM conversations), "
    "g AS (SELECT *, tokens > 500 AND others > 4 AND role <> 'system' AND back > 4 AS gone FROM c) SELECT conv_id, turn, role, text FROM g WHERE NOT gone UNION ALL SELECT conv_id, -1, 'system', '## Resumen: '||count(*)||' turnos' FROM g WHERE gone GROUP BY conv_id"
)
def compact_tail4(spark, sf_dir):
    return conversation.compact(_table(spark, sf_dir, "conversations"), 500)


_CITES = [(1, "acuerdo.pdf", 3, True), (1, "PLANO (7).pdf", 12, True), (1, "ajeno.docx", 7, False), (3, "Informe Anual.txt", 9, True), (3, "acuerdo.pdf", 4, False), (5, "a.doc", 1, True), (5, "a.doc", 2, True), (5, "A.DOC", 3, True)]


@_query("SELECT * FROM (" + sql_values(_CITES) + ") e(aid, filename, page, valid)")
def citations_validate(spark, sf_dir):
    answers, files = spark_frame(spark, cases.ANSWERS, "aid int, answer string"), spark_frame(spark, cases.CITED, "aid int, filename string")
    return ranking.citations(answers, files).select("aid", "filename", "page", "valid")


@_query("WITH c(cid, cited, paths) AS (" + sql_values(cases.TOLERANT) + f"), n AS (SELECT cid, {_NORM.format('cited')} AS c, list_transform(paths, lambda p: {_NORM.format('regexp_extract(p, ' + repr('([^/]*)$') + ', 1)')}) AS ps FROM c) SELECT cid, c <> '' AND len(list_filter(ps, lambda p: contains(p, c) OR contains(c, p))) > 0 AS ok FROM n")
def citation_tolerant(spark, sf_dir):
    return spark_frame(spark, cases.TOLERANT, "cid int, cited string, paths array<string>").select("cid", ranking.citation_matches(F.col("cited"), F.col("paths")).alias("ok"))


@_query("SELECT filename, rank, case_file, CAST(row_number() OVER (ORDER BY case_file DESC, rank) AS INT) AS new_rank FROM (SELECT filename, rank, regexp_matches(filename, '(?i)(N[°º]?\\.?\\s*\\d|Expte|Exp\\.|FMZ|\\d{5,})|(\\bc/\\b)|(\\bvs?\\b)') AS case_file FROM (" + sql_values(cases.NAMED) + ") n(filename, rank))")
def case_reorder(spark, sf_dir):
    return ranking.case_first(spark_frame(spark, cases.NAMED, "filename string, rank int").withColumn("qid", F.lit(0))).drop("qid")


@_query(
    "WITH l(lid, line) AS (" + sql_values(cases.LINES) + "), r AS (SELECT lid, rtrim(line) AS x FROM l) SELECT lid, CASE WHEN x = '' THEN 'blank' WHEN regexp_full_match(x, '#{1,3}\\s+.+') THEN 'heading'||length(regexp_extract(x, '^(#+)', 1)) WHEN regexp_full_match(x, '[-*]\\s+.+') THEN 'bullet' WHEN regexp_full_match(x, '\\d+[.)]\\s+.+') THEN 'number' WHEN upper(x) = x AND lower(x) <> x AND length(x) > 4 THEN 'title' ELSE 'text' END AS kind FROM r"
)
def md_line_class(spark, sf_dir):
    return spark_frame(spark, cases.LINES, "lid int, line string").select("lid", text.line_class(F.col("line")).alias("kind"))


@_query("SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_id FROM events GROUP BY 1")
def stream_ingest_events(spark, sf_dir):
    """The event table through the micro-batch ingest, keyed by event; then counts of what was stored."""
    stored = stream_ingest(spark, f"{sf_dir.rstrip('/')}/events.parquet", key="event_id")
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@_query("SELECT uid, ok FROM (" + sql_values(cases.IMAGES) + ") e(uid, url, ok)")
def image_urls(spark, sf_dir):
    rows = spark_frame(spark, cases.IMAGES, "uid int, url string, ok boolean")
    return rows.select("uid", text.valid_image_url(F.col("url")).alias("ok"))


@_query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || role ELSE text END AS content FROM conversations")
def content_parts(spark, sf_dir):
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image_url", F.lit(None).cast("string")), part("text", F.when(F.col("turn") % 2 == 0, F.col("role"))))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_text(parts).alias("content"))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@_query(
    f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n FROM d), p AS (SELECT *, list_position(n, 'that') AS pos FROM b), f AS (SELECT *, greatest(1, pos - 5) AS first FROM p WHERE pos > 0) "
    "SELECT doc_id, CASE WHEN first > 1 THEN '... ' ELSE '' END || array_to_string(list_transform(list_slice(w, first, first + 19), lambda x, i: CASE WHEN n[first + i - 1] = 'that' THEN '<<' || x || '>>' ELSE x END), ' ') || CASE WHEN first + 20 <= len(w) THEN ' ...' ELSE '' END AS excerpt FROM f"
)
def fts_excerpt(spark, sf_dir):
    shown = ranking.excerpt(F.col("text"), F.lit("that"))
    return _table(spark, sf_dir, "documents").select("doc_id", shown.alias("excerpt")).where("excerpt is not null")


_KNOWN_FULL = "known AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN mtime ELSE mtime + 1 END AS mtime, size, doc_id % 3 <> 0 AS fully_extracted FROM files WHERE doc_id % 2 = 0)"


def _known_full(spark, sf_dir):
    files = _files(spark, sf_dir).where("doc_id % 2 = 0")
    late = F.when(F.col("doc_id") % 4 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1)
    return files.select("path", "text", late.alias("mtime"), "size", (F.col("doc_id") % 3 != 0).alias("fully_extracted"))


@_query(_with(_FILES, _KNOWN_FULL) + "SELECT path, 0 AS page, CASE WHEN doc_id % 5 = 0 THEN filename ELSE left(text, 750) END AS text FROM files f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = f.path AND fully_extracted AND k.size = f.size AND abs(k.mtime - f.mtime) < 0.001)")
def upsert_lite(spark, sf_dir):
    files = _files(spark, sf_dir)
    new = files.select("path", F.substring_index("path", "/", -1).alias("filename"), "mtime", "size", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("preview"))
    return store.lite_rows(new, _known_full(spark, sf_dir)).select("path", "page", "text")


@_query(_with(_CHUNKS) + "SELECT path, page, text FROM chunks WHERE path IN (SELECT path FROM files WHERE doc_id % 2 = 0 AND doc_id % 3 = 0)")
def promote_pending(spark, sf_dir):
    return store.promote(_known_full(spark, sf_dir)).select("path", "page", "text")


@_query("SELECT CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 THEN 'error' ELSE 'sin_texto' END AS status, count(*) AS files, CAST(sum(quality) AS BIGINT) AS chunks FROM labels GROUP BY 1")
def run_tally(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "error").otherwise("sin_texto")
    return store.run_tally(_table(spark, sf_dir, "labels").select(status.alias("status"), F.col("quality").alias("n_chunks")))
