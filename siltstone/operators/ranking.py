"""Ranking: cosine top-k, BM25, name matches, the two fusions, slots, context and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.analysis import CITATION, is_case_file
from siltstone.functions.text import dot, file_tokens, fold, keywords, matches_all, normalize
from siltstone.operators.nearest import BLOCK_ROWS, nearest
from siltstone.schema import CONTEXT_CHARS


#: Queries up to which the whole set meets each row by a broadcast; more meet in blocks.
FEW_QUERIES = 256


def _met(queries: DataFrame, vectors: DataFrame, block: int | None) -> DataFrame:
    """Each query with each row of ``vectors``. At most ``FEW_QUERIES`` are broadcast; of more, ``block`` at a time
    meet a partition of ``vectors``, so that neither side has to fit in memory."""
    n = queries.count()
    if n <= FEW_QUERIES and block is None:
        return vectors.join(F.broadcast(queries))
    blocks = max(1, -(-n // (block or FEW_QUERIES)))
    return vectors.join(queries.repartition(blocks).hint("shuffle_replicate_nl"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, same: tuple[str, str] | None = None, per: str | None = None, block: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``qid, id, score, rank``: the k nearest by dot product of unit vectors, ties by id; with ``per``, a column
    of ``vectors``, also that column and the k nearest in each of its values; and the columns of ``carry``.
    ``same (a, b)``: only rows of ``vectors`` whose ``a`` is the query's ``b``. What has no product is no candidate.

    ``queries (qid, q)`` is broadcast if it is counted as small (a request's variants), else, or with a ``block``, met in
    blocks (``nearest``); each row of ``vectors (id, vector, ...)`` is scored where it lies, and only k rows a task and
    query move.
    """
    extra = [per] if per else []
    if block is None and queries.count() <= FEW_QUERIES:
        on = F.col(same[0]) == F.col(same[1]) if same else F.lit(True)
        met = vectors.join(F.broadcast(queries), on)
        scored = met.select("qid", *extra, "id", *carry, F.round(dot(F.col("q"), F.col("vector")), 6).alias("score")).where("score is not null and not isnan(score)")
    else:
        scored = nearest(queries, vectors, k, same, per, carry, block or BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy("qid", *extra).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(queries: DataFrame, pool: DataFrame, block: int | None = None) -> DataFrame:
    """``qid, pos, id, score, rank`` of every row of ``pool (pos, id, vector)`` for each of ``queries (qid, q)``: by
    similarity, rows without a vector behind in the pool's order."""
    scored = _met(queries, pool, block).select("qid", "pos", "id", F.round(dot(F.col("q"), F.col("vector")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "pos"))
    return scored.withColumn("rank", rank)


def postings(chunks: DataFrame) -> DataFrame:
    """``term, id, tf`` of ``chunks (id, text)``, the inverted index."""
    flat = chunks.select("id", fold(F.col("text")).alias("flat"))
    terms = flat.select("id", F.explode(F.split("flat", _NO_TERM)).alias("term")).where("term <> ''")
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


_NO_TERM = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """The terms of the inverted index in a text: folded runs of letters and digits."""
    return F.array_remove(F.split(fold(text), _NO_TERM), "")


def lengths(index: DataFrame) -> DataFrame:
    """``id, dl``: each document's number of terms."""
    return index.groupBy("id").agg(F.sum("tf").alias("dl"))


def bm25(index: DataFrame, terms: DataFrame, k: int, all_terms: bool = True, length: DataFrame | None = None) -> DataFrame:
    """``qid, id, score, rank`` for ``terms (qid, term)`` over ``index (term, id, tf)``; k1 1.2, b 0.75.

    ``length (id, dl)`` is worked out from the index unless it is given. Postings are cut to the asked terms before
    anything else, and only their documents' lengths are joined.
    """
    length = lengths(index) if length is None else length
    corpus = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = terms.distinct()
    hits = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    met = hits.join(df, "term").join(length, "id").join(F.broadcast(corpus)).join(asked, "term")  # the corpus is one row
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n_terms"))
    if all_terms:
        need = asked.groupBy("qid").agg(F.count("*").alias("need"))
        scored = scored.join(need, "qid").where("n_terms = need")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.select("qid", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def and_match(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``qid, id`` of the documents that hold all terms of a query."""
    asked = terms.distinct()
    need = asked.groupBy("qid").agg(F.count("*").alias("need"))
    hits = index.join(asked, "term").groupBy("qid", "id").agg(F.count("*").alias("n"))
    return hits.join(need, "qid").where("n = need").select("qid", "id")


def token_hits(rows: DataFrame, field: str, terms: DataFrame, term: str) -> DataFrame:
    """The rows of which the tokens of ``field`` hold all tokens of a term, with the columns of ``terms``, once for
    each term. Both sides are joined by token, so no row meets a term that shares none with it."""
    asked = terms.withColumn("__tokens", F.array_distinct(file_tokens(F.col(term)))).where(F.size("__tokens") > 0)
    asked = asked.select(*terms.columns, F.size("__tokens").alias("__need"), F.explode("__tokens").alias("__token"))
    own = rows.withColumn("__token", F.explode(F.array_distinct(file_tokens(F.col(field)))))
    met = own.join(asked, "__token")
    several = met.groupBy(*rows.columns, *terms.columns, "__need").agg(F.count("*").alias("__met")).where("__met = __need")
    return several.drop("__need", "__met")


def name_hits(chunks: DataFrame, asked: DataFrame, limit: int = 25, first: int = 8) -> DataFrame:
    """``path, page, kw_matches, score``: pages of files whose name has a keyword, counted for each chunk row.

    ``asked (kw, ord)``: the ``first`` ones count, and of each the ``limit`` rows first by id.
    """
    met = token_hits(chunks.select("path", "page", "filename", "point_id"), "filename", asked.where(F.col("ord") < first).select("kw"), "kw")
    place = F.row_number().over(Window.partitionBy("kw").orderBy("point_id"))
    counted = met.withColumn("place", place).where(F.col("place") <= limit).groupBy("path", "page").agg(F.count("*").alias("kw_matches"))
    return counted.withColumn("score", 1 + F.lit(0.1) * F.col("kw_matches")).orderBy(F.desc("kw_matches"), "path", "page").limit(limit)


def similar_names(chunks: DataFrame, terms: DataFrame, limit: int = 5) -> DataFrame:
    """``path`` of files whose name has a term of three or more characters, in order of the terms, once each."""
    met = token_hits(chunks.select("path", "filename", "point_id"), "filename", terms.where(F.length("term") >= 3).select("term", "ord"), "term")
    in_term = F.row_number().over(Window.partitionBy("term").orderBy("point_id"))
    met = met.withColumn("place", in_term).where(F.col("place") <= 3 * limit)
    firsts = met.groupBy("path").agg(F.min(F.struct("ord", "place")).alias("seen"))
    return firsts.orderBy("seen", "path").limit(limit).select("path", F.col("seen.ord").alias("ord"))


def scope_filter(folder: str | None = None, path_terms: tuple[str, ...] = (), folder_column: str = "carpeta_top", path_column: str = "path") -> Column | None:
    """Any of: the folder is the one named, the path has its tokens, the path has a term's tokens (terms of two or
    more characters). None where nothing is asked."""
    tokens = file_tokens(F.col(path_column))
    any_of = [F.col(folder_column) == folder, matches_all(tokens, file_tokens(F.lit(folder)))] if folder else []
    any_of += [matches_all(tokens, file_tokens(F.lit(t))) for t in path_terms if t and len(t) >= 2]
    out = None
    for clause in any_of:
        out = clause if out is None else out | clause
    return out


#: Weights of the channels.
WEIGHTS = {"semantic": 1.0, "filename": 1.5, "expte": 1.8}


def hybrid(query: DataFrame, chunks: DataFrame, limit: int = 20, folder: str | None = None, names: tuple[str, ...] = (), cases: tuple[str, ...] = ()) -> DataFrame:
    """Three channels in one list, ``qid, key, final, channel, rank``: nearest vectors, file names with one of
    ``names``, paths with one of ``cases``; each gives at most ``max(limit, 20)`` rows.

    ``query (qid, q)`` is one request, ``chunks`` has ``point_id, path, filename, carpeta_top, vector``. With a ``folder``
    the first two are restricted to its scope; a case number is looked for everywhere.
    """
    per = max(limit, 20)
    scope = scope_filter(folder)
    own = chunks if scope is None else chunks.where(scope)
    sem = top_k(query, own.select(F.col("point_id").alias("id"), "vector"), per)
    hits = sem.select("qid", F.col("id").alias("key"), F.lit("semantic").alias("channel"), F.lit(0).alias("channel_ord"), F.col("rank").alias("rank_in"), "score", F.lit(WEIGHTS["semantic"]).alias("weight"))
    order = 0
    for kind, field, rows, terms in (("filename", "filename", own, names), ("expte", "path", chunks, cases)):
        for term in terms:
            if len(term) < 2:
                continue
            order += 1
            met = rows.where(matches_all(file_tokens(F.col(field)), file_tokens(F.lit(term)))).select("point_id")
            first = met.orderBy("point_id").limit(per).withColumn("rank_in", F.row_number().over(Window.orderBy("point_id")))
            hits = hits.unionAll(first.join(F.broadcast(query.select("qid"))).select("qid", F.col("point_id").alias("key"), F.lit(f"{kind}:{term}").alias("channel"), F.lit(order).alias("channel_ord"), "rank_in", F.lit(1.0).alias("score"), F.lit(WEIGHTS[kind]).alias("weight")))
    return fuse_channels(hits)


#: What a keyword found in a hit adds to its score.
KEYWORD_BOOST = 0.08


def keyword_matches(asked: Column) -> Column:
    """How many of the keywords stand in a hit's ``filename`` and ``snippet``."""
    return F.size(F.filter(asked, lambda k: F.contains(F.lower(F.concat_ws(" ", "filename", "snippet")), k)))


def clamp_top_k(asked: Column, most: int = 10) -> Column:
    """The number of results asked for, between 1 and ``most``."""
    return F.greatest(F.lit(1), F.least(asked, F.lit(most)))


def pool_size(asked: Column, least: int = 20) -> Column:
    """How many candidates are fetched for so many results."""
    return F.greatest(asked, F.lit(least))


def with_variants(queries: DataFrame, variants: DataFrame, most: int = 3) -> DataFrame:
    """``qid, variant, text``: each of ``queries (qid, text)`` as variant 0, then the first ``most`` of its ``variants
    (qid, ord, text)`` that have 3 to 200 characters without bullets around them."""
    clean = F.trim(F.btrim("text", F.lit("-•* ")))
    usable = variants.join(queries.select("qid"), "qid", "left_semi").select("qid", "ord", clean.alias("text")).where(F.length("text").between(3, 200))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("ord"))
    more = usable.withColumn("variant", place).where(F.col("variant") <= most).select("qid", "variant", "text")
    return queries.select("qid", F.lit(0).alias("variant"), "text").unionAll(more)


def variant_keywords(variants: DataFrame) -> DataFrame:
    """``qid, keywords``: the keywords of all variants in order, each once."""
    rows = variants.select("qid", F.struct("variant", keywords(F.col("text")).alias("kws")).alias("v"))
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return lists.select("qid", F.array_distinct(F.flatten(F.transform("vs", lambda v: v["kws"]))).alias("keywords"))


def rerank_pairs(hits: DataFrame, scorer: Column | None, k: int) -> DataFrame:
    """``hits (qid, query, filename, snippet, rank, ...)`` by a score of query and hit text, ``rank`` and ``ce_score`` anew, at
    most ``k`` a query. ``scorer`` is a Column over ``query`` and ``hit_text``, such as one of ``pair_scorer``; without one
    the order stays."""
    text = F.substring(F.concat_ws(" ", F.coalesce("filename", F.lit("")), F.coalesce("snippet", F.lit(""))), 1, 2000)
    rows = hits.withColumn("hit_text", text)
    rows = rows.withColumn("ce_score", F.lit(None).cast("double") if scorer is None else scorer)
    new = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ce_score").desc_nulls_last(), "rank"))
    return rows.withColumn("rank", new).where(F.col("rank") <= k).drop("hit_text")


def fuse_channels(hits: DataFrame) -> DataFrame:
    """Weighted channels into one list: ``qid, key, final, channel, rank``.

    ``hits (qid, key, channel, channel_ord, rank_in, score, weight)``. A key keeps its best weighted score, the
    earlier channel on ties, and the place of its first appearance orders equal results.
    """
    final = F.round(F.col("score") * F.col("weight"), 6)
    rows = hits.select("qid", "key", "channel", final.alias("final"), (F.col("channel_ord") * 1_000_000 + F.col("rank_in")).alias("place"))
    best = F.min(F.struct((-F.col("final")).alias("minus"), "place", "channel")).alias("best")
    kept = rows.groupBy("qid", "key").agg(best, F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("best.minus", "first"))
    return kept.select("qid", "key", (-F.col("best.minus")).alias("final"), F.col("best.channel").alias("channel"), rank.alias("rank"))


def fuse_sources(hits: DataFrame) -> DataFrame:
    """One hit for each page: a name hit before any vector hit, else the higher score, else the earlier.

    ``hits (path, page, source, score, ordinal, kw_matches)``; ``first_ord`` is the first place of the page.
    """
    order = F.struct(F.when(F.col("source") == "filename", 0).otherwise(1).alias("kind"), (-F.col("score")).alias("minus"), "ordinal", "source", "score", "kw_matches")
    kept = hits.groupBy("path", "page").agg(F.min(order).alias("b"), F.min("ordinal").alias("first_ord"))
    return kept.select("path", "page", "b.source", "b.score", "b.kw_matches", "first_ord")


def slots(fused: DataFrame, k: int = 10, pool: int = 30) -> DataFrame:
    """At most ``max(3, k // 2)`` name hits, then vector hits to fill up: ``path, page, source, slot``."""
    by_name = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("kw_matches"), F.desc("score"), "first_ord"))
    by_score = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "first_ord"))
    names = fused.where("source = 'filename'").withColumn("place", by_name).where(F.col("place") <= min(k, max(3, k // 2)))
    others = fused.where("source <> 'filename'").withColumn("place", by_score).where(F.col("place") <= pool)
    taken = names.agg(F.count("*").alias("n"))
    rest = others.join(F.broadcast(taken)).where(F.col("place") <= k - F.col("n")).select("path", "page", "source", (F.col("place") + F.col("n")).cast("int").alias("slot"))
    return names.select("path", "page", "source", F.col("place").alias("slot")).unionAll(rest)


def case_first(hits: DataFrame, by: str = "qid") -> DataFrame:
    """``hits (qid, filename, rank)`` with those named like a case file in front, each part in its order."""
    flag = is_case_file(F.col("filename"))
    return hits.select("*", flag.alias("case_file"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc(flag), "rank")).alias("new_rank"))


def context(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """``hid, context``: text of the pages around each of ``hits (hid, path, page)``, the hit's own marked. A hit with no
    path or page, or around which nothing is found, has its own ``snippet`` if the hits have that column; so have all
    at a ``radius`` under 1."""
    if "snippet" in hits.columns:
        own = hits.select("hid", F.coalesce("snippet", F.lit("")).alias("snippet"))
        if radius < 1:
            return own.select("hid", F.col("snippet").alias("context"))
        around = context(hits.drop("snippet"), chunks, radius)
        return own.join(around, "hid", "left").select("hid", F.coalesce("context", "snippet").alias("context"))
    near = chunks.select(F.col("path").alias("c_path"), F.col("page").alias("c_page"), "chunk_idx", F.trim("snippet").alias("snippet")).where("snippet <> ''")
    met = hits.join(near, (F.col("path") == F.col("c_path")) & F.col("c_page").between(F.col("page") - radius, F.col("page") + radius))
    pages = met.groupBy("hid", "page", "c_page").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "snippet"))).alias("s"))
    joined = F.substring(F.array_join(F.transform("s", lambda x: x["snippet"]), " "), 1, CONTEXT_CHARS)
    mark = F.when(F.col("c_page") == F.col("page"), " [PAG ACTUAL]").otherwise("")
    block = F.concat(F.lit("--- Pag. "), F.col("c_page").cast("string"), mark, F.lit(" ---\n"), joined)
    return pages.groupBy("hid").agg(F.sort_array(F.collect_list(F.struct("c_page", block.alias("b")))).alias("p")).select("hid", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))


def result_lines(hits: DataFrame) -> DataFrame:
    """``qid, rank, line`` of ``hits (qid, rank, filename, page, channel, snippet, path)``: a numbered line with what was
    found and the path below it. Page 0 is a preview; the channel is named unless it is the vectors'."""
    place = F.when(F.coalesce("page", F.lit(0)) == 0, " (preview)").otherwise(F.concat(F.lit(" (pag. "), F.col("page").cast("string"), F.lit(")")))
    channel = F.when(F.coalesce("channel", F.lit("semantic")) == "semantic", "").otherwise(F.concat(F.lit(" ["), "channel", F.lit("]")))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("?")), place, channel)
    line = F.concat(head, F.lit(" - "), F.substring(F.coalesce("snippet", F.lit("")), 1, 300), F.lit("\n    path: "), F.coalesce("path", F.lit("?")))
    return hits.select("qid", "rank", line.alias("line"))


def context_block(hits: DataFrame, title: str = "## CONTEXTO") -> DataFrame:
    """``qid, block``: the hits of a query (``qid, rank, filename, page, path, score, context``) as one text with a title,
    each under its number, name, page, score and path."""
    score = F.format_number("score", 2)
    one = F.concat(F.lit("\n### ["), F.col("rank").cast("string"), F.lit("] "), "filename", F.lit(" — pag. "), F.col("page").cast("string"), F.lit(" (score "), score, F.lit(")\n_Ruta: "), "path", F.lit("_\n\n"), "context", F.lit("\n"))
    rows = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("one")))).alias("rows"))
    return rows.select("qid", F.concat_ws("\n", F.lit(f"{title}\n"), F.array_join(F.transform("rows", lambda r: r["one"]), "\n"), F.lit("\n---\n")).alias("block"))


def citations(answers: DataFrame, files: DataFrame) -> DataFrame:
    """``aid, filename, page, valid`` of each citation of ``answers (aid, answer)`` against ``files (aid, filename)``."""
    names = F.regexp_extract_all("answer", F.lit("(?iu)" + CITATION), 1)
    pages = F.regexp_extract_all("answer", F.lit("(?iu)" + CITATION), 2)
    found = answers.select("aid", F.posexplode(F.arrays_zip(names.alias("f"), pages.alias("p"))).alias("at", "c")).select("aid", "at", F.trim("c.f").alias("filename"), F.col("c.p").cast("int").alias("page"))
    known = files.select(F.col("aid").alias("k_aid"), F.lower("filename").alias("k_name")).distinct()
    met = found.join(known, (F.col("aid") == F.col("k_aid")) & (F.lower("filename") == F.col("k_name")), "left")
    return met.select("aid", "at", "filename", "page", F.col("k_name").isNotNull().alias("valid"))


def citation_matches(cited: Column, paths: Column) -> Column:
    """Tolerant match: normalised names equal or one holds the other; an empty name matches nothing."""
    c = normalize(cited)
    base = lambda p: normalize(F.substring_index(p, "/", -1))
    return (c != "") & F.exists(paths, lambda p: F.contains(base(p), c) | F.contains(c, base(p)))


def excerpt(text: Column, term: Column, width: int = 20, lead: int = 5) -> Column:
    """At most ``width`` words of the text from ``lead`` before the first word that is ``term``, which is marked;
    dots stand where words are left out. Null if no word is the term."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    at = F.array_position(bare, term)
    first = F.greatest(F.lit(1), at.cast("int") - lead)
    shown = F.transform(F.slice(words, first, F.lit(width)), lambda w, i: F.when(F.get(bare, first + i - 1) == term, F.concat(F.lit("<<"), w, F.lit(">>"))).otherwise(w))
    body = F.concat(F.when(first > 1, "... ").otherwise(""), F.array_join(shown, " "), F.when(first + width <= F.size(words), " ...").otherwise(""))
    return F.when(at > 0, body)
