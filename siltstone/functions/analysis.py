"""Query analysis: case numbers, names, intent, negations, folders; context carried along a conversation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import normalize, strings

#: Fixed values.
CASE_PREFIX = r"(?:N[°º]?\.?|Expte\.?|Expediente|FMZ|CUIJ|CUIT)"
CAPS_STOP = ["ANTE", "ESTE", "PARA", "CADA", "COMO", "PERO", "OTRO", "OTRA", "SOBRE", "DESDE", "HASTA", "ENTRE", "MISMO", "TODOS", "TODAS", "PDF", "DOCX", "DOC", "TXT", "SRT", "ART", "LRT"]
CASE_WORDS = ["caso", "casos", "expediente", "expedientes", "demanda", "demandas", "juicio", "juicios", "causa", "causas", "autos", "carátula", "caratula", "contestacion", "contestación", "escrito", "escritos"]
CONCEPT_WORDS = ["qué es", "que es", "definicion", "definición", "cómo", "como se", "que dice", "qué dice", "cual es", "cuál es", "explicame", "regla", "clausula", "cláusula", "articulo", "artículo"]
FOLLOW_WORDS = ["el segundo", "la segunda", "el tercero", "la tercera", "el siguiente", "el proximo", "el próximo", "otro", "otra", "ampliá", "amplia", "detalle", "detallá", "detalla", "más de eso", "mas de eso", "de ese", "de esa", "de ese caso", "sobre ese", "y en ese", "seguí", "segui", "continuá", "continua"]
DRAFT_VERBS = ["redacta", "redactar", "redactame", "hace", "hacé", "haceme", "escribi", "escribir", "escribime", "genera", "generar", "generame", "arma", "armar", "armame", "prepara", "preparar", "preparame", "borrador", "modelo"]
DRAFT_KINDS = ["demanda", "contestacion", "contestación", "cedula", "cédula", "oficio", "alegato", "apelacion", "apelación", "memorial", "escrito", "carta documento", "notificacion", "notificación", "recurso", "peticion", "petición", "reconvencion", "reconvención", "excepcion", "excepción", "denuncia"]
NEGATION = r"(?:yo\s+)?no\s+(?:dije|quise\s+decir|pregunt[eé]|habl[eé])\s+(?:de\s+|sobre\s+)?([\p{L}\p{N}_\s]{3,30}?)(?:\s*[,.;\n!?]|$)"
FOLDER_STOP = "y|para|con|el|la|los|las|un|una|de|del|al|a|en|dame|dime|buscame|buscá|busca|traeme|trae|traé|traéme|pasame|pasá|pasa|muestrame|mostrá|mostra|listame|listá|listar|redactame|redactá|quiero|necesito|quisiera|podrías|podrias|ayudame|ayudá|dice|dicen|hay|tiene|tienen|hace|hacé"
FOLDER_PHRASE = r"(?:en\s+(?:la\s+)?carpeta|dentro\s+de(?:\s+la\s+carpeta)?|de\s+la\s+carpeta|carpeta\s+de|carpeta|en\s+documentos|de\s+documentos)\s+([\p{L}][\p{L}\p{N}_\s]{2,40}?)(?:\s*[,.;?!\n]|\s+(?:" + FOLDER_STOP + r")(?![\p{L}\p{N}_])|$)"
CASE_FILE = r"(?:N[°º]?\.?\s*\d|Expte|Exp\.|FMZ|\d{5,})|(?:(?<![\p{L}\p{N}_])c/(?=[\p{L}\p{N}_]))|(?:(?<![\p{L}\p{N}_])vs?(?![\p{L}\p{N}_]))"
CITATION = r"\(([^,()]*(?:\([^)]*\))?[^,()]*\.(?:pdf|docx|doc|txt))[,\s]+p[aá]g\.?\s*(\d+)\)"

_LEFT = r"(?<![\p{L}\p{N}_])"


def _any(text: Column, phrases: list[str]) -> Column:
    return F.exists(strings(phrases), lambda p: F.contains(text, p))


def case_numbers(text: Column, compat: bool = False) -> Column:
    """Prefixed numbers, then bare runs of five or more digits that none of them holds; distinct, in order.

    By default a prefix starts at a word's beginning and the value has a digit; ``compat`` takes any run of four.
    """
    pattern = rf"(?i)(?:{'' if compat else _LEFT}{CASE_PREFIX}\s*)([\p{{L}}\p{{N}}_/.-]{{4,}})"
    named = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.rtrim(x, F.lit(".,;")))
    named = F.array_distinct(F.filter(named, lambda x: (x != "") if compat else x.rlike(r"\d")))
    bare = F.regexp_extract_all(text, F.lit(_LEFT + r"(\d{5,})(?![\p{L}\p{N}_])"), 1)
    add = lambda out, x: F.when(F.exists(out, lambda e: F.contains(e, x) | F.contains(x, e)), out).otherwise(F.array_append(out, x))
    return F.aggregate(bare, named, add)


def caps_names(text: Column) -> Column:
    """Words of four or more capitals, without the stop words; distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(_LEFT + r"([A-ZÁÉÍÓÚÑ]{4,})(?![\p{L}\p{N}_])"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(CAPS_STOP)))


def intent(text: Column) -> Column:
    t = normalize(text)
    case, concept = _any(t, CASE_WORDS), _any(t, CONCEPT_WORDS)
    return F.when(case & ~concept, "caso").when(concept & ~case, "concepto").otherwise("mixto")


def follow_up(text: Column) -> Column:
    return _any(normalize(text), FOLLOW_WORDS)


def wants_draft(text: Column) -> Column:
    low = F.lower(text)
    return _any(low, DRAFT_VERBS) & _any(low, DRAFT_KINDS)


def negations(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?iuU)" + NEGATION), 1)
    return F.filter(F.transform(found, lambda x: F.rtrim(F.trim(x), F.lit(",.;"))), lambda x: x != "")


def folder_phrase(text: Column) -> Column:
    """The folder that the text names; null if it names none."""
    return F.nullif(F.rtrim(F.trim(F.regexp_extract(text, "(?iuU)" + FOLDER_PHRASE, 1)), F.lit(",.;")), F.lit(""))


def semantic_text(text: Column, numbers: Column) -> Column:
    """The text without the folder phrase and the case numbers; the text itself if nothing is left."""
    bare = F.regexp_replace(text, "(?iuU)" + FOLDER_PHRASE, " ")
    for_number = lambda out, n: F.regexp_replace(out, F.concat(F.lit(_LEFT + r"\Q"), n, F.lit(r"\E(?![\p{L}\p{N}_])")), F.lit(" "))
    bare = F.trim(F.regexp_replace(F.aggregate(numbers, bare, for_number), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(bare, F.lit("")), text)


def is_case_file(filename: Column) -> Column:
    return F.coalesce(filename, F.lit("")).rlike("(?iu)" + CASE_FILE)


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    last = F.length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _holding(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """Rows of both where the text ``part`` stands in the text ``whole``. They meet by the first three characters of
    the part, or all that it has, so that no row meets all others."""
    size = F.least(F.lit(3), F.length(part))
    own = parts.where(F.length(part) > 0).withColumn("__gram", F.substring(F.col(part), F.lit(1), size))
    other = wholes.withColumn("__key", F.explode(F.array_distinct(F.concat(*(_grams(F.col(whole), n) for n in (1, 2, 3))))))
    return own.join(other, F.col("__gram") == F.col("__key")).where(F.contains(F.col(whole), F.col(part))).drop("__gram", "__key")


#: Folders up to which the similarity ratio is worked out for each request that nothing else resolves.
MAX_FOLDERS = 100_000


def match_folder(asked: DataFrame, folders: DataFrame) -> DataFrame:
    """``qid, raw, folder, level`` for ``asked (qid, raw)`` against ``folders (folder)``.

    Rules in order, the shortest folder first within one: 1 equal, 2 either holds the other, 3 a word of the
    request is a word of the folder, 4 is part of it, 5 similar by ratio 0.6 or more, else 6 the request itself.
    Rules 1 to 4 are joins by text, token or three characters; the ratio is left for requests that none of them
    resolves, and refused for over ``MAX_FOLDERS`` folders.
    """
    f = folders.select("folder", normalize(F.col("folder")).alias("fn")).distinct()
    a = asked.select("qid", normalize(F.col("raw")).alias("rn")).where("rn <> ''")
    rank = lambda level, at, by: F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"), by.cast("double").alias("by"), F.col("folder").alias("folder"))
    zero, size = F.lit(0), F.length("folder")
    found = a.join(f, F.col("rn") == F.col("fn")).select("qid", rank(1, zero, size).alias("r"))
    for part, whole in (("rn", "fn"), ("fn", "rn")):
        rows = _holding(a, f, part, whole) if part == "rn" else _holding(f, a, part, whole)
        found = found.unionAll(rows.select("qid", rank(2, zero, size).alias("r")))
    tokens = a.select("qid", F.posexplode(F.split("rn", " ")).alias("at", "token")).where(F.length("token") >= 3)
    words = f.select("folder", F.explode(F.split("fn", " ")).alias("word"))
    found = found.unionAll(tokens.join(words, F.col("token") == F.col("word")).select("qid", rank(3, F.col("at"), size).alias("r")))
    found = found.unionAll(_holding(tokens, f, "token", "fn").select("qid", rank(4, F.col("at"), size).alias("r")))
    best = found.groupBy("qid").agg(F.min("r").alias("b"))

    @F.pandas_udf("double")
    def ratio(rn: pd.Series, fn: pd.Series) -> pd.Series:
        best = lambda r, c: max((difflib.SequenceMatcher(None, r, x).ratio() for x in [c, *c.split()]), default=0.0)
        return pd.Series([best(r, c) for r, c in zip(rn, fn, strict=True)])

    open_ones = a.join(best.select(F.col("qid").alias("done")), F.col("qid") == F.col("done"), "left_anti")
    few = f.limit(MAX_FOLDERS + 1).count() <= MAX_FOLDERS
    if not few and not open_ones.isEmpty():
        raise ValueError(f"more than {MAX_FOLDERS} folders to compare with each request")
    similar = open_ones.join(F.broadcast(f) if few else f).select("qid", "folder", ratio("rn", "fn").alias("ratio")).where("ratio >= 0.6")
    similar = similar.groupBy("qid").agg(F.min(rank(5, zero, -F.col("ratio"))).alias("b"))
    return asked.join(best.unionAll(similar), "qid", "left").select("qid", "raw", F.coalesce("b.folder", "raw").alias("folder"), F.coalesce("b.level", F.lit(6)).alias("level"))


def named_folder(texts: DataFrame, folders: DataFrame) -> DataFrame:
    """``qid, folder`` of ``texts (qid, t)`` in which a known folder of three or more characters stands as whole words;
    the longest, then the first by name. They meet by the folder's first word."""
    f = folders.select("folder", normalize(F.col("folder")).alias("fn")).where(F.length("fn") >= 3).distinct()
    first = lambda text: F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    f = f.withColumn("key", F.get(first(F.col("fn")), F.lit(0)))
    t = texts.select("qid", normalize(F.col("t")).alias("tn")).withColumn("word", F.explode(F.array_distinct(first(F.col("tn")))))
    whole = F.regexp_like("tn", F.concat(F.lit(_LEFT + r"\Q"), F.col("fn"), F.lit(r"\E(?![\p{L}\p{N}_])")))
    met = t.join(f, F.col("word") == F.col("key")).where(whole)
    return met.groupBy("qid").agg(F.min(F.struct((-F.length("folder")).alias("minus"), "folder")).alias("b")).select("qid", F.col("b.folder").alias("folder"))


def find_folder(texts: DataFrame, folders: DataFrame) -> DataFrame:
    """``qid, folder`` of ``texts (qid, t)``: the folder that a phrase names, resolved against the known ones, else a known one
    that the text has; null if neither."""
    phrase = texts.select("qid", "t", folder_phrase(F.col("t")).alias("raw"))
    resolved = match_folder(phrase.where("raw is not null").select("qid", "raw"), folders).select("qid", "folder")
    named = named_folder(phrase.where("raw is null").select("qid", "t"), folders)
    return texts.select("qid").join(resolved.unionAll(named), "qid", "left")


def analyze_queries(turns: DataFrame, folders: DataFrame) -> DataFrame:
    """Everything that is read off each of ``turns (conv, turn, text)``, with what earlier turns of its conversation hand on:
    ``conv, turn, text, text_semantic, carpeta, expedientes, nombres, intent, follow_up, negations``.

    Blank texts ask nothing: they have empty fields, neither take nor hand on anything, and the context passes them by.
    """
    rows = turns.select("conv", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("t")).withColumn("qid", F.struct("conv", "turn"))
    asked = rows.where("t <> ''")
    t = F.col("t")
    own = asked.select("qid", "conv", "turn", "t", case_numbers(t).alias("expedientes"), caps_names(t).alias("nombres"), negations(t).alias("negated"))
    own = own.join(find_folder(asked.select("qid", "t"), folders).withColumnRenamed("folder", "carpeta"), "qid")
    carried = fold_context(own.select("conv", "turn", "carpeta", "expedientes", "nombres", "negated"))
    out = own.select("conv", "turn", "t", F.col("negated").alias("negations")).join(carried, ["conv", "turn"])
    out = out.select("conv", "turn", t.alias("text"), semantic_text(t, F.col("expedientes")).alias("text_semantic"), "carpeta", "expedientes", "nombres", intent(t).alias("intent"), follow_up(t).alias("follow_up"), "negations")
    none = F.array().cast("array<string>")
    blank = rows.where("t = ''").select("conv", "turn", t.alias("text"), t.alias("text_semantic"), F.lit(None).cast("string").alias("carpeta"), none.alias("expedientes"), none.alias("nombres"), F.lit("mixto").alias("intent"), F.lit(False).alias("follow_up"), none.alias("negations"))
    return out.unionAll(blank)


def fold_context(turns: DataFrame) -> DataFrame:
    """Context after each turn of a conversation: ``conv, turn, carpeta, expedientes, nombres``.

    Input ``conv, turn, carpeta, expedientes, nombres, negated``. A turn takes from the one before what it lacks;
    then values that a negation names (either holds the other, normalised) go, its own included.
    """
    item = F.struct("turn", "carpeta", "expedientes", "nombres", F.transform("negated", normalize).alias("negated"))
    rows = turns.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    kind = "struct<turn:bigint,carpeta:string,expedientes:array<string>,nombres:array<string>>"

    def hit(value: Column, negated: Column) -> Column:
        return F.exists(negated, lambda n: F.contains(normalize(value), n) | F.contains(n, normalize(value)))

    def step(done: Column, row: Column) -> Column:
        last, first = F.get(done, F.size(done) - 1), F.size(done) == 0
        drop = lambda xs: F.when(first, xs).otherwise(F.filter(xs, lambda x: ~hit(x, row["negated"])))
        folder = F.coalesce(row["carpeta"], last["carpeta"])
        numbers = F.when((F.size(row["expedientes"]) > 0) | first, row["expedientes"]).otherwise(last["expedientes"])
        names = F.when((F.size(row["nombres"]) > 0) | first, row["nombres"]).otherwise(last["nombres"])
        folder = F.when(~first & F.coalesce(hit(folder, row["negated"]), F.lit(False)), F.lit(None)).otherwise(folder)
        new = F.struct(row["turn"].cast("long").alias("turn"), folder.alias("carpeta"), drop(numbers).alias("expedientes"), drop(names).alias("nombres"))
        return F.concat(done, F.array(new.cast(kind)))

    done = F.aggregate("rows", F.array().cast(f"array<{kind}>"), step)
    return rows.select("conv", F.explode(done).alias("c")).select("conv", "c.*")
