"""Schemas and constants of the document-retrieval tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
POINT_NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
WORDS_PER_CHUNK = 500
SNIPPET_STORED = 800
PREVIEW_CHARS = 750
CONTEXT_CHARS = 1800
SUPPORTED_EXT = [".pdf", ".docx", ".doc", ".txt"]
EXCLUDED_PATHS = ["publico.zip", "#recycle/", "#snapshot/", "@eadir/", ".ds_store", "thumbs.db"]
LOCK_PREFIX = "~$"

CHUNKS = T.StructType(
    [
        T.StructField("point_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("carpeta_top", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
    ]
)

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("n_chunks", T.IntegerType()),
        T.StructField("indexed_at", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("preview", T.StringType()),
        T.StructField("fully_extracted", T.BooleanType()),
    ]
)
