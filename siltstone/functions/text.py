"""Text expressions: normalising, tokens, chunks, keys and the character encoder. All run inside the JVM."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.schema import POINT_NAMESPACE, PREVIEW_CHARS, WORDS_PER_CHUNK



def _single_folds() -> tuple[str, str]:
    """Lower-case letters of the Latin, full-width and superscript ranges whose compatibility form, without marks, is
    one other character."""
    ranges = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F), range(0x2070, 0x20A0))
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for r in ranges for c in r}
    kept = {c: x for c, x in plain.items() if x != c and len(x) == 1 and c == c.lower()}
    return "".join(kept), "".join(kept.values()).lower()


_MARKED, _PLAIN = _single_folds()
#: Ligatures.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}

#: Fixed values.
KEYWORD_STOP = [
    "de", "la", "el", "los", "las", "un", "una", "que", "en", "por", "para", "con", "sin", "revisa", "revisar",
    "buscar", "busca", "buscá", "dame", "dime", "quiero", "necesito", "saber", "informacion", "informar", "archivo",
    "archivos", "documento", "documentos", "algo", "sobre", "del", "al", "es", "son", "hay", "favor", "dice", "este",
    "esta", "estas", "estos", "como", "cuando", "donde", "cual", "cuales", "hacer", "haces", "cita", "citar",
    "transcribir", "copiar", "texto", "dato", "datos",
]
TRIVIAL = ["hola", "buenas", "buen dia", "buenos dias", "buenas tardes", "buenas noches", "gracias", "muchas gracias", "chau", "adios", "ok", "listo", "perfecto", "genial", "dale", "si", "no", "ola"]


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def fold(text: Column) -> Column:
    """Lower case, compatibility forms and accents of Latin letters undone, whether composed or not."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN)
    odd = flat.rlike(r"[\p{M}\x{FB00}-\x{FB06}]")
    bare = F.regexp_replace(flat, r"\p{M}+", "")
    for sign, letters in _LIGATURES.items():
        bare = F.replace(bare, F.lit(sign), F.lit(letters))
    return F.when(odd, bare).otherwise(flat)


def normalize(text: Column) -> Column:
    """``fold`` with white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def sanitize(text: Column) -> Column:
    """The letter and digit runs of two or more, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]{2,})"), 1), " ")


def keywords(text: Column) -> Column:
    """Words without outer punctuation, lower case, of two or more characters, no stop words, not all digits."""
    bare = F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(".,;:¿?¡!\"'()"))))
    return F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(KEYWORD_STOP) & ~w.rlike(r"^\d+$"))


def file_tokens(text: Column) -> Column:
    """Tokens of the full-text index on names: lower case, 2 to 30 letters or digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: F.length(t).between(2, 30))


def matches_all(tokens: Column, query: Column) -> Column:
    """Token match: every token of the query is a token of the field, and there is one."""
    return (F.size(query) > 0) & F.forall(query, lambda t: F.array_contains(tokens, t))


def folder_top(path: Column, root: str = "") -> Column:
    """First segment of a path below ``root``; a file at the root is its own folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        p = F.when(p.startswith(f"{root}/"), F.substring(p, len(root) + 2, 1 << 30)).otherwise(p)
    return F.substring_index(F.ltrim(p, F.lit("/")), "/", 1)


def virtual_path(relative: Column, root: str) -> Column:
    return F.concat(F.lit(f"{root}/"), F.replace(relative, F.lit("\\"), F.lit("/")))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def point_id(path: Column, page: Column, chunk_idx: Column) -> Column:
    """Name-based UUID (version 5) of ``path|page|chunk_idx``."""
    name = F.concat_ws("|", path, page.cast("string"), chunk_idx.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab" * 4), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def word_slices(words: Column, size: int = WORDS_PER_CHUNK) -> Column:
    """``array<string>`` of chunks of ``size`` words, joined by single spaces; no words, no chunks. ``words`` should be a
    column of its own: a lambda works out anew what it is given as an expression."""
    count = F.ceil(F.size(words) / size).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), lambda k: F.array_join(F.slice(words, k * size + 1, F.lit(size)), " "))


def word_chunks(text: Column, size: int = WORDS_PER_CHUNK) -> Column:
    """``word_slices`` of a text's words."""
    return word_slices(words(text), size)


def preview(text: Column) -> Column:
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, PREVIEW_CHARS)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_CODES = np.frombuffer(LETTERS.encode(), dtype=np.uint8)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _char_vector(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        counts = np.bincount(np.frombuffer((t or "").lower().encode(), dtype=np.uint8), minlength=256)[_CODES].astype(np.float64)
        norm = np.sqrt(counts @ counts)
        out.append(counts / norm if norm > 0 else counts)
    return pd.Series(out, dtype="object")


def with_char_vector(rows: DataFrame, text: Column, name: str = "vector") -> DataFrame:
    """``rows`` with the character vector of a text: how often each of 36 letters and digits stands in it, as a unit
    vector (zero for a text without any). One pass over Arrow batches: 36 built-in replacements of the same text took ten times
    as long."""
    return rows.withColumn(name, _char_vector(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def epoch_seconds(text: Column) -> Column:
    """ISO-8601 text to epoch seconds as a double; what does not parse is 0."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)) / F.lit(1000.0), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def is_trivial(text: Column) -> Column:
    """Greetings and the like: too short, in the list, or up to three words that are short or in the list."""
    q = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[?!.]+$", ""))
    w = words(q)
    short = F.forall(w, lambda x: x.isin(TRIVIAL) | (F.length(x) <= 3))
    return (F.length(q) <= 2) | q.isin(TRIVIAL) | ((F.size(w) <= 3) & short)


def line_class(line: Column) -> Column:
    """What a line of the light mark-up is: blank, heading1-3, bullet, number, title or text."""
    x = F.rtrim(line)
    title = (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 4)
    return (
        F.when(x == "", "blank")
        .when(x.rlike(r"^#{1,3}\s+.+$"), F.concat(F.lit("heading"), F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string")))
        .when(x.rlike(r"^[-*]\s+.+$"), "bullet")
        .when(x.rlike(r"^\d+[.)]\s+.+$"), "number")
        .when(title, "title")
        .otherwise("text")
    )


def content_text(parts: Column) -> Column:
    """The text parts of a multi-part message (``array<struct<type, text, ...>>``), a line each."""
    own = F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.array_join(F.transform(own, lambda p: p["text"]), "\n")


def forwarded_parts(parts: Column) -> Column:
    """What of a multi-part message (``array<struct<type, text, image_url: struct<url, detail>>>``) is passed on: text
    parts with a text, and image parts with a valid address, whose detail is kept if it is auto, low or high."""
    none = F.lit(None).cast("string")
    is_text = lambda p: (p["type"] == "text") & p["text"].isNotNull()
    is_image = lambda p: (p["type"] == "image_url") & valid_image_url(p["image_url"]["url"])

    def safe(p: Column) -> Column:
        image = ~is_text(p)
        detail = F.when(image & p["image_url"]["detail"].isin("auto", "low", "high"), p["image_url"]["detail"])
        return F.struct(p["type"].alias("type"), F.when(image, none).otherwise(p["text"]).alias("text"), F.when(image, p["image_url"]["url"]).alias("url"), detail.alias("detail"))

    return F.transform(F.filter(parts, lambda p: F.coalesce(is_text(p) | is_image(p), F.lit(False))), safe)


def valid_image_url(url: Column) -> Column:
    """A web address with a host, or a base64 data URL whose first bytes are of the image type that it names."""
    web = F.lower(url).rlike(r"^https?://") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "")
    shape = r"(?i)^data:image/(avif|gif|jpe?g|png|webp);base64,([A-Za-z0-9+/]+={0,2})$"
    kind = F.lower(F.regexp_extract(url, shape, 1))
    head = F.hex(F.try_to_binary(F.regexp_extract(url, shape, 2), F.lit("base64")))
    box, brand = F.substring(head, 9, 8), F.substring(head, 17, 8)
    image = (
        F.when(kind == "png", head.startswith("89504E470D0A1A0A"))
        .when(kind.isin("jpg", "jpeg"), head.startswith("FFD8FF"))
        .when(kind == "gif", head.startswith("474946383761") | head.startswith("474946383961"))
        .when(kind == "webp", head.startswith("52494646") & (brand == "57454250"))
        .when(kind == "avif", (box == "66747970") & brand.isin("61766966", "61766973"))
    )
    return F.coalesce(web, F.lit(False)) | F.coalesce(image, F.lit(False))
