"""Operator 5: quality rules with cross-document line frequency, in DataFrame expressions only.

Each stage is a projection of its own, so that arrays which lambdas look into are worked out once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, words_of

_HAS_WORD = r"[^\x20\x09-\x0D]"
_WINDOW = 8


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(_HAS_WORD))


def base_features(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of each row.

    Windows of 8 words are hashed by doubling: pairs of neighbours, pairs of pairs, pairs of those. Only texts
    that repeat a window of 4 can repeat one of 8, so the others stop there.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    split = rows.select(*keep, words_of(t).alias("words"), _lines(t).alias("lines"), (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))
    grams = split.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("g"),
    )
    for step in (1, 2):
        grams = grams.select(*names, F.when(F.size("g") > step, F.transform("g", lambda x, i: F.xxhash64(x, F.get("g", i + step)))).alias("g"))  # noqa: B023
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    grams = grams.select(*names, F.when(repeats & (F.col("n_words") > _WINDOW), F.col("g")).alias("g"))
    grams = grams.select(*names, F.slice(F.transform("g", lambda x, i: F.xxhash64(x, F.get("g", i + 4))), F.lit(1), (F.col("n_words") - (_WINDOW - 1)).cast("int")).alias("g"))
    ordered = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    placed = grams.select(*names, F.when(F.size(F.array_distinct("g")) < F.size("g"), ordered).alias("ordered"))
    at = lambda j: F.get("ordered", j)["g"]
    twin = F.filter("ordered", lambda x, j: (x["g"] == F.coalesce(at(j - 1), F.bitwise_not(x["g"]))) | (x["g"] == F.coalesce(at(j + 1), F.bitwise_not(x["g"]))))
    found = placed.select(*names, F.sort_array(F.transform(twin, lambda x: x["i"])).alias("found"))
    own = F.transform("found", lambda p, j: F.least(F.lit(_WINDOW), F.coalesce(F.get("found", j + 1) - p, F.lit(_WINDOW))))
    covered = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 30, min_share: float = 0.001, max_removed: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base features, ``line_chars``, ``removed_chars``, ``kept``, and
    ``text`` without the removed lines.

    Lines are normalised (lower case, digit runs as 0, trimmed) and hashed. A line that more than ``min_docs``
    documents of its host have, and more than ``min_share`` of that host's documents, is removed, wherever it stands
    in a text; the other lines, blank ones included, stay as they are. A document that loses over ``max_removed`` of
    its line characters (of normalised lines) is depleted and rejected, as is one that fails the base rules, which
    look at the whole text. Null hosts are a host of their own, null texts stay null and are empty, and empty texts
    fail. A row is a document: repeated rows count and are returned each. An empty table gives no rows; a very long
    text is one row's work. Columns of other names are ignored.

    Texts are read once: they go with their features and line hashes to a table in the shared folder, and the rest
    reads that. A hot host or line only meets partial counts before the shuffle; the frequent lines are written before
    they are joined, so that adaptive execution broadcasts few of them by size and splits hot keys otherwise.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"))
    plain = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[0-9]+", "0"), "\n")
    rows = rows.withColumn("own_lines", F.transform(plain, lambda x: F.trim(x)))  # noqa: PLW0108  F.trim itself would be handed the place as what to trim
    key = ["row", "doc_id", "host", "text", "own_lines"]
    features = base_features(rows, "text", key)
    # Blank lines are nulls here, so that a line's index is its place in the text.
    hashed = F.transform("own_lines", lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))))
    each = scratch.keep(features.withColumn("own_lines", hashed))
    seen = each.select("host", F.explode(F.array_distinct(F.col("own_lines.h"))).alias("h")).where("h is not null")
    hosts = each.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(min_share)).alias("limit")).withColumnRenamed("host", "of")
    often = seen.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    often = often.join(hosts, F.col("host") == F.col("of")).where(F.col("n_docs") > F.col("limit")).select(F.col("host").alias("often_host"), F.col("h").alias("often_h"))
    often = scratch.keep(often)
    placed = each.select("row", "host", F.posexplode("own_lines").alias("at", "line"))
    hits = placed.join(often, (F.col("host") == F.col("often_host")) & (F.col("line.h") == F.col("often_h")), "left_semi")
    lost = hits.groupBy(F.col("row").alias("lost_row")).agg(F.sum("line.n").alias("lost"), F.collect_list("at").alias("gone"))
    total = F.aggregate(F.col("own_lines.n"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    out = each.select("row", "text", *(c for c in features.columns if c not in key), "doc_id", total.alias("line_chars"))
    out = out.join(lost, F.col("row") == F.col("lost_row"), "left").withColumn("removed_chars", F.coalesce("lost", F.lit(0)).cast("long"))
    out = out.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    depleted = F.col("removed_chars") > max_removed * F.col("line_chars")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed_chars", (~F.col("base_failed") & ~depleted).alias("kept"), left.alias("text"))
