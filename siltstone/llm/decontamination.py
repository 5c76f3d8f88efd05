"""Operator 9: benchmark decontamination by spaced seeds, in DataFrame expressions only.

A seed hashes the tokens at the fixed positions of a mask and ignores those between. The two masks are such that
13 aligned tokens with any two of them replaced still share a seed. A hit fixes an alignment of document and
item, along which the whole item is compared; the best 13 tokens decide. Shorter items are also looked for by runs
of their tokens: as many disjoint ones as there can be replaced tokens, and one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

#: Positions that a mask looks at. Every pair of replaced tokens among 13 leaves a hit of one of them.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 5, 6, 7))
_SPAN = 9
_WINDOW = 13


def _tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _seeds(tokens: str) -> Column:
    """Hash of each mask at each position; the hash at index i belongs to position i div (number of masks)."""
    at = lambda x, i, mask: F.xxhash64(F.lit(MASKS.index(mask)), x, *(F.get(tokens, i + k) for k in mask[1:]))
    each = F.transform(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - (_SPAN - 1))), lambda x, i: F.array(*(at(x, i, m) for m in MASKS)))
    return F.flatten(each)


def _runs(tokens: str, length: int) -> Column:
    """Hash of the ``length`` tokens at each position."""
    places = F.transform(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - (length - 1))), lambda x, i: i)
    return F.transform(places, lambda i: F.xxhash64(F.lit(-length), F.slice(tokens, i + 1, F.lit(length))))


def _disjoint(size: Column) -> Column:
    """Begin and length of the runs of an item under the window: at 0.8 two of 9 tokens or more can be replaced, one
    of 5 to 8, none of fewer."""
    run = lambda begin, length: F.struct(begin.cast("int").alias("begin"), length.cast("int").alias("length"))
    half = F.floor(size / 2)
    three = [run(F.lit(3 * k), F.lit(3)) for k in range(3)]
    return F.when(size >= 9, F.array(*three)).when(size >= 5, F.array(run(F.lit(0), half), run(half, size - half))).otherwise(F.array(run(F.lit(0), size)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """``doc_id, item_id, matched, item_tokens, overlap`` of each document and item that overlap.

    ``overlap`` is the largest share of equal tokens among 13 consecutive item tokens (all of an item that has
    fewer) against the document at one alignment, ``matched`` the largest number of equal tokens over the whole
    item; pairs of ``min_overlap`` (0.8 or more) or above are returned, none is missed, however short the item: one
    of a single token is found wherever that token stands. Null and empty texts match nothing. Repeated rows and ids merge into
    one pair; null ids are kept as null. A very long text is one row's work. Columns of other names are ignored; an
    empty table on either side gives no rows.

    Benchmark tokens are counted and up to ``broadcast_rows`` of them (two seeds of 24 bytes each) broadcast, so that
    documents' seeds are probed where they are made; beyond that both sides are shuffled by seed. The alignments found,
    one row for each however often a seed hits, go to the shared folder; the texts are read again and those that have one
    are compared, by a broadcast of the alignments up to ``broadcast_rows`` and by a shuffled join beyond.
    """
    if min_overlap < 0.8:
        raise ValueError("the seeds find overlaps of 0.8 or more")
    scratch = Scratch(docs.sparkSession, "overlaps")
    items = scratch.keep(benchmark.select(F.col(item_id).alias("item"), _tokens(F.col(item_text)).alias("own")).where(F.size("own") > 0))
    few = (items.agg(F.sum(F.size("own"))).first()[0] or 0) <= broadcast_rows
    # The outer form of explode: of the other Spark infers a filter that works the arrays out anew for each element.
    seeds = items.select("item", F.posexplode_outer(_seeds("own")).alias("seed_at", "seed")).where("seed is not null")
    seeds = seeds.select("seed", "item", F.expr(f"seed_at div {len(MASKS)}").cast("int").alias("item_at"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    placed = rows.select("doc", "text_hash", _tokens(F.col("body")).alias("tokens")).select("doc", "text_hash", _seeds("tokens").alias("seeds"))
    placed = placed.select("doc", "text_hash", F.posexplode_outer("seeds").alias("doc_at", "doc_seed"))
    hits = placed.join(F.broadcast(seeds) if few else seeds, F.col("doc_seed") == F.col("seed"))
    hits = hits.select("doc", "text_hash", "item", (F.expr(f"doc_at div {len(MASKS)}") - F.col("item_at")).cast("int").alias("shift"))
    brief = items.where(F.size("own") < _WINDOW).select("item", "own", F.explode(_disjoint(F.size("own"))).alias("run"))
    parts = scratch.keep(brief.select("item", F.col("run.begin").alias("item_at"), F.col("run.length").alias("length"), F.xxhash64(-F.col("run.length"), F.slice("own", F.col("run.begin") + 1, F.col("run.length"))).alias("seed")))
    for (length,) in sorted(parts.select("length").distinct().collect()):  # 1 to 4
        placed = rows.select("doc", "text_hash", _tokens(F.col("body")).alias("tokens")).select("doc", "text_hash", _runs("tokens", length).alias("runs"))
        placed = placed.select("doc", "text_hash", F.posexplode_outer("runs").alias("doc_at", "doc_seed"))
        own = parts.where(F.col("length") == length)
        found = placed.join(F.broadcast(own) if few else own, F.col("doc_seed") == F.col("seed"))
        hits = hits.unionAll(found.select("doc", "text_hash", "item", (F.col("doc_at") - F.col("item_at")).cast("int").alias("shift")))
    aligned = scratch.keep(hits.distinct()).withColumnsRenamed({"doc": "of", "text_hash": "of_hash", "item": "of_item"})
    here = F.broadcast(aligned) if aligned.count() <= broadcast_rows else aligned
    met = rows.join(here, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).select("doc", "of_item", "shift", _tokens(F.col("body")).alias("tokens"))
    own = F.broadcast(items) if few else items
    met = met.join(own, F.col("of_item").eqNullSafe(F.col("item"))).select("doc", "item", "shift", "tokens", "own")
    compared = F.transform("own", lambda x, j: F.when(F.get("tokens", j + F.col("shift")) == x, 1).otherwise(0))
    met = met.select("doc", "item", compared.alias("equal"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    met = met.select("doc", "item", total(F.col("equal")).alias("matched"), F.size("equal").alias("item_tokens"), F.least(F.lit(_WINDOW), F.size("equal")).alias("width"), "equal")
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("item_tokens") - F.col("width") + 1), lambda s: total(F.slice("equal", s, F.col("width")))))
    met = met.select("doc", "item", "matched", "item_tokens", (best / F.col("width")).alias("overlap")).where(F.col("overlap") >= min_overlap)
    return met.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("matched").cast("long").alias("matched"), F.max("item_tokens").cast("long").alias("item_tokens"), F.max("overlap").alias("overlap"))
