"""Corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes what a stage returns as
Parquet in the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, read_table
from siltstone.llm.decontamination import find_overlaps
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.packing import pack
from siltstone.llm.settings import TOXIC_FROM, tokenizer_file
from siltstone.llm.simhash import near_duplicates
from siltstone.llm.toxicity import learn_from, toxicity


#: Ids up to which the documents that go are broadcast; beyond, both sides are shuffled by id.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without those of the ids in ``gone``; documents without an id stay. The ids are written, so that they are
    counted and joined as they are."""
    ids = Scratch(docs.sparkSession, "gone").keep(gone.select(F.col("doc_id").alias("__gone_id")).where("__gone_id is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["__gone_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score as toxic go.

    Labels of documents that are still there are learned from; without any, or of one kind only, nothing goes. Null,
    empty and blank texts score as texts without a hit; repeated rows go or stay together; a text of any length is
    scored whole; an empty table stays one. Other columns, whatever their names, pass through.
    """
    lexicon = learn_from(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity(docs, lexicon) < TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go, and documents that had words and have none left; ``n_chars`` follows.

    Null, empty and blank texts lose nothing and stay. Of equal texts under several ids the least id keeps its lines and
    the others are emptied and go; rows equal in id and text are one document and share its fate. Ties go by id, hash
    of the text and place. A text of any length is cut whole; an empty table stays one. Columns named ``n_lines`` or
    ``n_removed`` pass through like all others.
    """
    named = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(named))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in named.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents the one with the least id stays.

    Texts without words (null, empty, blank) have the same fingerprint, so one of them stays. Rows that share an id
    stay or go together, and those without an id stay. A text of any length is hashed whole; an empty table stays
    one. Other columns, whatever their names, pass through.
    """
    return _without(docs, near_duplicates(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that overlap with an item of the benchmark go.

    Null, empty and blank texts overlap with nothing. Rows that share an id go together; of those without an id each
    that overlaps would need one to be told, so they stay. A text of any length is compared whole; an empty table, of
    documents or of items, changes nothing. Other columns, whatever their names, pass through.
    """
    return _without(docs, find_overlaps(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what is left, as pieces of packed sequences with their token ids.

    Null and empty texts are one token, the end of a document. Rows that share an id are packed each. A text of any
    length is tokenised whole and cut into as many pieces as it needs; an empty table gives no pieces.
    """
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, MinHash and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each stage's table is deleted when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
