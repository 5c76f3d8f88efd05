"""Conversations: token totals and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import token_estimate


def token_totals(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


def compact(turns: DataFrame, threshold: int, tail: int = 4) -> DataFrame:
    """Turns that stay: all of a conversation within ``threshold`` tokens or with no more than ``tail`` turns beside
    the system's; else the system's, the last ``tail``, and one summary (turn -1) that counts what it replaces."""
    other = F.col("role") != "system"
    per_conv = turns.groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count_if(other).alias("others"))
    back = F.row_number().over(Window.partitionBy("conv_id", other).orderBy(F.desc("turn")))
    long = (F.col("tokens") > threshold) & (F.col("others") > tail)
    rows = turns.withColumn("back", back).join(per_conv, "conv_id").withColumn("gone", long & other & (F.col("back") > tail))
    stay = rows.where("not gone").select("conv_id", "turn", "role", "text")
    summary = rows.where("gone").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.concat(F.lit("## Resumen: "), F.col("n").cast("string"), F.lit(" turnos")).alias("text"))
    return stay.unionAll(summary)
