"""Beam search over a table of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beam_search(moves: DataFrame, width: int, length: int) -> DataFrame:
    """The `width` paths of highest summed log probability from each start, `length` steps on: start, path, logp, rank.

    moves: src, dst, logp. Every step joins the kept paths with the moves and keeps the best of each start again; ties go to
    the path that sorts first.
    """
    paths = moves.select(F.col("src").alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.lit(0.0).alias("logp"))
    for _ in range(length):
        step = moves.select(F.col("src").alias("at"), "dst", F.col("logp").alias("more"))
        grown = paths.join(step, "at").select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("logp") + F.col("more")).alias("logp"))
        w = Window.partitionBy("start").orderBy(F.desc(F.round("logp", 9)), F.array_join("path", ","))
        paths = grown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width).drop("rank")
    w = Window.partitionBy("start").orderBy(F.desc(F.round("logp", 9)), F.array_join("path", ","))
    return paths.select("start", F.array_join("path", ",").alias("path"), F.round("logp", 9).alias("logp"), F.row_number().over(w).alias("rank"))
