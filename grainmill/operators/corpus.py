"""Corpus operators: deliveries, shards and manifests, splits, firewalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivered(shard_rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (shard_id, row_id): the one written last; with the columns asked for. Aggregates before it shuffles."""
    pick = F.max(F.struct("written_at", *columns)).alias("r")
    return shard_rows.groupBy("shard_id", "row_id").agg(pick).select("shard_id", "row_id", *(F.col(f"r.{c}").alias(c) for c in columns))


def shard_manifest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per shard: documents, tokens, sorted distinct labels, ordered ids, and the hash of the ordered content hashes.

    The ordered lists are a shard's own (bounded by the shard's size, as its file is).
    """
    content = F.array_sort(F.collect_list(F.struct("row_id", F.coalesce("cleaned_content_hash", F.lit("")).alias("h"))))
    return rows.groupBy(*by).agg(
        F.count("*").alias("document_count"),
        F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("token_count"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        F.sha2(F.array_join(F.transform(content, lambda x: x["h"]), ""), 256).alias("content_hash"),
    )


def first_ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
