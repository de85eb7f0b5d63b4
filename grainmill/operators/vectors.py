"""Exact similarities of a stated query set to all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors up to which they go to every task; queries of a block beyond that.
MOST_SENT, BLOCK = 64 << 20, 32_768
FOUND = "query_id long, vec_id long, similarity double"
_COLUMNS = ["query_id", "vec_id", "similarity"]


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _sims(ids: np.ndarray, queries: np.ndarray, pdf: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """Similarities of a block of queries to a batch of rows: all, or the k best others of each query."""
    rows = pdf["vec_id"].to_numpy()
    if not len(ids) or not len(rows):
        return pd.DataFrame(columns=_COLUMNS).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})
    sim = np.round(queries @ _unit(pdf["v"]).T, 6)
    if k is None:
        return pd.DataFrame({"query_id": np.repeat(ids, len(rows)), "vec_id": np.tile(rows, len(ids)), "similarity": sim.ravel()})
    out = []
    for i, query in enumerate(ids):
        # All that are no worse than the (k + 1)-th best, so that ties are settled by key.
        near = np.arange(len(rows)) if len(rows) <= k + 1 else np.flatnonzero(sim[i] >= np.partition(sim[i], len(rows) - k - 1)[len(rows) - k - 1])
        order = near[np.lexsort((rows[near], -sim[i][near]))]
        out += [(query, rows[j], sim[i, j]) for j in order[: k + 1] if rows[j] != query][:k]
    return pd.DataFrame(out, columns=_COLUMNS)


def _compared(df: DataFrame, key: str, vector: str, every: int, k: int | None, most_sent: int, block: int) -> DataFrame:
    """query_id, vec_id, similarity of every query with all rows, or with the k best of each batch of rows.

    Queries of a measured size that is small go to every task, and the rows are scanned once, without a shuffle. More are dealt
    into blocks, and each block meets each part of the rows.
    """
    good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    queries = good.where(F.col("vec_id") % every == 0)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") * 8), F.lit(0)).alias("bytes")).first()
    if size["bytes"] <= most_sent:
        pdf = queries.toPandas()
        sent = df.sparkSession.sparkContext.broadcast((pdf["vec_id"].to_numpy(np.int64), _unit(pdf["v"]) if len(pdf) else np.zeros((0, 0))))
        return good.mapInPandas(lambda it: (_sims(*sent.value, x, k) for x in it), FOUND)
    blocks = max(1, -(-size["n"] // block))
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    spread = queries.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    base = good.withColumn("_p", F.pmod(F.xxhash64("vec_id", F.lit("base")), F.lit(parts)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _sims(left["vec_id"].to_numpy(), _unit(left["v"]) if len(left) else np.zeros((0, 0)), right, k)

    return spread.groupBy("_b", "_p").cogroup(base.groupBy("_b", "_p")).applyInPandas(meet, FOUND)


def similarities(df: DataFrame, key: str, vector: str, every: int = 50, most_sent: int = MOST_SENT, block: int = BLOCK) -> DataFrame:
    """Similarity of every row whose key is divisible by `every` to every row. Nulls take no part; a zero vector has similarity 0."""
    return _compared(df, key, vector, every, None, most_sent, block)


def nearest(df: DataFrame, key: str, vector: str, k: int, every: int = 50, most_sent: int = MOST_SENT, block: int = BLOCK) -> DataFrame:
    """The k nearest other vectors of every row whose key is divisible by `every`: query_id, vec_id, rank, similarity.

    Each batch of rows leaves at most k candidates a query, by a matrix product; candidates are merged by query. Similarity is
    rounded before it ranks, ties go to the smaller key. Null vectors and null keys take no part; a zero vector has similarity 0.
    """
    found = _compared(df, key, vector, every, k, most_sent, block)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
