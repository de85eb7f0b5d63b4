"""Queries on partitioned training state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sharding as S
from .base import Plans, Tables

P = Plans()
N, WORLD, GBPS, FLOPS = 132_160, 32, 5.0, S.mlp_flops(128, 64, 256, 16)
_SLICES = f"SELECT r::BIGINT AS rank, (r * ({{n}} // {{w}}) + least(r, {{n}} % {{w}}))::BIGINT AS start, (r * ({{n}} // {{w}}) + least(r, {{n}} % {{w}}) + {{n}} // {{w}} + CASE WHEN r < {{n}} % {{w}} THEN 1 ELSE 0 END)::BIGINT AS stop FROM range(0, {{w}}) AS a(r)"  # noqa: F541


def _ranks(t: Tables, total: int, world: int) -> DataFrame:
    return S.slices(t.spark.range(world).withColumnRenamed("id", "rank"), "rank", F.lit(total), F.lit(world))


@P.query(_SLICES.format(n=17, w=32))
def balanced_slices(t: Tables) -> DataFrame:
    """17 items over 32 ranks: the last shares are empty."""
    return _ranks(t, 17, 32).select("rank", "start", "stop")


@P.query(f"""
    WITH s AS ({_SLICES.format(n=N, w=WORLD)}), k AS (SELECT unnest(['zero0', 'zero1', 'zero2', 'zero3']) AS stage, unnest([0, 1, 2, 3]) AS k)
    SELECT stage, rank, CASE WHEN k = 3 THEN stop - start ELSE {N} END AS parameters, CASE WHEN k >= 2 THEN stop - start ELSE {N} END AS gradients, CASE WHEN k >= 1 THEN stop - start ELSE {N} END AS optimizer FROM s, k
""")
def zero_ownership(t: Tables) -> DataFrame:
    """How many elements of each state a rank holds, by stage."""
    own, k = F.col("stop") - F.col("start"), F.col("k")
    held = lambda since: F.when(k >= since, own).otherwise(F.lit(N).cast("long"))
    return _ranks(t, N, WORLD).crossJoin(F.broadcast(S.stages(t.spark))).select("stage", "rank", held(3).alias("parameters"), held(2).alias("gradients"), held(1).alias("optimizer"))


@P.query(f"""
    WITH s AS ({_SLICES.format(n=N, w=WORLD)}), l AS ({_SLICES.format(n=60, w=WORLD)}), z AS (SELECT l.rank, coalesce(sum(100 + i * 7), 0) AS total FROM l LEFT JOIN range(0, 60) AS a(i) ON i >= l.start AND i < l.stop GROUP BY l.rank)
    SELECT min(stop - start) AS shard_min, max(stop - start) AS shard_max, (SELECT min(total) FROM z)::BIGINT AS layer_min, (SELECT max(total) FROM z)::BIGINT AS layer_max FROM s
""")
def shard_summary(t: Tables) -> DataFrame:
    """Smallest and largest share of the parameters, and of the layers' summed sizes."""
    sizes = _ranks(t, N, WORLD).agg(F.min(F.col("stop") - F.col("start")).alias("shard_min"), F.max(F.col("stop") - F.col("start")).alias("shard_max"))
    layers = t.spark.range(60).select(F.col("id").alias("i"), (100 + F.col("id") * 7).alias("size"))
    per = _ranks(t, 60, WORLD).join(F.broadcast(layers), (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")), "left").groupBy("rank").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return sizes.crossJoin(per.agg(F.min("total").alias("layer_min"), F.max("total").alias("layer_max")))


_MEMORY = """
    SELECT stage, world, CASE WHEN k = 3 THEN n * 2.0::DOUBLE / world ELSE n * 2.0::DOUBLE END AS parameter_bytes, CASE WHEN k >= 2 THEN n * 2.0::DOUBLE / world ELSE n * 2.0::DOUBLE END AS gradient_bytes,
      CASE WHEN k >= 1 THEN n * 4.0::DOUBLE / world ELSE n * 4.0::DOUBLE END AS master_bytes, CASE WHEN k >= 1 THEN n * 8.0::DOUBLE / world ELSE n * 8.0::DOUBLE END AS optimizer_bytes, CASE WHEN k = 3 THEN n * 2.0::DOUBLE / world ELSE 0 END AS temporary_bytes, k, n
    FROM (SELECT unnest(['zero0', 'zero1', 'zero2', 'zero3']) AS stage, unnest([0, 1, 2, 3]) AS k), (SELECT unnest([8, 32, 128]) AS world), (SELECT 132160 AS n)
"""


def _grid(t: Tables) -> DataFrame:
    worlds = t.spark.createDataFrame([(8,), (32,), (128,)], "world int")
    return S.stages(t.spark).crossJoin(F.broadcast(worlds))


@P.query(f"SELECT stage, world, round(parameter_bytes + gradient_bytes + master_bytes + optimizer_bytes, 3) AS model_state_bytes, round(parameter_bytes + gradient_bytes + master_bytes + optimizer_bytes + 2097152 + temporary_bytes, 3) AS peak_bytes, round((parameter_bytes + gradient_bytes + master_bytes + optimizer_bytes) * world, 3) AS cluster_bytes FROM ({_MEMORY})")
def zero_memory(t: Tables) -> DataFrame:
    m = S.memory(_grid(t), F.lit(N), F.col("world"), F.lit(2_097_152.0))
    return m.select("stage", "world", *[F.round(c, 3).alias(c) for c in ("model_state_bytes", "peak_bytes", "cluster_bytes")])


_RING = "(n * 2.0::DOUBLE * 2 * (world - 1) / world)"


@P.query(f"SELECT stage, world, round({_RING}, 3) AS collective_bytes, round(CASE WHEN k = 3 THEN {_RING} ELSE 0 END, 3) AS gather_bytes, round({_RING} * CASE WHEN k = 3 THEN 2 ELSE 1 END / 5e9 * 1000, 9) AS traffic_ms FROM ({_MEMORY})")
def zero_comm(t: Tables) -> DataFrame:
    c = S.traffic(_grid(t), F.lit(N), F.col("world"), GBPS)
    return c.select("stage", "world", F.round("collective_bytes", 3).alias("collective_bytes"), F.round("gather_bytes", 3).alias("gather_bytes"), F.round("traffic_ms", 9).alias("traffic_ms"))


@P.query(f"SELECT stage, world, round(parameter_bytes + gradient_bytes + master_bytes + optimizer_bytes, 3) AS model_state_bytes, {FLOPS}::BIGINT AS flops, round({FLOPS} / 1e12::DOUBLE * 1000, 9) AS compute_ms, round({FLOPS} / 1e12::DOUBLE * 1000 + {_RING} * CASE WHEN k = 3 THEN 2 ELSE 1 END / 5e9 * 1000, 9) AS step_ms FROM ({_MEMORY})")
def zero_table(t: Tables) -> DataFrame:
    """Memory, traffic and modelled step time of each stage and world size."""
    m = S.traffic(S.memory(_grid(t), F.lit(N), F.col("world"), F.lit(2_097_152.0)), F.lit(N), F.col("world"), GBPS)
    ms = FLOPS / 1e12 * 1000
    return m.select("stage", "world", F.round("model_state_bytes", 3).alias("model_state_bytes"), F.lit(FLOPS).cast("long").alias("flops"), F.round(F.lit(ms), 9).alias("compute_ms"), F.round(F.col("traffic_ms") + ms, 9).alias("step_ms"))


QUERIES, SQL = P.QUERIES, P.SQL
