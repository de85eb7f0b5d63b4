"""Balanced slices, ownership, memory and traffic of partitioned training state, as closed forms over a table of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("zero0", "zero1", "zero2", "zero3")
#: Bytes of a half and of a full precision number.
HALF, FULL = 2, 4


def slices(ranks: DataFrame, rank: str, total: Column, world: Column) -> DataFrame:
    """start and stop of each rank's contiguous share; the first ranks take the remainder, and shares may be empty."""
    base, rest, r = F.floor(total / world), total % world, F.col(rank)
    start = r * base + F.least(r, rest)
    return ranks.withColumn("start", start.cast("long")).withColumn("stop", (start + base + F.when(r < rest, 1).otherwise(0)).cast("long"))


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, k int")


def memory(df: DataFrame, parameters: Column, world: Column, activations: Column) -> DataFrame:
    """Bytes per rank of 16 bytes a parameter, by what a stage shards: optimizer from 1 on, gradients from 2, parameters from 3."""
    n, w, k = parameters.cast("double"), world.cast("double"), F.col("k")
    part = lambda size, since: F.when(k >= since, n * size / w).otherwise(n * size)
    out = df.withColumn("parameter_bytes", part(HALF, 3)).withColumn("gradient_bytes", part(HALF, 2)).withColumn("master_bytes", part(FULL, 1)).withColumn("optimizer_bytes", part(2 * FULL, 1))
    out = out.withColumn("temporary_bytes", F.when(k == 3, n * HALF / w).otherwise(0.0))
    out = out.withColumn("model_state_bytes", F.col("parameter_bytes") + F.col("gradient_bytes") + F.col("master_bytes") + F.col("optimizer_bytes"))
    return out.withColumn("peak_bytes", F.col("model_state_bytes") + activations + F.col("temporary_bytes")).withColumn("cluster_bytes", F.col("model_state_bytes") * w)


def traffic(df: DataFrame, parameters: Column, world: Column, gbps: float) -> DataFrame:
    """Bytes that a rank sends per step with the ring factor 2 (N - 1) / N for each collective; the last stage gathers parameters too."""
    ring = parameters * HALF * (world - 1) * 2 / world.cast("double")
    out = df.withColumn("collective_bytes", ring).withColumn("gather_bytes", F.when(F.col("k") == 3, ring).otherwise(0.0))
    out = out.withColumn("total_bytes", F.col("collective_bytes") + F.col("gather_bytes"))
    return out.withColumn("traffic_ms", F.col("total_bytes") / (gbps * 1e9) * 1000)


def mlp_flops(batch: int, inputs: int, hidden: int, outputs: int) -> int:
    """Forward and backward of two linear layers, the backward counted twice the forward."""
    return 2 * batch * (inputs * hidden + hidden * outputs) * 3
