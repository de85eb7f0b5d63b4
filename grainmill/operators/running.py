"""Running sums over ordered keys without one task per group: range partitions, their prefix, then sums within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def in_ranges(df: DataFrame, by: list[str], order: str, name: str = "_part", partitions: int | None = None) -> DataFrame:
    """df in range partitions of (by, order), of about as many rows each, with the partition's number; kept, so that the numbers hold."""
    n = partitions or max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(n, *by, order).withColumn(name, F.spark_partition_id()))


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """The sum of `value` over the rows before each row, by `order` (unique in its group) within `by`.

    Ranges hold about as many rows each, however the keys lie, so a group of any size is spread over tasks. Null values count as 0;
    null groups are groups.
    """
    placed = in_ranges(df, by, order, partitions=partitions)
    v = F.coalesce(F.col(value), F.lit(0))
    sums = placed.groupBy(*by, "_part").agg(F.sum(v).alias("_s"))
    # A row per range partition and group that ends in it.
    before = sums.select(*by, "_part", (F.sum("_s").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_s")).alias("_before"))
    a, b = placed.alias("a"), before.alias("b")
    match = F.lit(True)
    for c in [*by, "_part"]:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    within = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return a.join(b, match).select("a.*", "b._before").withColumn(name, F.col("_before") + F.coalesce(F.sum(v).over(within), F.lit(0))).drop("_before", "_part")
