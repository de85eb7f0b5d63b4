"""Joins of links between groups with the groups' members, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that one task takes at least; and groups at most that may be split.
CHUNK, GROUPS = 20_000, 10_000


def large_groups(members: DataFrame, rep: str, chunk: int = CHUNK) -> DataFrame:
    """Groups of more members than a chunk, and into how many parts to split them.

    The chunk grows with the table, so that at most GROUPS groups can be larger: that bounds what is broadcast. The count is
    partially aggregated, so a hot group costs a row per task.
    """
    chunk = max(chunk, members.count() // GROUPS)
    return members.groupBy(rep).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk).select(rep, F.ceil(F.col("_n") / chunk).cast("int").alias("_k"))


def with_members(links: DataFrame, column: str, members: DataFrame, rep: str, member: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """links with each member of the group that `column` names, as `name`. A large group's members and links are dealt over many keys."""
    large = large_groups(members, rep, chunk)
    part = F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    dealt = members.join(F.broadcast(large), rep, "left").select(F.col(rep).alias(column), part.alias("_part"), F.col(member).alias(name))
    spread = links.join(F.broadcast(large.withColumnRenamed(rep, column)), column, "left")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1))).drop("_k")
    return spread.join(dealt, [column, "_part"]).drop("_part")
