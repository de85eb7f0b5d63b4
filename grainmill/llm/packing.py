"""Problem 2: filling fixed-capacity containers, by bulk-synchronous best-fit over range-partitioned runs of items and gaps.

Sizes are whole numbers up to the capacity, so the sorted items of a lane are runs (size, ranks lo to hi), and its sorted gaps
are runs of like containers (gap, first container, count). Both are rows of one table, bounded by the capacities and not by
the data. A round is one pass over that table:

  sort    items and gaps go to RANGES ranges of their value;
  sweep   in each range, side by side, items look up their successor from the largest down: the tightest gap that takes them;
  rank    like items rank within their size, like gaps by container; ranks beyond a gap run go on to the next gap;
  update  matched containers get their new gap, which later items of the sweep may take;
  merge   what found no gap in its own range meets the gaps that the other ranges left over, in one more sweep a lane;
  open    of the items left, the largest open containers: those above half the capacity; where there are none, as many as
          half the tokens left need (all, once these are FEW containers).

and rounds repeat until every item is placed. Items above half the capacity are all open after the first round; from then on
containers are more than half full when items are left over, so each round takes a quarter of what is left at least, and
about half of it in practice: the number of rounds grows as the logarithm of the containers.

A match is one row: the ranks lo to hi of a size, k to a container, from container `first` on. Items get their rank by range
partitions (no size meets in one task) and find their match by (lane, size, block of ranks), at most BLOCK items a key.
Tokens are never shuffled, only keys and sizes.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..session import cut_lineage
from .splitting import non_pad_count

#: Ranges of values that are swept side by side; ranks of one size that look up their match together.
RANGES, BLOCK = 16, 256
#: Containers so few that one round opens them all.
FEW = 64
#: kind: item (value: size; a, b: ranks), gap (value: gap; a: first container, b: count), match (value: size; a, b: ranks; first, start, k), next (a: containers so far).
RUNS = "lane string, capacity int, kind string, value int, a long, b long, first long, start int, k int"
_COLUMNS = ["lane", "capacity", "kind", "value", "a", "b", "first", "start", "k"]
Item = tuple[int, int, int]
Gap = tuple[int, int, int]
Match = tuple[int, int, int, int, int, int]


def sweep(items: list[Item], gaps: list[Gap], capacity: int) -> tuple[list[Match], list[Item], list[Gap]]:
    """Best-fit of items (size, lo, hi) into gaps (gap, first, count), largest items first: matches (size, lo, hi, first, start, k), and what is left of both.

    A container takes k = gap // size like items at once: its remaining gap stays the tightest as long as it takes one.
    """
    matches: list[Match] = []
    left: list[Item] = []
    values: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(gap: int, first: int, count: int) -> None:
        if count:
            if gap not in runs:
                runs[gap] = []
                insort(values, gap)
            runs[gap].append((first, count))

    for gap, first, count in sorted(gaps, reverse=True):
        put(gap, first, count)
    for size, lo, hi in sorted(items, key=lambda x: (-x[0], x[1])):
        while lo < hi and (at := bisect_left(values, size)) < len(values):
            gap = values[at]
            first, there = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                values.pop(at)
            k = min(gap // size, hi - lo)
            filled = min(there, (hi - lo) // k)
            matches.append((size, lo, lo + filled * k, first, capacity - gap, k))
            lo += filled * k
            put(gap - k * size, first, filled)
            put(gap, first + filled, there - filled)
        if lo < hi:
            left.append((size, lo, hi))
    return matches, left, [(gap, first, count) for gap in values for first, count in runs[gap]]


def open_containers(items: list[Item], capacity: int, containers: int) -> tuple[list[Match], list[Item], list[Gap], int]:
    """The largest items open a container each: all above half the capacity, or as many as half the tokens need."""
    need = -(-sum(size * (hi - lo) for size, lo, hi in items) // capacity)
    todo = sum(hi - lo for size, lo, hi in items if 2 * size > capacity) or (need if need <= FEW else -(-need // 2))
    matches, left, gaps = [], [], []
    for size, lo, hi in sorted(items, key=lambda x: (-x[0], x[1])):
        if n := min(todo, hi - lo):
            matches.append((size, lo, lo + n, containers, 0, 1))
            gaps.append((capacity - size, containers, n))
            containers, todo = containers + n, todo - n
        if lo + n < hi:
            left.append((size, lo + n, hi))
    return matches, left, gaps, containers


def _read(pdf: pd.DataFrame) -> tuple[str, int, list[Item], list[Gap]]:
    rows = [tuple(map(int, r)) for r in pdf[["value", "a", "b"]].itertuples(index=False, name=None)]
    kinds = pdf["kind"].tolist()
    return pdf["lane"].iloc[0], int(pdf["capacity"].iloc[0]), [r for k, r in zip(kinds, rows) if k == "item"], [r for k, r in zip(kinds, rows) if k == "gap"]


def _write(lane: str, capacity: int, matches: list[Match], items: list[Item], gaps: list[Gap], containers: int | None = None) -> pd.DataFrame:
    rows = [(lane, capacity, "match", size, lo, hi, first, start, k) for size, lo, hi, first, start, k in matches]
    rows += [(lane, capacity, "item", size, lo, hi, 0, 0, 0) for size, lo, hi in items]
    rows += [(lane, capacity, "gap", gap, first, count, 0, 0, 0) for gap, first, count in gaps if gap]
    if containers is not None:
        rows.append((lane, capacity, "next", 0, containers, 0, 0, 0, 0))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sweep of one range of values; rows that are neither item nor gap pass through."""
    lane, capacity, items, gaps = _read(pdf)
    return pd.concat([_write(lane, capacity, *sweep(items, gaps, capacity)), pdf.loc[~pdf["kind"].isin(["item", "gap"]), _COLUMNS]])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sweep of what the ranges of a lane left over, and the opening of containers."""
    lane, capacity, items, gaps = _read(pdf)
    matches, items, gaps = sweep(items, gaps, capacity)
    containers = int(pdf.loc[pdf["kind"] == "next", "a"].max()) if (pdf["kind"] == "next").any() else 0
    opened, items, new, containers = open_containers(items, capacity, containers)
    return pd.concat([_write(lane, capacity, matches + opened, items, gaps + new, containers), pdf.loc[pdf["kind"] == "match", _COLUMNS]])


def plan(histogram: DataFrame, ranges: int = RANGES) -> DataFrame:
    """lane, size, lo, hi, first, start, k of all matches. histogram: lane, capacity, size, count.

    Rounds go on until no lane has an item left; only whether one has reaches the driver.
    """
    zero = [F.lit(0).cast(t).alias(c) for c, t in (("first", "long"), ("start", "int"), ("k", "int"))]
    runs = histogram.select("lane", "capacity", F.lit("item").alias("kind"), F.col("size").alias("value"), F.lit(0).cast("long").alias("a"), F.col("count").alias("b"), *zero)
    at = F.floor(F.col("value") * ranges / (F.col("capacity") + 1)).cast("int")
    out = None
    while True:
        swept = runs.groupBy("lane", "capacity", at.alias("_range")).applyInPandas(_local, RUNS)
        runs = cut_lineage(swept.groupBy("lane", "capacity").applyInPandas(_merge, RUNS))
        found = runs.where("kind = 'match'").select("lane", F.col("value").alias("size"), F.col("a").alias("lo"), F.col("b").alias("hi"), "first", "start", "k")
        out = found if out is None else out.unionByName(found)
        if runs.where("kind = 'item'").isEmpty():
            return out
        runs = runs.where("kind <> 'match'")


def _items(shard_rows: DataFrame, lane_config: DataFrame) -> DataFrame:
    """One row per part: shard_id, row_id, lane, capacity, part, size, token_start. Parts are of full capacity but the last."""
    config = lane_config.where(F.col("lane").isNotNull() & (F.col("capacity") > 0)).groupBy("lane").agg(F.min("capacity").alias("capacity"))
    keyless = F.when(F.col("shard_id").isNull() | F.col("row_id").isNull(), F.xxhash64("tokens", "lane"))
    rows = (
        shard_rows.select("shard_id", "row_id", keyless.alias("_keyless"), F.struct("written_at", non_pad_count().alias("n"), "lane").alias("r"))
        .groupBy("shard_id", "row_id", "_keyless")
        .agg(F.max("r").alias("r"))
        .select("shard_id", "row_id", "_keyless", "r.lane", "r.n")
        .join(F.broadcast(config), "lane", "left")
    )
    # A row that fits is one part; rows without a capacity or tokens are one part that takes no container.
    last = F.when(F.col("capacity").isNull() | (F.col("n") <= F.col("capacity")), F.lit(0)).otherwise(F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    start = F.coalesce(F.col("part") * F.col("capacity"), F.lit(0))
    size = F.when(F.col("capacity").isNull(), F.col("n")).otherwise(F.least(F.col("capacity"), F.col("n") - start))
    return parts.select("shard_id", "row_id", "_keyless", "lane", "capacity", "part", start.cast("int").alias("token_start"), size.cast("int").alias("size"))


def pack(shard_rows: DataFrame, lane_config: DataFrame, ranges: int = RANGES, block: int = BLOCK) -> DataFrame:
    """shard_id, row_id, lane, part, token_start, size, container, packed_start, capacity, container_fill.

    token_start counts the row's non-pad tokens; container numbers are per lane from 0. Rows delivered twice are placed once
    (written last, then the longest). A row longer than the capacity is cut into parts of the capacity and one rest; no other
    row is cut. Rows without tokens, without a lane, or of a lane that lane_config lacks come out with a null container. Of
    repeated lanes in lane_config the smallest capacity holds. Empty tables give no rows. lane_config has a row per lane and
    is all that is broadcast by hint.
    """
    items = cut_lineage(_items(shard_rows, lane_config))
    fit = items.where(F.col("capacity").isNotNull() & (F.col("size") > 0))
    # Matches are dealt to the blocks of ranks that they reach.
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))
    matches = plan(fit.groupBy("lane", "capacity", "size").count(), ranges).select("*", blocks.alias("_block"))
    order = [F.asc(c) for c in ("shard_id", "row_id", "_keyless", "part")]
    placed = ranked(fit, ["lane", "size"], order, "_rank").withColumn("_rank", F.col("_rank") - 1).withColumn("_block", F.floor(F.col("_rank") / block))
    at = F.col("_rank") - F.col("lo")
    placed = (
        placed.join(matches, ["lane", "size", "_block"])
        .where((at >= 0) & (F.col("_rank") < F.col("hi")))
        .select("shard_id", "row_id", "lane", "part", "token_start", "size", (F.col("first") + F.floor(at / F.col("k"))).alias("container"), (F.col("start") + at % F.col("k") * F.col("size")).cast("int").alias("packed_start"), "capacity")
    )
    fill = F.sum("size").over(Window.partitionBy("lane", "container"))
    placed = placed.withColumn("container_fill", fill)
    none = items.where(F.col("capacity").isNull() | (F.col("size") <= 0)).select(
        "shard_id", "row_id", "lane", "part", "token_start", "size", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("packed_start"), "capacity", F.lit(None).cast("long").alias("container_fill")
    )
    return placed.unionByName(none)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per lane: containers, tokens placed, least number of containers possible, and the fill."""
    return (
        placed.where(F.col("container").isNotNull())
        .groupBy("lane", "capacity")
        .agg((F.max("container") + 1).alias("containers"), F.sum("size").alias("tokens"), F.count("*").alias("parts"))
        .select("lane", "capacity", "containers", "parts", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
    )
