"""Packing policies for fixed-length sequences: chunks, one per pack, next-fit, best-fit, concatenation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import in_ranges

#: Tokens that frame a chunk: begin and end.
FRAME = 2


def chunks(rows: DataFrame, length: int) -> DataFrame:
    """Windows of length - FRAME tokens of each row, the last one partial; none of an empty or null row. Needs n_tokens."""
    room = length - FRAME
    out = rows.where(F.col("n_tokens") > 0).withColumn("token_start", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(room))))
    return out.withColumn("token_end", F.least(F.col("token_start") + room, F.col("n_tokens")))


def span_hash(tokens: Column) -> Column:
    """sha256 of the tokens written as a list of whole numbers."""
    return F.sha2(F.concat(F.lit("["), F.array_join(tokens.cast("array<string>"), ","), F.lit("]")), 256)


def _transition(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What next-fit does over the rows of one range partition, from every fill that it may find: bins opened and fill left.

    A full chunk, or rests that do not fit, bring all fills to the same one soon; from then on one number is carried.
    """

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Per group: the fills and bins by the fill before, and once all fills are one, that one and the bins since.
        fills: dict[str, np.ndarray] = {}
        bins: dict[str, np.ndarray] = {}
        alone: dict[str, tuple[int, int]] = {}
        number = -1
        for pdf in it:
            for key, number, full, more in zip(pdf["_key"].tolist(), pdf["_part"].tolist(), pdf["full"].tolist(), pdf["more"].tolist()):
                if key in alone:
                    used, n = alone[key]
                    if full:
                        used, n = length, n + full
                    if more:
                        used, n = (min(more, length), n + 1) if used + more > length else (used + more, n)
                    alone[key] = used, n
                    continue
                many = fills.setdefault(key, np.arange(length + 1))
                count = bins.setdefault(key, np.zeros(length + 1, np.int64))
                if full:
                    many, count = np.full(length + 1, length), count + full
                if more:
                    new = many + more > length
                    many, count = np.where(new, min(more, length), many + more), count + new
                fills[key], bins[key] = many, count
                if (many == many[0]).all():
                    alone[key] = int(many[0]), 0
        rows = []
        for key, count in bins.items():
            used, n = alone.get(key, (None, 0))
            rows += [(key, number, start, int(fills[key][start]) if used is None else used, int(count[start]) + n) for start in range(length + 1)]
        yield pd.DataFrame(rows, columns=["_key", "_part", "start", "used", "bins"])

    return part


def composed(rows: DataFrame, by: str, order: str, length: int, used: int, bins: int) -> DataFrame:
    """by, bins: next-fit over rows of `full` (sequences filled alone) and then `more` (places, or 0), in order, from a bin with `used` places.

    Next-fit keeps one open bin, so a run of rows is a map from its fill before to bins opened and fill after: length + 1
    numbers. Range partitions compute their maps side by side, and the maps are composed in order; a group of any size is
    spread over the partitions.
    """
    placed = in_ranges(rows, [by], order).withColumn("_key", F.to_json(F.struct(F.col(by).alias("k"))))
    maps = placed.sortWithinPartitions(by, order).select("_key", "_part", "full", "more").mapInPandas(_transition(length), "_key string, _part int, start int, used int, bins long")
    # One map a range partition and group: its fills and bins by the fill before.
    by_part = maps.groupBy("_key", "_part").agg(F.array_sort(F.collect_list(F.struct("start", "used", "bins"))).alias("m"))

    def compose(s: Column, x: Column) -> Column:
        at = F.element_at(x["m"], s["used"] + 1)
        return F.struct((s["bins"] + at["bins"]).alias("bins"), at["used"].alias("used"))

    start = F.struct(F.lit(bins).cast("long").alias("bins"), F.lit(used).alias("used"))
    opened = by_part.groupBy("_key").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_part", "m"))), start, compose, lambda s: s["bins"]).alias("bins"))
    return placed.select("_key", by).distinct().join(opened, "_key").select(by, "bins")


def next_fit(chunked: DataFrame, by: str, order: str, length: int) -> DataFrame:
    """Per value of `by`: bins that next-fit opens for chunks in order (a whole-number key and token_start), and their sizes."""
    room = length - FRAME
    size = F.col("token_end") - F.col("token_start")
    # Chunks of one row are full but for its last; so a row is its number of full chunks and a rest behind them.
    rows = chunked.groupBy(by, order).agg(F.count_if(size == room).alias("full"), F.sum(F.when(size < room, size + FRAME).otherwise(0)).alias("more"))
    sizes = rows.groupBy(by).agg(F.sum(F.col("full") * length + F.col("more")).alias("non_pad"))
    # Before the first row the bin counts as full.
    bins = composed(rows, by, order, length, length, 0).withColumnRenamed(by, "_by")
    return sizes.join(bins, sizes[by].eqNullSafe(F.col("_by"))).select(by, "bins", "non_pad")


def truncated(rows: DataFrame, by: str, order: str, length: int) -> DataFrame:
    """Per value of `by`, for documents with an end token each, cut at the sequence's length: sequences of next-fit, of best-fit decreasing and of one document each, and the tokens kept.

    Next-fit begins with an empty sequence, which stays empty if the first document is too long for it. Needs n_tokens.
    """
    items = rows.select(by, order, (F.col("n_tokens") + 1).cast("long").alias("more"), F.lit(0).cast("long").alias("full"))
    greedy = composed(items, by, order, length, 0, 1).select(F.col(by).alias("_a"), F.col("bins").alias("greedy"))
    spans = items.select(by, F.lit(0).alias("token_start"), (F.least("more", F.lit(length)) - FRAME).alias("token_end"))
    best = best_fit(spans, by, length).select(F.col(by).alias("_b"), F.col("bins").alias("best_fit"))
    one = items.groupBy(by).agg(F.count("*").alias("structure"), F.sum(F.least("more", F.lit(length))).alias("kept"))
    return one.join(greedy, one[by].eqNullSafe(F.col("_a"))).join(best, one[by].eqNullSafe(F.col("_b"))).select(by, "greedy", "best_fit", "structure", "kept")


def best_fit_plan(sizes: dict[int, int], length: int) -> tuple[int, int]:
    """(bins, tokens) that best-fit decreasing needs for framed sizes; sizes are counted, so the work is bounded by length squared.

    The tightest gap that takes an item stays the tightest for the next like item as long as it takes one; so a gap is filled
    with as many as it holds before the next larger one is looked at.
    """
    bins, gaps = 0, [0] * (length + 1)
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        for gap in range(size, length + 1):
            each = gap // size
            filled = min(gaps[gap], left // each)
            gaps[gap] -= filled
            gaps[gap - each * size] += filled
            left -= filled * each
            if left and gaps[gap]:
                gaps[gap] -= 1
                gaps[gap - left * size] += 1
                left = 0
            if not left:
                break
        if left:
            full, rest = divmod(left, length // size)
            bins += full + bool(rest)
            gaps[length - length // size * size] += full
            if rest:
                gaps[length - rest * size] += 1
    return bins, sum(s * n for s, n in sizes.items())


def best_fit(chunked: DataFrame, by: str, length: int) -> DataFrame:
    """Per value of `by`: bins of best-fit decreasing. What meets in a task is a histogram of at most `length` sizes."""
    size = (F.col("token_end") - F.col("token_start") + FRAME).cast("int")
    histogram = chunked.groupBy(by, size.alias("size")).count()

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, tokens = best_fit_plan(dict(zip(pdf["size"].tolist(), pdf["count"].tolist())), length)
        return pd.DataFrame({by: pdf[by].iloc[:1], "bins": [bins], "non_pad": [tokens]})

    return histogram.groupBy(by).applyInPandas(plan, f"{by} {dict(chunked.dtypes)[by]}, bins long, non_pad long")


#: Roles whose tokens bear loss when they are predicted.
BEARING = ("content", "assistant", "tool_call", "eos")


def framed(rows: DataFrame, length: int) -> DataFrame:
    """One sequence per chunk: input_ids, labels, loss_mask, position_ids, segment_ids, token_roles. Needs tokens, roles, token_start, token_end."""
    n = F.col("token_end") - F.col("token_start")
    cut = lambda c: F.slice(c, F.col("token_start") + 1, n)
    pads = F.lit(length) - n - FRAME
    out = rows.withColumn("input_ids", F.concat(F.array(F.lit(1)), cut("tokens"), F.array(F.lit(2)), F.array_repeat(F.lit(0), pads)))
    out = out.withColumn("token_roles", F.concat(F.array(F.lit("bos")), cut("roles"), F.array(F.lit("eos")), F.array_repeat(F.lit("pad"), pads)))
    used = n + FRAME
    bearing = F.array(*[F.lit(x) for x in BEARING])
    shifted = F.slice("token_roles", F.lit(2), F.lit(length - 1))
    mask = F.concat(F.transform(shifted, lambda r: F.array_contains(bearing, r).cast("int")), F.array(F.lit(0)))
    place = F.sequence(F.lit(0), F.lit(length - 1))
    return (
        out.withColumn("labels", F.concat(F.slice("input_ids", F.lit(2), F.lit(length - 1)), F.array(F.lit(0))))
        .withColumn("loss_mask", mask)
        .withColumn("position_ids", F.transform(place, lambda i: F.when(i < used, i).otherwise(0)))
        .withColumn("segment_ids", F.transform(place, lambda i: F.when(i < used, 0).otherwise(-1)))
    )


def total(array: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)



def offsets(df: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """packed_start and packed_end of the parts of one sequence (bounded by its length)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("packed_end", F.sum(size).over(w)).withColumn("packed_start", F.col("packed_end") - F.col(size))
