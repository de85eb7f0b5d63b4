"""Problem 6: cutoffs that keep a target fraction, by iterative histogram refinement.

A round counts the scores of each group into equal bins of the group's current interval (map-side combined: at most
groups x bins rows are shuffled or reach the driver, whatever the data's size), finds the bin that holds the target
rank, and the next round zooms into that bin's smallest and largest value. A bin whose smallest value is its largest is
the exact cutoff. Every round scans two or three columns; no row is sorted and no group meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 2048


def _histogram(df: DataFrame, bounds: DataFrame, bins: int) -> list:
    """Counts, weights, smallest and largest key of each bin of each group's interval; keys outside it are left out."""
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width <= 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_key") - F.col("_lo")) / width * bins)))
    return (
        df.join(F.broadcast(bounds), "_group")
        .where((F.col("_key") >= F.col("_lo")) & (F.col("_key") <= F.col("_hi")))
        .groupBy("_group", at.cast("int").alias("_bin"))
        .agg(F.count("*").alias("n"), F.sum("_weight").alias("w"), F.min("_key").alias("least"), F.max("_key").alias("most"))
        .collect()
    )


def refine(
    spark: SparkSession,
    df: DataFrame,
    group: Column,
    key: Column,
    lo: float,
    hi: float,
    target: Callable[[str, int, int], int],
    *,
    weight: Column | None = None,
    groups: list[str],
    descending: bool = True,
    bins: int = BINS,
) -> dict[str, dict]:
    """The exact key of each group at which the weight accumulated from its best end first reaches target(group, rows, weight).

    groups: the groups asked for (a fixed list, such as the rows of a configuration table). Keys lie in [lo, hi] and are
    not null. descending: accumulate from the largest key down, else from the smallest up. Returns, for groups that have
    rows and a positive target: cutoff, rows and weight in all, rows and weight at or before the cutoff, rows and weight at it.
    """
    base = df.select(group.alias("_group"), key.alias("_key"), (F.lit(1) if weight is None else weight).cast("long").alias("_weight")).where(F.col("_group").isin(groups)) if groups else None
    state = {g: {"lo": float(lo), "hi": float(hi), "before_n": 0, "before_w": 0} for g in groups}
    out: dict[str, dict] = {}
    first = True
    schema = T.StructType([T.StructField("_group", T.StringType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
    while state:
        bounds = spark.createDataFrame([(g, s["lo"], s["hi"]) for g, s in state.items()], schema)
        by: dict[str, list] = {}
        for row in _histogram(base, bounds, bins):
            by.setdefault(row["_group"], []).append(row)
        for g in list(state):
            s, rows = state[g], sorted(by.get(g, []), key=lambda r: r["_bin"], reverse=descending)
            if first:
                s["n"], s["w"] = sum(r["n"] for r in rows), sum(r["w"] for r in rows)
                s["need"] = min(s["w"], target(g, s["n"], s["w"])) if rows else 0
                if s["need"] <= 0:
                    del state[g]
                    continue
            for r in rows:
                if s["before_w"] + r["w"] >= s["need"]:
                    if r["least"] == r["most"]:
                        out[g] = {"cutoff": r["least"], "n": s["n"], "w": s["w"], "need": s["need"], "kept_n": s["before_n"] + r["n"], "kept_w": s["before_w"] + r["w"], "at_n": r["n"], "at_w": r["w"]}
                        del state[g]
                    else:
                        s["lo"], s["hi"] = r["least"], r["most"]
                    break
                s["before_n"] += r["n"]
                s["before_w"] += r["w"]
        first = False
    return out


def _fractions(config: DataFrame) -> dict[str, float]:
    """keep_fraction by lane; of repeated lanes the largest; null, NaN and non-positive fractions name no cutoff."""
    rows = config.where(F.col("lane").isNotNull() & ~F.isnan("keep_fraction") & (F.col("keep_fraction") > 0)).groupBy("lane").agg(F.max("keep_fraction").alias("f")).collect()
    return {r["lane"]: min(1.0, r["f"]) for r in rows}


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, lane and quality of the documents with a lane and a quality from 0 to 1 (NaN and nulls are none)."""
    quality = F.col("quality")
    return documents.where(F.col("lane").isNotNull() & (quality >= 0.0) & (quality <= 1.0)).select("doc_id", "lane", quality.cast("double").alias("quality"))


CUTOFFS = "lane string, keep_fraction double, cutoff double, scored long, kept long"


def lane_cutoffs(documents: DataFrame, lane_config: DataFrame, bins: int = BINS) -> DataFrame:
    """One row per lane of lane_config that has scored documents: its exact cutoff, scored and kept counts.

    Ties: all documents at the cutoff are kept, so kept may exceed the target. Lanes without scored documents, without a
    usable keep_fraction or missing from lane_config have no row. Repeated document rows count each. Empty tables give no rows.
    lane_config has a row per lane, a fixed number; it is the only thing gathered besides the bins.
    """
    spark = documents.sparkSession
    fractions = _fractions(lane_config)
    found = refine(spark, scored(documents), F.col("lane"), F.col("quality"), 0.0, 1.0, lambda g, n, w: math.ceil(fractions[g] * n), groups=sorted(fractions), bins=bins)
    return spark.createDataFrame([(g, fractions[g], float(x["cutoff"]), x["n"], x["kept_n"]) for g, x in sorted(found.items())], CUTOFFS)


def kept_documents(documents: DataFrame, lane_config: DataFrame, bins: int = BINS) -> DataFrame:
    """Every scored document at or above its lane's cutoff: doc_id, lane, quality, cutoff."""
    cut = lane_cutoffs(documents, lane_config, bins).select("lane", "cutoff")
    return scored(documents).join(F.broadcast(cut), "lane").where(F.col("quality") >= F.col("cutoff"))
