"""Append-only ledgers: hash chains, contiguity, projections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def body(*columns: str) -> Column:
    """A record's content as one string, column by column; nulls are marked apart from empty strings."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def with_hashes(steps: DataFrame, run: str, step: str, columns: list[str]) -> DataFrame:
    """steps with previous_hash and record_hash = sha256(previous_hash | content), along each run's steps.

    A chain is sequential by nature. Runs are hashed to tasks and sorted there; a task streams its rows and carries one hash,
    so its memory does not grow with a run.
    """

    def chain(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), GENESIS
        for pdf in it:
            before, own = [], []
            for key, content in zip(pdf[run].tolist(), pdf["_body"].tolist()):
                if key != now:
                    now, last = key, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}|{content}".encode()).hexdigest()
                own.append(last)
            yield pdf.drop(columns="_body").assign(previous_hash=before, record_hash=own)

    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    ordered = steps.withColumn("_body", body(*columns)).repartition(run).sortWithinPartitions(run, step)
    return ordered.mapInPandas(chain, ", ".join(f"`{c}` {t}" for c, t in (kinds | {"previous_hash": "string", "record_hash": "string"}).items()))


def broken_links(ledger: DataFrame, run: str, step: str, columns: list[str]) -> DataFrame:
    """Records whose predecessor's hash or own hash does not hold. Links are checked side by side, in parallel."""
    before = F.lag("record_hash", 1).over(Window.partitionBy(run).orderBy(step))
    own = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), body(*columns)), 256)
    checked = ledger.withColumn("_link", F.col("previous_hash") == F.coalesce(before, F.lit(GENESIS))).withColumn("_own", F.col("record_hash") == own)
    return checked.where(~F.col("_link") | ~F.col("_own")).drop("_link", "_own")


def gaps(steps: DataFrame, run: str, step: str) -> DataFrame:
    """Per run: first and last step, records, and whether steps are 0, 1, 2, ... without gap or repeat. No sort is needed."""
    s = steps.groupBy(run).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("records"), F.countDistinct(step).alias("distinct_steps"))
    return s.withColumn("contiguous", (F.col("first_step") == 0) & (F.col("last_step") + 1 == F.col("records")) & (F.col("records") == F.col("distinct_steps")))
