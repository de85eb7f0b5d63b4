"""Problem 8: mixing sources to target weights, by Pareto order sampling after whole copies.

The mixture's total T is a parameter; left out, it is as large as the corpus (the tokens of all named sources). A source of
W tokens that may be repeated m times gives at most m * W: sources whose share of T is more give all that they may, and the
others keep their proportions: source i owes min(t_i * x, m_i * W_i), with x such that the owed tokens sum to T. What a
source falls short of t_i * T is reported.

A source that owes r copies of itself gives floor(r) whole copies of every document for certain; the rest R < W tokens is a
sample in which document i is included with probability p_i = min(1, c * w_i), w_i growing with quality, and c such that
the expected tokens are R. Pareto order sampling draws u_i in (0, 1) from a hash of the document and takes the documents of
least u/(1-u) * (1-p)/p until R tokens are reached; the document at the edge is taken if that comes nearer to R. The cut is
found by histogram refinement, so no source is sorted or meets in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cutoff import refine

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern of the byte-level vocabularies (a public, fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Weights are whole numbers of millionths, so that sums over documents are exact in any order.
UNIT = 1_000_000
#: Bytes of the largest vocabulary file that is sent to the workers.
MOST_VOCABULARY = 64 << 20


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """The documents' doc_id, source, quality, bytes (tokens of the byte tokenizer) and tokens (of a public tokenizer; path).

    tokenizer None: tokens are bytes. The vocabulary is read where the plan is built and sent to the workers, which need no
    such file; it has a fixed size, and one above MOST_VOCABULARY bytes raises ValueError.
    """
    base = documents.select("doc_id", "source", "quality", F.octet_length("text").cast("long").alias("bytes"), "text")
    if tokenizer is None:
        return base.select("doc_id", "source", "quality", "bytes", F.col("bytes").alias("tokens"))
    raw = Path(tokenizer).read_bytes()
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"the vocabulary has {len(raw)} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(raw)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(sent.value)
        for pdf in it:
            yield pdf.assign(tokens=[len(encoding.encode_ordinary(t)) for t in pdf["text"]]).drop(columns="text")

    return base.mapInPandas(count, "doc_id long, source string, quality double, bytes long, tokens long")


def owed_tokens(size: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """What each source owes: share * x, at most repeats * size, summing to total (default: the size of all sources) or to all that may be given."""
    limit = sorted((repeats[s] * size[s] / share[s], s) for s in size)
    if not limit:
        return {}
    if total is None:
        total = sum(size.values())
    given, open_ = 0, sum(share[s] for _, s in limit)
    x = float("inf")
    for at, s in limit:
        if (total - given) / open_ <= at:
            x = max(0.0, total - given) / open_
            break
        given, open_ = given + repeats[s] * size[s], open_ - share[s]
    return {s: min(share[s] * x, float(repeats[s] * size[s])) for s in size}


PLAN = "source string, target_share double, max_repeats int, available long, total double, owed double, copies int, rest long, c double"


@dataclass
class Mixture:
    """uses: doc_id, source, tokens, bytes, uses of every training document with text. plan: a row per source, see PLAN."""

    uses: DataFrame
    plan: DataFrame

    def report(self) -> DataFrame:
        """Per source: what it owes and gives in tokens, the shares aimed at and reached, and how far it falls short of its share."""
        got = self.uses.groupBy("source").agg(
            F.count("*").alias("documents"), F.sum("uses").cast("long").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("given"), F.max("tokens").alias("largest")
        )
        # The plan has a row per source of a fixed table.
        both = F.broadcast(self.plan).join(got, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
        whole = both.agg(F.sum("given").alias("_all"))
        short = F.greatest(F.lit(0.0), F.col("target_share") * F.col("_all") - F.col("given"))
        return both.crossJoin(F.broadcast(whole)).select(
            "source", "target_share", F.round(F.col("given") / F.col("_all"), 9).alias("actual_share"), "max_repeats", "available", F.round("owed", 3).alias("owed"), "given",
            F.round(short, 3).alias("short"), (F.abs(F.col("given") - F.col("owed")) <= F.coalesce("largest", F.lit(0)) / 2 + 1).alias("as_owed"), "documents", "uses", "most_uses",
        )


def _targets(source_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """(share, repeats) by source: a fixed table of a few rows."""
    good = source_targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("max_repeats") > 0))
    return {r["source"]: (float(r["s"]), int(r["m"])) for r in good.groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()}


def _odds(sized: DataFrame, rest: dict[str, int]) -> dict[str, float]:
    """c of each source with a rest: sum of min(1, c * w / UNIT) * tokens is the rest. A round is one aggregate to a row per source; each adds certain documents until none is new."""
    spark = sized.sparkSession
    certain = {s: 0 for s, r in rest.items() if r > 0}
    c = dict.fromkeys(certain, 0.0)
    todo = set(certain)
    while todo:
        now = spark.createDataFrame([(s, c[s]) for s in sorted(todo)], "source string, _c double")
        sure = F.col("_c") * F.col("w") >= UNIT
        sums = sized.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.when(sure, F.col("tokens")).otherwise(0)).alias("a"), F.sum(F.when(sure, F.lit(0)).otherwise(F.col("w").cast("decimal(20,0)") * F.col("tokens").cast("decimal(18,0)"))).alias("b"))
        for r in sums.collect():
            s, a, b = r["source"], int(r["a"]), int(r["b"])
            if (c[s] > 0 and a == certain[s]) or b == 0:
                todo.discard(s)
            else:
                certain[s], c[s] = a, (rest[s] - a) * UNIT / b
    return c


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(documents: DataFrame, source_targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = TOKENIZER, seed: str = "mix-1") -> Mixture:
    """How often each training document with text enters the mixture (0 included), and the plan by source.

    Sources of source_targets only. Empty texts are used 0 times. Quality that is null, NaN or outside 0..1 counts as 0.5.
    total_tokens: see the module's text; above all that may be given, everything is given. A source named in source_targets
    without training text gives nothing. Repeated rows of a document are used as one by one; of repeated sources in
    source_targets the largest share and repeats hold. Null or non-positive shares and repeats: the source gives nothing.
    Empty tables give no rows. source_targets has a fixed number of rows, which with their sums and bins reach the driver.
    """
    spark = documents.sparkSession
    targets = _targets(source_targets)
    names = spark.createDataFrame([(s,) for s in sorted(targets)], "source string")
    train = documents.where((F.col("split") == "train") & F.col("text").isNotNull()).join(F.broadcast(names), "source", "left_semi")
    quality = F.when((F.col("quality") >= 0) & (F.col("quality") <= 1), F.col("quality")).otherwise(F.lit(0.5))
    w = F.round((F.lit(0.25) + F.lit(0.75) * quality) * UNIT).cast("long")
    sized = cut_lineage(token_counts(train, tokenizer).select("doc_id", "source", "tokens", "bytes", w.alias("w"), unit_hash(F.lit(seed), F.col("source"), F.col("doc_id")).alias("u")))
    size = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect() if r["t"]}
    owed = owed_tokens(size, {s: targets[s][0] for s in size}, {s: targets[s][1] for s in size}, total_tokens)
    copies = {s: min(targets[s][1], int(x / size[s] + 1e-12)) for s, x in owed.items()}
    rest = {s: max(0, int(owed[s] - copies[s] * size[s] + 0.5)) if copies[s] < targets[s][1] else 0 for s in owed}
    c = _odds(sized, rest)
    plan = spark.createDataFrame([(s, t, m, size.get(s, 0), float(sum(owed.values())), owed.get(s, 0.0), copies.get(s, 0), rest.get(s, 0), c.get(s, 0.0)) for s, (t, m) in sorted(targets.items())], PLAN)
    p, x = F.least(F.lit(1.0), F.col("c") * F.col("w") / UNIT), F.col("u")
    # Pareto's ranking variable q = u/(1-u) * (1-p)/p as q/(1+q), which lies in [0, 1] and keeps the order.
    rank = F.when(p >= 1, F.lit(0.0)).otherwise(x * (1 - p) / (x * (1 - p) + (1 - x) * p))
    ranked = sized.join(F.broadcast(plan.select("source", "copies", "c")), "source").withColumn("_rank", rank)
    cut = refine(spark, ranked.where("tokens > 0"), F.col("source"), F.col("_rank"), 0.0, 1.0, lambda g, n, t: rest[g], weight=F.col("tokens"), groups=sorted(c), descending=False)
    edge = {}
    for s, at in cut.items():
        over, short = at["kept_w"] - rest[s], rest[s] - (at["kept_w"] - at["at_w"])
        edge[s] = at["cutoff"] if over <= short else float(np.nextafter(at["cutoff"], -1.0))
    edges = spark.createDataFrame(sorted(edge.items()), "source string, _edge double")
    uses = F.col("copies") + F.coalesce(F.col("_rank") <= F.col("_edge"), F.lit(False)).cast("int")
    used = ranked.join(F.broadcast(edges), "source", "left").select("doc_id", "source", "tokens", "bytes", F.when(F.col("tokens") > 0, uses).otherwise(F.lit(0)).cast("int").alias("uses"))
    return Mixture(used, plan)
