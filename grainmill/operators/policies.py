"""Surfaces for extension: tokenizers, packing policies by lane, selectors, checkpoints; and chunking as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import binpack
from .mixture import alignment, decide


@runtime_checkable
class Tokenizer(Protocol):
    """Columns of text to columns of token ids and back."""

    def encode(self, text: Column) -> Column: ...

    def decode(self, tokens: Column) -> Column: ...


class ByteTokenizer:
    """UTF-8 bytes behind three special tokens."""

    pad, bos, eos, vocabulary = T.PAD, T.BOS, T.EOS, 256 + T.BYTE_OFFSET

    def encode(self, text: Column) -> Column:
        return T.byte_tokens(text)

    def decode(self, tokens: Column) -> Column:
        return T.byte_text(tokens)


@runtime_checkable
class Selector(Protocol):
    """Documents to decisions."""

    def select(self, documents: DataFrame) -> DataFrame: ...


@runtime_checkable
class Book(Protocol):
    """A ledger: read it, append a batch, count what is broken."""

    def read(self) -> DataFrame: ...

    def append(self, df: DataFrame, batch: int) -> None: ...

    def broken(self) -> int: ...


class AlignmentSelector:
    """Decisions by gradient alignment with a proxy: documents with doc_id, lane, min_stage, quality and tokens' row keys to decisions of each stage."""

    def __init__(self, proxy: DataFrame, stages: DataFrame, required: DataFrame, prefix: int = 16):
        self.proxy, self.stages, self.required, self.prefix = proxy, stages, required, prefix

    def select(self, documents: DataFrame) -> DataFrame:
        scored = alignment(documents, self.proxy, self.prefix).drop("shard_id", "row_id", "tokens")
        return decide(scored, self.stages, self.required)


@runtime_checkable
class Checkpoints(Protocol):
    """Named states: save one, load it."""

    def save(self, name: str, state: DataFrame) -> str: ...

    def load(self, name: str) -> DataFrame: ...


class ParquetCheckpoints:
    """States as Parquet directories below a folder; a name is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, state: DataFrame) -> str:
        at = f"{self.path}/{name}.parquet"
        state.write.mode("errorifexists").parquet(at)
        return at

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Stage:
    """A curriculum stage: configuration, with the weights of its lanes."""

    name: str
    index: int
    weights: dict[str, float]

    @classmethod
    def from_mapping(cls, value: Mapping[str, object]) -> Stage:
        return cls(str(value["name"]), int(value["index"]), dict(value["weights"]))  # type: ignore[call-overload]

    def rows(self) -> list[tuple[str, int, str, float]]:
        """stage, stage_index, lane, weight: the rows of a table of stages."""
        return [(self.name, self.index, lane, float(w)) for lane, w in self.weights.items()]


def _structure(chunked: DataFrame, by: str, order: str, length: int) -> DataFrame:
    return chunked.groupBy(by).agg(F.count("*").alias("bins"), F.sum(F.col("token_end") - F.col("token_start") + binpack.FRAME).alias("non_pad"))


POLICIES: dict[str, Callable[[DataFrame, str, str, int], DataFrame]] = {
    "best_fit": lambda c, by, order, length: binpack.best_fit(c, by, length),
    "greedy": binpack.next_fit,
    "structure_preserving": _structure,
}
# The policy of each lane; any other lane has the default.
BY_LANE = {"general_web": "best_fit", "indic": "best_fit", "agentic": "structure_preserving"}
DEFAULT = "greedy"


def policy_for(lane: str | None, by_lane: dict[str, str] | None = None, default: str = DEFAULT) -> str:
    """The policy of a lane; an unknown policy raises ValueError."""
    policy = (BY_LANE if by_lane is None else by_lane).get(lane, default)
    if policy not in POLICIES:
        raise ValueError(f"unknown packing policy {policy}")
    return policy


def pack_by_policy(chunked: DataFrame, length: int, by_lane: dict[str, str] | None = None, default: str = DEFAULT) -> DataFrame:
    """lane, policy, bins, non_pad: every lane packed by its own policy."""
    lanes = BY_LANE if by_lane is None else by_lane
    policy_for(None, lanes, default)
    named = F.lit(default)
    for lane in lanes:
        named = F.when(F.col("lane") == lane, policy_for(lane, lanes, default)).otherwise(named)
    out = None
    for policy, pack in POLICIES.items():
        part = pack(chunked.where(named == policy), "lane", "doc_id", length).select("lane", F.lit(policy).alias("policy"), F.col("bins").cast("long").alias("bins"), F.col("non_pad").cast("long").alias("non_pad"))
        out = part if out is None else out.unionByName(part)
    return out


@F.udtf(returnType="token_start int, token_end int")
class ChunkBounds:
    """SELECT * FROM chunk_bounds(n_tokens, length): the windows of a row."""

    def eval(self, n: int, length: int) -> Iterator[tuple[int, int]]:
        for s in range(0, n or 0, length - binpack.FRAME):
            yield s, min(s + length - binpack.FRAME, n)
