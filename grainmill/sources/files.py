"""Readers and writers: JSON, JSON lines, CSV, text, binary, content-addressed shards, token caches."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.hashing import canonical_json


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON objects."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; a missing path is an empty table, blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON line a row, in a column `value`."""
    names = df.columns

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"value": [canonical_json(_plain(dict(zip(names, row)))) for row in pdf.itertuples(index=False, name=None)]})

    return df.mapInPandas(part, "value string")


def _plain(v: object) -> object:
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return None if isinstance(v, float) and v != v else v


def write_jsonl(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Canonical JSON lines, sorted within files; Spark's commit protocol makes the write all or nothing."""
    out = df.repartitionByRange(files, *order) if files else df
    canonical_lines(out.sortWithinPartitions(*order)).write.mode("errorifexists").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Canonical JSON lines behind those that are there; a job that fails adds none."""
    canonical_lines(df).write.mode("append").text(path)


def write_json(value: object, path: str) -> None:
    """One object with sorted keys, indented; a reader sees the old file or the new one, never a part."""
    _replace(path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def _replace(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fresh = f"{path}.tmp"
    with open(fresh, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(fresh, path)


class RunLog:
    """A log of events, a line each: [STATUS] event | message; on disk before `log` returns, and printed."""

    def __init__(self, path: str, echo: bool = True):
        self.path, self.echo = path, echo
        Path(path).parent.mkdir(parents=True, exist_ok=True)

    def log(self, event: str, message: str = "", status: str | None = None) -> str:
        line = " | ".join(x for x in (f"[{status}] {event}" if status else event, message) if x)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
            f.flush()
            os.fsync(f.fileno())
        if self.echo:
            print(line, flush=True)
        return line

    def listener(self) -> StreamingQueryListener:
        """A listener that logs each micro-batch and each end of a streaming query."""
        log = self.log

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                log("stream started", str(event.id))

            def onQueryProgress(self, event):
                log("batch", f"{event.progress.batchId}: {event.progress.numInputRows} rows")

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                log("stream ended", str(event.id), "FAIL" if event.exception else "PASS")

        return Listener()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """language, text of files named {language}.md or {language}.txt, read whole."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:md|txt)$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("language"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file below a path. A task reads its files by blocks, so their size does not matter."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in it:
            hashes = []
            for name in pdf["path"]:
                where = unquote(name) if name.startswith("file:") else name
                system, at = fs.FileSystem.from_uri(where if "://" in where else where.replace("file:", "file://", 1))
                h = hashlib.sha256()
                with system.open_input_stream(at) as stream:
                    while block := stream.read(1 << 20):
                        h.update(block)
                hashes.append(h.hexdigest())
            yield pdf.assign(sha256=hashes)

    return names.mapInPandas(part, "path string, length long, sha256 string")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token, bytes of a tokenizer file with a `vocab` array."""
    return read_json(spark, path, "vocab array<string>").select(F.posexplode("vocab").alias("token_id", "token")).withColumn("bytes", F.encode("token", "UTF-8"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """rank, left, right of a tokenizer file with a `merges` array of 'left right'."""
    pair = F.split("merge", " ", 2)
    return read_json(spark, path, "merges array<string>").select(F.posexplode("merges").alias("rank", "merge")).select("rank", pair[0].alias("left"), pair[1].alias("right"))


def write_shards(rows: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Rows as Parquet, a directory for each value of `by`, sorted within files; refuses to overwrite.

    A large directory is spread over several files by its order key, so no value of `by` meets in one task.
    """
    rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.mode("errorifexists").partitionBy(*by).parquet(path)


def save_tokens(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish(spark: SparkSession, staging: str, target: str) -> None:
    """Swap a finished directory into place: the old one is moved aside first and removed last."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (staging, target, target.rstrip("/") + ".old"))
    fs = b.getFileSystem(conf)
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(b):
        fs.rename(b, old)
    if not fs.rename(a, b):
        if fs.exists(old):
            fs.rename(old, b)
        raise OSError(f"cannot publish {staging}")
    fs.delete(old, True)


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Which of the required paths do not exist."""
    return [p for p in paths if not _exists(spark, p)]


def report(df: DataFrame, title: str, path: str, most: int = 1000) -> None:
    """A small table as a Markdown file; raises ValueError beyond `most` rows, as reports are for reading."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("—" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r) + " |" for r in rows]
    _replace(path, "\n".join(lines) + "\n")


def folder_state(path: str) -> str:
    """One hash over the names and contents of a local folder's files."""
    h = hashlib.sha256()
    for p in sorted(x for x in Path(path).rglob("*") if x.is_file()):
        h.update(str(p.relative_to(path)).encode() + b"\0" + hashlib.sha256(p.read_bytes()).digest())
    return h.hexdigest()


def without_change(path: str, evaluate: Callable[[], object]) -> object:
    """What `evaluate` returns; raises RuntimeError if the folder that it reads differs afterwards."""
    before = folder_state(path)
    result = evaluate()
    if folder_state(path) != before:
        raise RuntimeError(f"{path} was changed by an evaluation")
    return result
