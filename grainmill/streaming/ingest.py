"""Structured Streaming: budgeted ingest, an exactly-continuing ledger, event-time windows.

Event-time windows, sessions and deduplication are additions of this engine; budgets and ledgers have batch twins among the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket
from ..operators.ledger import GENESIS
from ..operators.running import running_sum

def file_stream(spark: SparkSession, path: str, schema: object, files: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class Budgeted:
    """For foreachBatch: token counts of texts up to one budget a part (train, validation by hash of the id), an end token each.

    What earlier batches took is read from the output, so a part's budget is one, whatever the order of files; within a
    batch texts are taken by id, with running sums over range partitions. A batch is written under its number: one that is
    sent again after a failure replaces itself and counts what only earlier ones took.
    """

    def __init__(self, spark: SparkSession, path: str, budgets: dict[str, int]):
        self.spark, self.path, self.budgets = spark, path, budgets

    def read(self) -> DataFrame:
        schema = "batch long, part string, doc_id long, taken long, used long"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/*") if there else self.spark.createDataFrame([], schema)

    def __call__(self, documents: DataFrame, batch: int) -> None:
        used = {r["part"]: r["n"] for r in self.read().where(F.col("batch") < batch).groupBy("part").agg(F.sum("taken").alias("n")).collect()}
        left = {p: n - used.get(p, 0) for p, n in self.budgets.items()}
        part = F.when(hash_bucket(F.col("doc_id").cast("string"), 100) < 2, "validation").otherwise("train")
        rows = documents.where(F.col("text").rlike("\\S")).select(part.alias("part"), "doc_id", (F.octet_length("text") + 1).cast("long").alias("n")).where(F.col("part").isin([p for p, n in left.items() if n > 0]))
        budget = F.create_map(*[F.lit(x) for p, n in left.items() for x in (p, n)])[F.col("part")]
        before = F.create_map(*[F.lit(x) for p in left for x in (p, used.get(p, 0))])[F.col("part")]
        taken = running_sum(rows, ["part"], "doc_id", "n", "before").where(F.col("before") < budget)
        out = taken.select(F.lit(batch).cast("long").alias("batch"), "part", "doc_id", F.least("n", budget - F.col("before")).alias("taken"), (before + F.least(F.col("before") + F.col("n"), budget)).alias("used"))
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch:012d}.parquet")


class Ledger:
    """An append-only ledger of micro-batches as a Parquet directory per batch: idempotent by batch number, chained by hash."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = "batch long, records long, content string, previous_hash string, record_hash string"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/*") if there else self.spark.createDataFrame([], schema)

    def head(self) -> tuple[int, str]:
        last = self.read().orderBy(F.desc("batch")).limit(1).collect()
        return (last[0]["batch"], last[0]["record_hash"]) if last else (-1, GENESIS)

    def append(self, df: DataFrame, batch: int) -> None:
        """For foreachBatch. A batch that is there already is left; one that does not continue the ledger raises ValueError."""
        number, head = self.head()
        if batch <= number:
            return
        if batch != number + 1:
            raise ValueError(f"batch {batch} does not follow {number}")
        # An order-free digest: sums of two independent hashes of whole rows, combined before any shuffle.
        rows = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("a"), F.hash(*df.columns).cast("decimal(38,0)").alias("b"))
        one = rows.agg(F.count("*").alias("records"), F.concat_ws(":", F.coalesce(F.sum("a"), F.lit(0)).cast("string"), F.coalesce(F.sum("b"), F.lit(0)).cast("string")).alias("content"))
        record = one.select(F.lit(batch).cast("long").alias("batch"), "records", "content", F.lit(head).alias("previous_hash"))
        record = record.withColumn("record_hash", F.sha2(F.concat_ws("|", "previous_hash", "batch", "records", "content"), 256))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch:012d}.parquet")

    def broken(self) -> int:
        """Records that do not hold or do not follow: every link is checked by itself."""
        before = F.lag("record_hash", 1, GENESIS).over(Window.orderBy("batch"))
        own = F.sha2(F.concat_ws("|", "previous_hash", F.col("batch").cast("string"), F.col("records").cast("string"), "content"), 256)
        # A row per micro-batch; its predecessor is one place before it.
        return self.read().withColumn("_before", before).where((F.col("previous_hash") != F.col("_before")) | (F.col("record_hash") != own)).count()

    def fork(self, path: str, batch: int) -> Ledger:
        """A new ledger with this one's records up to a batch: what is appended to it continues from there. ValueError if the batch is not there, or the new one is."""
        fresh = Ledger(self.spark, path)
        if batch > self.head()[0] or fresh.head()[0] >= 0:
            raise ValueError(f"cannot fork at batch {batch}")
        for r in range(batch + 1):
            self.spark.read.parquet(f"{self.path}/batch={r:012d}.parquet").coalesce(1).write.parquet(f"{path}/batch={r:012d}.parquet")
        return fresh

    def agrees_with(self, checkpoint: str) -> bool:
        """Whether the ledger ends where a streaming checkpoint does: at its last committed batch, or at one more whose commit was lost with the process."""
        jvm = self.spark._jvm
        commits = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
        fs = commits.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(commits)] if fs.exists(commits) else []
        last = max((int(n) for n in names if n.isdigit()), default=-1)
        return self.head()[0] in (last, last + 1)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; events later than the watermark are left out."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.dropDuplicatesWithinWatermark(["event_id"])


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table."""
    return events.join(static, key, "left")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Read what is there, write it as Parquet, stop; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
