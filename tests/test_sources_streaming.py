"""Readers, writers and streams on small files."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grainmill.sources import files as S
from grainmill.streaming import ingest


def test_json_lines_round_trip_and_missing_path(spark, tmp_path):
    df = spark.createDataFrame([(2, "b é", [1, 2]), (1, None, [])], "id long, t string, a array<int>")
    S.write_jsonl(df, str(tmp_path / "x"), ["id"], files=1)
    lines = [r.value for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert lines == ['{"a":[],"id":1,"t":null}', '{"a":[1,2],"id":2,"t":"b é"}']
    assert S.read_jsonl(spark, str(tmp_path / "x"), df.schema).count() == 2
    S.append_jsonl(df, str(tmp_path / "x"))
    assert S.read_jsonl(spark, str(tmp_path / "x"), df.schema).count() == 4
    assert S.read_jsonl(spark, str(tmp_path / "none"), df.schema).count() == 0
    with pytest.raises(Exception):
        S.write_jsonl(df, str(tmp_path / "x"), ["id"])


def test_csv_text_vocabulary_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    S.write_csv(df, str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c"), "a int, b double").collect() == df.collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "hi.md").write_text("नमस्ते\nx")
    assert [tuple(r) for r in S.read_corpus_texts(spark, str(tmp_path / "t")).collect()] == [("hi", "नमस्ते\nx")]
    (tmp_path / "v.json").write_text('{\n "vocab": ["a", "é"]}')
    assert [(r.token_id, bytes(r.bytes)) for r in S.read_vocabulary(spark, str(tmp_path / "v.json")).collect()] == [(0, b"a"), (1, "é".encode())]
    import hashlib

    h = S.file_hashes(spark, str(tmp_path / "t")).collect()
    assert h[0].sha256 == hashlib.sha256("नमस्ते\nx".encode()).hexdigest()
    assert S.missing(spark, [str(tmp_path / "t"), str(tmp_path / "zz")]) == [str(tmp_path / "zz")]


def test_shards_publish_report(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("split"), F.col("id").alias("doc_id"))
    S.write_shards(df, str(tmp_path / "s"), ["split"], ["doc_id"])
    assert S.load_tokens(spark, str(tmp_path / "s")).count() == 100
    with pytest.raises(Exception):
        S.write_shards(df, str(tmp_path / "s"), ["split"], ["doc_id"])
    (tmp_path / "live").mkdir()
    S.publish(spark, str(tmp_path / "s"), str(tmp_path / "live"))
    assert S.load_tokens(spark, str(tmp_path / "live")).count() == 100 and not (tmp_path / "s").exists()
    S.report(df.limit(2), "Two", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().startswith("# Two")
    with pytest.raises(ValueError):
        S.report(df, "Many", str(tmp_path / "r2.md"), most=5)


def texts(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7 + 1)) for i in range(400)], "doc_id long, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return df


def feed(df, sink, checkpoint):
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_budget_is_one_and_kept_across_a_restart(spark, tmp_path):
    df = texts(spark, tmp_path)
    sink = ingest.Budgeted(spark, str(tmp_path / "out"), {"train": 500, "validation": 10})
    stream = lambda: ingest.file_stream(spark, str(tmp_path / "in"), df.schema)
    feed(stream(), sink, str(tmp_path / "ck"))
    before = sorted(map(tuple, sink.read().collect()))
    feed(stream(), sink, str(tmp_path / "ck"))
    assert sorted(map(tuple, sink.read().collect())) == before
    per = {r.part: (r.s, r.u) for r in sink.read().groupBy("part").agg(F.sum("taken").alias("s"), F.max("used").alias("u")).collect()}
    held = df.where((F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100) < 2).agg(F.sum(F.length("text") + 1)).first()[0] or 0
    assert per["train"] == (500, 500) and per.get("validation", (0, 0))[0] == min(10, held)
    assert sink.read().groupBy("doc_id").count().where("count > 1").count() == 0
    # A batch that is sent again replaces itself.
    sink(df, 0)
    assert sink.read().where("batch = 0").agg(F.sum("taken")).first()[0] <= 510


CRASH = """
import os, sys
sys.path.insert(0, sys.argv[1])
from grainmill.session import local_session
from grainmill.streaming import ingest
spark = local_session(2, shuffle_partitions=2, memory="1g")
book, stream = ingest.Ledger(spark, sys.argv[3]), ingest.file_stream(spark, sys.argv[2], "doc_id long, text string")
def sink(df, batch):
    book.append(df, batch)
    if batch == 1:
        os._exit(86)
stream.writeStream.foreachBatch(sink).option("checkpointLocation", sys.argv[4]).trigger(availableNow=True).start().awaitTermination()
"""


def test_a_crash_between_batches_is_resumed_without_skip_or_repeat(spark, tmp_path):
    """The process dies behind the second batch's record and before its commit; a fresh one goes on with the next batch."""
    root = str(Path(__file__).resolve().parent.parent)
    df = texts(spark, tmp_path)
    book, ck = ingest.Ledger(spark, str(tmp_path / "book")), str(tmp_path / "ck")
    died = subprocess.run([sys.executable, "-c", CRASH, root, str(tmp_path / "in"), str(tmp_path / "book"), ck], capture_output=True, timeout=120)
    assert died.returncode == 86 and book.head()[0] == 1 and book.agrees_with(ck)
    feed(ingest.file_stream(spark, str(tmp_path / "in"), df.schema), book.append, ck)
    whole = ingest.Ledger(spark, str(tmp_path / "whole"))
    feed(ingest.file_stream(spark, str(tmp_path / "in"), df.schema), whole.append, str(tmp_path / "ck2"))
    rows = lambda b: [tuple(r) for r in b.read().orderBy("batch").collect()]
    assert rows(book) == rows(whole) and book.broken() == 0 and book.head()[0] == 3 and book.agrees_with(ck)
    assert not ingest.Ledger(spark, str(tmp_path / "empty")).agrees_with(ck)


def test_a_fork_continues_its_parent_with_another_mixture(spark, tmp_path):
    parent = ingest.Ledger(spark, str(tmp_path / "parent"))
    mix = lambda k: spark.range(100).where(F.col("id") % 5 >= k)
    for k in range(4):
        parent.append(mix(1), k)
    child = parent.fork(str(tmp_path / "child"), 1)
    assert child.head() == (1, parent.read().where("batch = 1").first()["record_hash"])
    for k in (2, 3):
        child.append(mix(3), k)
    a, b = ({r.batch: r.record_hash for r in x.read().collect()} for x in (parent, child))
    assert [a[k] == b[k] for k in range(4)] == [True, True, False, False] and child.broken() == parent.broken() == 0
    for path, at in ((str(tmp_path / "child"), 1), (str(tmp_path / "other"), 9)):
        with pytest.raises(ValueError):
            parent.fork(path, at)


def test_an_evaluation_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    spark.range(10).write.parquet(path)
    assert S.without_change(path, lambda: spark.read.parquet(path).count()) == 10
    with pytest.raises(RuntimeError):
        S.without_change(path, lambda: spark.range(1).write.mode("append").parquet(path))


def test_object_sink_log_and_merges(spark, tmp_path):
    S.write_json({"b": [1, "é"], "a": None}, str(tmp_path / "o" / "x.json"))
    assert (tmp_path / "o" / "x.json").read_text() == '{\n  "a": null,\n  "b": [\n    1,\n    "é"\n  ]\n}\n' and not list((tmp_path / "o").glob("*.tmp"))
    log = S.RunLog(str(tmp_path / "l" / "run.log"), echo=False)
    log.log("packed", "12 batches", "PASS")
    log.log("done")
    assert (tmp_path / "l" / "run.log").read_text() == "[PASS] packed | 12 batches\ndone\n"
    assert log.listener() is not None
    (tmp_path / "v.json").write_text('{"merges": ["a b", "ab c"]}')
    assert [tuple(r) for r in S.read_merges(spark, str(tmp_path / "v.json")).collect()] == [(0, "a", "b"), (1, "ab", "c")]


def test_protocols_have_an_implementation(spark, tmp_path):
    from grainmill.operators import policies as O

    store = O.ParquetCheckpoints(spark, str(tmp_path / "states"))
    assert isinstance(store, O.Checkpoints)
    store.save("step-4", spark.range(3))
    assert store.load("step-4").count() == 3
    with pytest.raises(Exception):
        store.save("step-4", spark.range(3))
    stage = O.Stage.from_mapping({"name": "s", "index": 0, "weights": {"a": 0.25, "b": 0.75}})
    assert stage.rows() == [("s", 0, "a", 0.25), ("s", 0, "b", 0.75)]
    docs = spark.createDataFrame([("x", i, i, "a", 0, 0.5, [1, 2, 3, i]) for i in range(6)], "shard_id string, row_id int, doc_id long, lane string, min_stage int, quality double, tokens array<int>")
    proxy = spark.createDataFrame([("p", 0, [1, 2, 3])], "shard_id string, row_id int, tokens array<int>")
    need = spark.createDataFrame([], "stage_index int, lane string, need long")
    selector = O.AlignmentSelector(proxy, spark.createDataFrame([("s", 0)], "stage string, stage_index int"), need)
    assert isinstance(selector, O.Selector)
    out = selector.select(docs).toPandas()
    assert sorted(out.base_decision) == sorted(["accepted"] * 3 + ["deferred"] * 2 + ["rejected"])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from grainmill.session import ensure_checkpoint_dir

    undefined = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(_jsc=undefined, getConf=lambda: conf, master=master)))


def test_ledger_is_idempotent_and_exact(spark, tmp_path):
    book = ingest.Ledger(spark, str(tmp_path / "book"))
    df = spark.range(10)
    for k in (0, 0, 1, 1, 2):
        book.append(df.where(F.col("id") >= k), k)
    assert book.read().count() == 3 and book.broken() == 0
    with pytest.raises(ValueError):
        book.append(df, 5)
    forged = book.read().where("batch = 1").withColumn("records", F.lit(99).cast("long")).collect()
    spark.createDataFrame(forged, book.read().schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "book" / "batch=000000000001.parquet"))
    assert book.broken() == 1


def test_stream_and_batch_windows_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "e"))
    stream = ingest.file_stream(spark, str(tmp_path / "e"), events.schema)
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("tumble").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): r.n for r in spark.table("tumble").collect()}
    assert got == {(r.window_start, r.event_type): r.n for r in ingest.tumbling(events).collect()}
    d = ingest.deduplicated(ingest.file_stream(spark, str(tmp_path / "e"), events.schema))
    ingest.run_to_end(ingest.enriched(d, spark.createDataFrame([("click", 1)], "event_type string, w int"), "event_type"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == events.select("event_id").distinct().count()
