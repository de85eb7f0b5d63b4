"""Queries that must do the whole job: every lane, place, order, file and vector."""

import hashlib
from pathlib import Path

import pytest
from oracle import connect

from grainmill.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_trace_has_every_place_of_every_step(spark, con, sf_dir):
    places = con.execute("SELECT sum(packed_end - packed_start)::BIGINT FROM (SELECT DISTINCT ON (span_id) * FROM source_spans ORDER BY span_id, arrived_at DESC)").fetchall()[0][0]
    assert QUERIES["token_source_trace"](spark, sf_dir).count() == places


def test_token_rows_of_every_lane(spark, con, sf_dir):
    lanes = {r[0] for r in con.execute("SELECT DISTINCT lane FROM shard_rows WHERE len(tokens) > 0").fetchall()}
    rows = QUERIES["chunk_rows"](spark, sf_dir).select("shard_id", "row_id").distinct()
    assert {r.lane for r in rows.join(spark.read.parquet(f"{sf_dir}/shard_rows.parquet"), ["shard_id", "row_id"]).select("lane").distinct().collect()} == lanes


def test_every_data_file_is_hashed(spark, sf_dir):
    got = {(r["name"], r["length"], r["sha256"]) for r in QUERIES["file_content_hash"](spark, sf_dir).collect()}
    files = [p for p in Path(sf_dir).rglob("*") if p.is_file() and p.name[0] not in "._"]
    assert got == {(str(p.relative_to(sf_dir)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files}


def test_every_order_is_padded_to_the_longest(spark, con, sf_dir):
    longest, orders = con.execute("SELECT max(n)::INTEGER, count(*) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)").fetchall()[0]
    assert longest > 7
    got = QUERIES["pad_ragged"](spark, sf_dir).collect()
    assert len(got) == orders and {len(r["padded"].split(",")) for r in got} == {longest}


def test_cosine_meets_every_vector(spark, con, sf_dir):
    vectors, queries = con.execute("SELECT count(*), count(*) FILTER (WHERE vec_id % 50 = 0) FROM embeddings").fetchall()[0]
    assert QUERIES["cosine"](spark, sf_dir).count() == vectors * queries
