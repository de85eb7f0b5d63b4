"""Corpus queries: ids, shards and manifests, splits, firewalls, samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket
from ..operators.corpus import delivered, first_ranked, shard_manifest
from .base import Plans, Tables

P = Plans()
_DELIVERED = "(SELECT DISTINCT ON (shard_id, row_id) * FROM shard_rows ORDER BY shard_id, row_id, written_at DESC)"


@P.query("SELECT doc_id, count(*) AS copies FROM documents GROUP BY doc_id HAVING count(*) > 1")
def doc_id_uniqueness(t: Tables) -> DataFrame:
    """Repeated ids; no row means that ids are unique."""
    return t.documents.groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1")


_MANIFEST = f"""
    SELECT shard_id, count(*) AS document_count, sum(coalesce(len(tokens), 0))::BIGINT AS token_count, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
      sha256(coalesce(string_agg(coalesce(cleaned_content_hash, ''), '' ORDER BY row_id), '')) AS content_hash
    FROM {_DELIVERED} GROUP BY shard_id
"""


def _rows(t: Tables, *columns: str) -> DataFrame:
    return delivered(t.shard_rows, *columns)


@P.query(_MANIFEST)
def build_shard_manifest(t: Tables) -> DataFrame:
    return shard_manifest(_rows(t, "tokens", "language", "cleaned_content_hash"), ["shard_id"])


@P.query(f"""
    WITH m AS ({_MANIFEST}) SELECT coalesce(i.shard_id, m.shard_id) AS shard_id, i.document_count AS claimed_documents, m.document_count AS found_documents, i.token_count AS claimed_tokens, m.token_count AS found_tokens
    FROM shard_index i FULL JOIN m ON i.shard_id = m.shard_id WHERE i.document_count IS DISTINCT FROM m.document_count OR i.token_count IS DISTINCT FROM m.token_count
""")
def validate_manifest(t: Tables) -> DataFrame:
    """Shards whose manifest disagrees with their rows, either way round."""
    found = _rows(t, "tokens").groupBy("shard_id").agg(F.count("*").alias("found_documents"), F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("found_tokens"))
    claims = t.shard_index.select("shard_id", F.col("document_count").alias("claimed_documents"), F.col("token_count").alias("claimed_tokens"))
    both = claims.join(found, "shard_id", "full")
    return both.where(~F.col("claimed_documents").eqNullSafe(F.col("found_documents")) | ~F.col("claimed_tokens").eqNullSafe(F.col("found_tokens")))


@P.query(f"""
    WITH m AS ({_MANIFEST}), k AS (SELECT shard_id, bool_and(coalesce(list_max(tokens) <= 258 AND list_min(tokens) >= 0, true)) AS tokens_known, count(cleaned_content_hash) = count(*) AS cleaned FROM {_DELIVERED} GROUP BY shard_id)
    SELECT i.shard_id, m.document_count IS NOT DISTINCT FROM i.document_count AND m.token_count IS NOT DISTINCT FROM i.token_count AS counts_ok, m.content_hash IS NOT DISTINCT FROM i.content_hash AS content_ok,
      coalesce(tokens_known, false) AS tokenizer_ok, coalesce(cleaned, false) AS cleaning_ok, i.shard_path IS NOT NULL AS path_ok
    FROM shard_index i LEFT JOIN m ON i.shard_id = m.shard_id LEFT JOIN k ON i.shard_id = k.shard_id
""")
def manifest_integrity(t: Tables) -> DataFrame:
    """What holds of each manifest: counts, content hash, tokens of the vocabulary, hashes of cleaned contents, a path."""
    rows = _rows(t, "tokens", "language", "cleaned_content_hash")
    known = F.coalesce((F.array_max("tokens") <= 258) & (F.array_min("tokens") >= 0), F.lit(True))
    found = shard_manifest(rows, ["shard_id"]).select("shard_id", F.col("document_count").alias("d"), F.col("token_count").alias("n"), F.col("content_hash").alias("h"))
    state = rows.groupBy("shard_id").agg(F.bool_and(known).alias("k"), (F.count("cleaned_content_hash") == F.count("*")).alias("c"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return t.shard_index.join(found, "shard_id", "left").join(state, "shard_id", "left").select(
        "shard_id", (same("d", "document_count") & same("n", "token_count")).alias("counts_ok"), same("h", "content_hash").alias("content_ok"), F.coalesce("k", F.lit(False)).alias("tokenizer_ok"), F.coalesce("c", F.lit(False)).alias("cleaning_ok"), F.col("shard_path").isNotNull().alias("path_ok")
    )


@P.query("SELECT doc_id, split, lane FROM documents WHERE split IN ('validation', 'eval')")
def split_filter(t: Tables) -> DataFrame:
    return t.documents.where(F.col("split").isin("validation", "eval")).select("doc_id", "split", "lane")


@P.query("SELECT doc_id, split FROM documents WHERE split IS DISTINCT FROM 'train'")
def firewall_blocked(t: Tables) -> DataFrame:
    return t.documents.where(~F.col("split").eqNullSafe("train")).select("doc_id", "split")


@P.query("SELECT shard_id, count(*) AS blocked_rows FROM shard_rows WHERE regexp_matches(shard_id, '^(eval|validation|selection_proxy)-') GROUP BY shard_id")
def firewall_shard_prefix(t: Tables) -> DataFrame:
    return t.shard_rows.where(F.col("shard_id").rlike("^(eval|validation|selection_proxy)-")).groupBy("shard_id").agg(F.count("*").alias("blocked_rows"))


_BUCKET = "(('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 100)::INTEGER"


@P.query(f"SELECT doc_id, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 2 THEN 'validation' ELSE 'train' END AS part FROM documents WHERE regexp_matches(text, '[^ \\n\\t\\r]')")
def hash_split(t: Tables) -> DataFrame:
    """Two in a hundred ids to validation, by sha256; blank texts are skipped."""
    b = hash_bucket(F.col("doc_id").cast("string"), 100)
    return t.documents.where(F.col("text").rlike("[^ \\n\\t\\r]")).select("doc_id", b.alias("bucket"), F.when(b < 2, "validation").otherwise("train").alias("part"))


@P.query("""
    WITH l AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, floor(n * 0.8::DOUBLE)::INTEGER AS train_end, floor(n * 0.9::DOUBLE)::INTEGER AS validation_end, sha256(substring(text, 1, floor(n * 0.8::DOUBLE)::INTEGER)) AS train_hash FROM l
""")
def contiguous_split(t: Tables) -> DataFrame:
    """80/10/10 by characters."""
    n = F.length("text")
    a, b = F.floor(n * F.lit(0.8)).cast("int"), F.floor(n * F.lit(0.9)).cast("int")
    return t.documents.where("text is not null").select("doc_id", a.alias("train_end"), b.alias("validation_end"), F.sha2(F.substr("text", F.lit(1), a), 256).alias("train_hash"))


@P.query("""
    WITH b AS (SELECT p_partkey, p_size // 10 AS bucket, sha256('split' || p_partkey::VARCHAR) AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM b)
    SELECT p_partkey, bucket::INTEGER AS bucket, CASE WHEN k <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM r
""")
def stratified_split(t: Tables) -> DataFrame:
    """At least one, else a fifth, of each size class to test, in hash order. Ranks are taken per class and hash sector, so no class meets in one task."""
    b = t.part.select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("bucket"), F.sha2(F.concat(F.lit("split"), F.col("p_partkey").cast("string")), 256).alias("h"))
    sector = F.substring("h", 1, 2)
    counts = b.groupBy("bucket", sector.alias("s")).count()
    w = Window.partitionBy("bucket").orderBy("s")
    before = counts.select("bucket", "s", (F.sum("count").over(w) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("bucket")).alias("n"))
    ranked = b.withColumn("s", sector).join(before, ["bucket", "s"]).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("bucket", "s").orderBy("h")))
    return ranked.select("p_partkey", "bucket", F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.2))), "test").otherwise("train").alias("part"))


@P.query("SELECT o_orderkey, sha256('sample' || o_orderkey::VARCHAR) AS h FROM orders ORDER BY h LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    """A hundred rows without replacement, in hash order (a top-k, no full sort)."""
    return t.orders.select("o_orderkey", F.sha2(F.concat(F.lit("sample"), F.col("o_orderkey").cast("string")), 256).alias("h")).orderBy("h").limit(100)


@P.query(f"""
    WITH r AS (SELECT split, cleaned_content_hash AS h FROM {_DELIVERED} WHERE cleaned_content_hash IS NOT NULL)
    SELECT h AS cleaned_content_hash FROM r WHERE split = 'train' INTERSECT SELECT h FROM r WHERE split IN ('eval', 'validation')
""")
def content_overlap(t: Tables) -> DataFrame:
    """Content hashes of train that also stand in eval or validation."""
    r = t.shard_rows.where("cleaned_content_hash is not null").select("split", "cleaned_content_hash")
    return r.where("split = 'train'").select("cleaned_content_hash").intersect(r.where("split in ('eval', 'validation')").select("cleaned_content_hash"))


@P.query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dups(t: Tables) -> DataFrame:
    h = F.sha2("text", 256).alias("content_hash")
    return t.documents.where("text is not null").groupBy(h).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@P.query("SELECT n_regionkey, sha256(string_agg(n_nationkey::VARCHAR || ':' || n_name, '|' ORDER BY n_nationkey)) AS fold_hash FROM nation GROUP BY n_regionkey")
def group_content_hash(t: Tables) -> DataFrame:
    """Hash of a group's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(":"), r["n_name"])), "|")
    return t.nation.groupBy("n_regionkey").agg(F.sha2(text, 256).alias("fold_hash"))


@P.query()
def file_content_hash(t: Tables) -> DataFrame:
    """Name (below the data directory), length and sha256 of the data files themselves."""
    from ..sources.files import file_hashes

    below = "/" + re.sub(r"^\w+:/*", "", t.sf_dir).strip("/") + "/"
    return file_hashes(t.spark, t.sf_dir).select(F.substring_index("path", below, -1).alias("name"), "length", "sha256")


@P.query("SELECT split, lane, count(*) AS n FROM documents GROUP BY split, lane")
def lane_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("split", "lane").agg(F.count("*").alias("n"))


@P.query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_id FROM lineitem")
def row_ids(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("row_id"))


@P.query("SELECT stage, list_sort(list_distinct(list(lane))) = ['agentic', 'code', 'general_web', 'indic', 'reasoning'] AS complete, count(DISTINCT lane) AS lanes FROM stage_weights GROUP BY stage")
def required_subset(t: Tables) -> DataFrame:
    """Whether each stage names every lane that is required."""
    need = F.array(*[F.lit(x) for x in ("agentic", "code", "general_web", "indic", "reasoning")])
    return t.stage_weights.groupBy("stage").agg((F.size(F.array_except(need, F.collect_set("lane"))) == 0).alias("complete"), F.countDistinct("lane").alias("lanes"))


@P.query(f"SELECT shard_id, row_id, tokens[1:16] AS prefix FROM {_DELIVERED} WHERE tokens IS NOT NULL")
def prefix_tokens(t: Tables) -> DataFrame:
    """The first sixteen tokens of each delivered row; cut before the shuffle."""
    cut = t.shard_rows.where("tokens is not null").select("shard_id", "row_id", "written_at", F.slice("tokens", 1, 16).alias("prefix"))
    return delivered(cut, "prefix")


@P.query("SELECT lane, doc_id, quality FROM (SELECT lane, doc_id, quality, row_number() OVER (PARTITION BY lane ORDER BY quality DESC, doc_id) AS k FROM documents WHERE quality BETWEEN 0 AND 1 AND quality::VARCHAR <> 'nan') WHERE k <= 3")
def top_quality(t: Tables) -> DataFrame:
    """The best three of each lane, doc_id breaking ties."""
    good = t.documents.where("quality >= 0 and quality <= 1").select("lane", "doc_id", "quality")
    return first_ranked(good, ["lane"], [F.desc("quality"), F.col("doc_id")], 3)


@P.query("""
    WITH c AS (SELECT doc_id, octet_length(encode(text)) AS n, ('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 100 < 2 AS held FROM documents WHERE regexp_matches(text, '[^ \\n\\t\\r]')),
    r AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY held ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS part, doc_id, least(n + 1, CASE WHEN held THEN 2000 ELSE 100000 END - before)::BIGINT AS taken FROM r WHERE before < CASE WHEN held THEN 2000 ELSE 100000 END
""")
def token_budget_cut(t: Tables) -> DataFrame:
    """Texts with an end token each, in id order, up to a budget per part; the last is cut. Running sums go block by block, not in one task."""
    from ..operators.running import running_sum

    held = hash_bucket(F.col("doc_id").cast("string"), 100) < 2
    c = t.documents.where(F.col("text").rlike("[^ \\n\\t\\r]")).select("doc_id", F.when(held, "validation").otherwise("train").alias("part"), (F.octet_length("text") + 1).cast("long").alias("n"))
    r = running_sum(c, ["part"], "doc_id", "n", "before")
    budget = F.when(F.col("part") == "validation", 2000).otherwise(100000)
    return r.where(F.col("before") < budget).select("part", "doc_id", F.least("n", budget - F.col("before")).cast("long").alias("taken"))


QUERIES, SQL = P.QUERIES, P.SQL
