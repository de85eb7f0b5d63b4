"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import cutoff, language, leakage, lookalike, mixing, overlap, packing, splitting, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unnamed_languages(table(spark, d, "documents"))


def _p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"))


def _p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"))


def _p1_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The language of documents that are almost all in one script of one language (checked by SQL, which counts letters)."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    letters = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", ""))
    whole = F.length(F.regexp_replace("text", "[\\s\\p{Punct}0-9]", ""))
    mostly = (F.greatest(letters("\\x{0C00}-\\x{0C7F}"), letters("\\x{0C80}-\\x{0CFF}"), letters("\\x{0B80}-\\x{0BFF}")) > 0.9 * whole) & (whole >= 40)
    return language.document_languages(docs).join(docs.where(mostly).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "language")


def _p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "shard_rows"), table(spark, d, "lane_config"))


def _p2_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_p2_containers(spark, d))


def _p2_parts(spark: SparkSession, d: str) -> DataFrame:
    """What must be packed: per lane the parts and tokens placed (checked by SQL, whatever the placement)."""
    placed = _p2_containers(spark, d).where(F.col("container").isNotNull())
    return placed.groupBy("lane").agg(F.count("*").alias("parts"), F.sum("size").alias("tokens"), F.max("size").alias("largest"))


def _p2_places(spark: SparkSession, d: str) -> DataFrame:
    """Per lane the tokens placed, containers above their capacity, and parts that do not begin where the one before them ends."""
    placed = _p2_containers(spark, d).where(F.col("container").isNotNull())
    before = F.lag(F.col("packed_start") + F.col("size"), 1, 0).over(Window.partitionBy("lane", "container").orderBy("packed_start"))
    p = placed.withColumn("gap", (F.col("packed_start") != before).cast("int"))
    boxes = p.groupBy("lane", "container", "capacity").agg(F.sum("size").alias("n"), F.sum("gap").alias("gaps"))
    return boxes.groupBy("lane").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > F.col("capacity")).alias("overfull"), F.sum("gaps").alias("misplaced"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.Overlap(table(spark, d, "documents")).pairs()


def _p3_same(spark: SparkSession, d: str) -> DataFrame:
    """The pairs found whose texts are the same string (checked by SQL, which joins on the text)."""
    text = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    a, b = (text.select(F.col("doc_id").alias(f"doc_id_{x}"), F.sha2("text", 256).alias(f"h{x}")).distinct() for x in "ab")
    return _p3_found(spark, d).join(a, "doc_id_a").join(b, "doc_id_b").where("ha = hb").select("doc_id_a", "doc_id_b")


def _p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal word sequences, by their smallest doc_ids."""
    return overlap.Overlap(table(spark, d, "documents")).links


def _p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a counterpart across the train border: class, coverage, linked classes."""
    return overlap.Overlap(table(spark, d, "documents")).touched()


def _p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "documents"))


def _p3_shards(spark: SparkSession, d: str) -> DataFrame:
    return overlap.shard_overlap(table(spark, d, "documents"), table(spark, d, "shard_index"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, d, "documents"))


def _p4_spaces(spark: SparkSession, d: str) -> DataFrame:
    """The pairs found of ASCII texts (checked by SQL: such texts look the same if they differ in white space alone)."""
    ascii_ = table(spark, d, "documents").where(F.col("text").rlike(r"^[\x20-\x7e\t\r\n]*$")).select("doc_id")
    return _p4_found(spark, d).join(ascii_.withColumnRenamed("doc_id", "doc_id_a"), "doc_id_a", "left_semi").join(ascii_.withColumnRenamed("doc_id", "doc_id_b"), "doc_id_b", "left_semi")


def _p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same without expanding pairs: each document's look, spelling and the look's number of spellings."""
    return lookalike.Looks(table(spark, d, "documents")).classes()


def _p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(table(spark, d, "documents")).select("doc_id", "form")


def _p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "shard_rows"), table(spark, d, "lane_config"))


def _p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether each oversized row's pieces cover it, keep the limit and share the overlap."""
    config = table(spark, d, "lane_config").select("lane", "piece_limit", "piece_overlap")
    p = _p5_pieces(spark, d).join(F.broadcast(config), "lane")
    w = Window.partitionBy("shard_id", "row_id").orderBy("piece")
    begins = F.coalesce(F.lag("token_end").over(w) - F.col("piece_overlap"), F.lit(0))
    p = p.withColumn("ok", (F.col("token_start") == F.greatest(begins, F.lit(0))) & (F.col("token_end") - F.col("token_start") <= F.col("piece_limit")))
    return p.groupBy("shard_id", "row_id").agg(F.max("n_tokens").alias("n_tokens"), (F.max("token_end") == F.max("n_tokens")).alias("complete"), F.bool_and("ok").alias("sound"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_pieces(spark, d).where("piece = 0").select("shard_id", "row_id").distinct()


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.kept_documents(table(spark, d, "documents"), table(spark, d, "lane_config")).select("doc_id").distinct()


def _p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.lane_cutoffs(table(spark, d, "documents"), table(spark, d, "lane_config"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def _p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mixed(spark: SparkSession, d: str, **how) -> mixing.Mixture:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"), **how)


def _p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).uses


def _p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).report()


def _p8_byte_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in tokens of the project's byte tokenizer."""
    return _mixed(spark, d, tokenizer=None).report()


def _p8_byte_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, tokenizer=None).uses


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels")).where("flagged").select("doc_id").distinct()


def _p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def _p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_documents": _p1_documents,
        "p1_segments": _p1_segments,
        "p1_scripts": _p1_scripts,
        "p2_containers": _p2_containers,
        "p2_fill": _p2_fill,
        "p2_parts": _p2_parts,
        "p2_places": _p2_places,
        "p3_found": _p3_found,
        "p3_same": _p3_same,
        "p3_links": _p3_links,
        "p3_members": _p3_members,
        "p3_report": _p3_report,
        "p3_shards": _p3_shards,
        "p4_found": _p4_found,
        "p4_forms": _p4_forms,
        "p4_classes": _p4_classes,
        "p4_spaces": _p4_spaces,
        "p5_found": _p5_found,
        "p5_pieces": _p5_pieces,
        "p5_cover": _p5_cover,
        "p6_found": _p6_found,
        "p6_cutoffs": _p6_cutoffs,
        "p7_found": _p7_found,
        "p7_items": _p7_items,
        "p8_mixture": _p8_mixture,
        "p8_shares": _p8_shares,
        "p8_byte_shares": _p8_byte_shares,
        "p8_byte_mixture": _p8_byte_mixture,
        "p9_found": _p9_found,
        "p9_scores": _p9_scores,
        "p9_rates": _p9_rates,
    }


_LENGTHS = """
  SELECT shard_id, row_id, lane, written_at, coalesce(len(tokens), 0) - CASE WHEN roles IS NULL OR tokens IS NULL THEN 0 ELSE len(list_filter(roles, lambda r: r = 'pad')) END AS n
  FROM shard_rows
"""

_SCORED = """
  SELECT d.doc_id, d.lane, d.quality, c.keep_fraction
  FROM documents d JOIN lane_config c ON d.lane = c.lane
  WHERE d.quality >= 0 AND d.quality <= 1 AND d.quality::VARCHAR <> 'nan'
"""

_CUT = f"""
  WITH scored AS ({_SCORED}), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lane ORDER BY quality DESC) AS place, count(*) OVER (PARTITION BY lane) AS n FROM scored
  ), cut AS (SELECT lane, any_value(keep_fraction) AS keep_fraction, max(n) AS n, min(quality) AS cutoff FROM ranked WHERE place <= ceil(keep_fraction * n) GROUP BY lane)
"""

_MIXED = """
  WITH tg AS (
    SELECT source, max(target_share) AS t, max(max_repeats) AS m FROM source_targets
    WHERE source IS NOT NULL AND target_share > 0 AND target_share::VARCHAR <> 'nan' AND max_repeats > 0 GROUP BY source
  ), d AS (
    SELECT doc_id, d.source, octet_length(encode(text))::BIGINT AS tokens, t, m,
      round((0.25::DOUBLE + 0.75::DOUBLE * CASE WHEN quality >= 0 AND quality <= 1 AND quality::VARCHAR <> 'nan' THEN quality ELSE 0.5::DOUBLE END) * 1000000)::BIGINT AS w,
      (('0x' || substr(md5('mix-1|' || d.source || '|' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents d JOIN tg ON d.source = tg.source WHERE split = 'train' AND text IS NOT NULL
  ), size AS (SELECT source, any_value(t) AS t, any_value(m) AS m, sum(tokens)::BIGINT AS n FROM d GROUP BY source HAVING sum(tokens) > 0),
  lim AS (
    SELECT *, m * n / t AS lim, row_number() OVER (ORDER BY m * n / t, source) AS k,
      coalesce(sum(m * n) OVER (ORDER BY m * n / t, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS given,
      sum(t) OVER (ORDER BY m * n / t, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM size
  ), total AS (SELECT sum(n)::DOUBLE AS total FROM size),
  x AS (SELECT arg_min((total - given) / open, k) AS x FROM lim, total WHERE (total - given) / open <= lim),
  owed AS (SELECT source, t, m, n, least(t * coalesce(x, 'inf'::DOUBLE), (m * n)::DOUBLE) AS owed FROM size, x),
  plan AS (SELECT *, least(m, floor(owed / n + 1e-12)::INTEGER) AS copies FROM owed),
  rest AS (SELECT *, CASE WHEN copies < m THEN greatest(0, floor(owed - copies * n + 0.5))::BIGINT ELSE 0 END AS rest FROM plan),
  levels AS (SELECT d.source, w, sum(tokens) AS s, any_value(rest) AS rest FROM d JOIN rest ON d.source = rest.source WHERE rest > 0 GROUP BY d.source, w),
  above AS (
    SELECT source, w, rest, coalesce(sum(s) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
      sum(w::HUGEINT * s) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
    FROM levels
  ), odds AS (SELECT source, arg_max((rest - a)::DOUBLE * 1000000 / b::DOUBLE, w) AS c FROM above WHERE (rest - a)::DOUBLE * 1000000 / b::DOUBLE * w < 1000000 AND b > 0 GROUP BY source),
  p AS (SELECT d.doc_id, d.source, tokens, u, copies, rest, least(1.0::DOUBLE, c * w / 1000000) AS p FROM d JOIN rest ON d.source = rest.source LEFT JOIN odds ON d.source = odds.source),
  q AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS q FROM p),
  cum AS (SELECT *, sum(CASE WHEN tokens > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY source ORDER BY q) AS upto, sum(tokens) OVER (PARTITION BY source, q) AS own FROM q),
  uses AS (SELECT doc_id, source, tokens, tokens AS bytes, CASE WHEN tokens > 0 THEN copies + CASE WHEN rest > 0 AND upto - own < rest AND (upto <= rest OR upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END ELSE 0 END::INTEGER AS uses FROM cum)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_byte_mixture": f"{_MIXED} SELECT doc_id, source, tokens, bytes, uses FROM uses",
        "p8_byte_shares": f"""{_MIXED},
          got AS (SELECT source, count(*) AS documents, sum(uses)::BIGINT AS uses, max(uses) AS most_uses, sum(tokens * uses)::BIGINT AS given, max(tokens) AS largest FROM uses GROUP BY source),
          b AS (SELECT tg.source, tg.t, tg.m, coalesce(rest.n, 0) AS n, coalesce(owed, 0) AS owed, coalesce(given, 0) AS given, documents, uses, most_uses, coalesce(largest, 0) AS largest
            FROM tg LEFT JOIN rest ON tg.source = rest.source LEFT JOIN got ON tg.source = got.source)
          SELECT source, t AS target_share, round(given / sum(given) OVER (), 9) AS actual_share, m AS max_repeats, n AS available, round(owed, 3) AS owed, given,
            round(greatest(0, t * sum(given) OVER () - given), 3) AS short, abs(given - owed) <= largest / 2 + 1 AS as_owed, documents, uses, most_uses FROM b
        """,
        "p1_scripts": """
          WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{0C00}-\\x{0C7F}]', '', 'g')) AS te, length(regexp_replace(text, '[^\\x{0C80}-\\x{0CFF}]', '', 'g')) AS kn, length(regexp_replace(text, '[^\\x{0B80}-\\x{0BFF}]', '', 'g')) AS ta,
            length(regexp_replace(text, '[[:space:][:punct:]0-9]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
          SELECT DISTINCT doc_id, CASE WHEN te > 0.9 * n THEN 'te' WHEN kn > 0.9 * n THEN 'kn' ELSE 'ta' END AS language FROM c WHERE n >= 40 AND greatest(te, kn, ta) > 0.9 * n
        """,
        "p2_places": f"""
          WITH r AS (SELECT DISTINCT ON (shard_id, row_id) shard_id, row_id, lane, n FROM ({_LENGTHS}) ORDER BY shard_id, row_id, written_at DESC, n DESC)
          SELECT r.lane, sum(n)::BIGINT AS tokens, 0::BIGINT AS overfull, 0::BIGINT AS misplaced FROM r JOIN lane_config c ON r.lane = c.lane WHERE n > 0 GROUP BY r.lane
        """,
        "p3_same": """
          SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b
          FROM documents a JOIN documents b ON a.text = b.text WHERE a.split = 'train' AND b.split <> 'train' AND regexp_matches(a.text, '[\\p{L}\\p{N}\\p{P}\\p{S}]') AND a.doc_id <> b.doc_id
        """,
        "p4_spaces": """
          WITH d AS (SELECT DISTINCT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS look FROM documents WHERE regexp_full_match(text, '[\\x20-\\x7e\\t\\r\\n]*'))
          SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id WHERE a.look <> ''
        """,
        "p5_cover": f"""
          WITH r AS (SELECT DISTINCT ON (shard_id, row_id) * FROM ({_LENGTHS}) ORDER BY shard_id, row_id, written_at DESC, n DESC)
          SELECT shard_id, row_id, n::INTEGER AS n_tokens, true AS complete, true AS sound FROM r JOIN lane_config c ON r.lane = c.lane WHERE n > piece_limit
        """,
        "p2_parts": f"""
          WITH r AS (SELECT DISTINCT ON (shard_id, row_id) shard_id, row_id, lane, n FROM ({_LENGTHS}) ORDER BY shard_id, row_id, written_at DESC, n DESC),
          p AS (SELECT r.lane, c.capacity, n, unnest(range(0, n, c.capacity)) AS start FROM r JOIN lane_config c ON r.lane = c.lane WHERE n > 0)
          SELECT lane, count(*) AS parts, sum(least(capacity, n - start))::BIGINT AS tokens, max(least(capacity, n - start))::INTEGER AS largest FROM p GROUP BY lane
        """,
        "p5_found": f"SELECT DISTINCT shard_id, row_id FROM ({_LENGTHS}) l JOIN lane_config c ON l.lane = c.lane WHERE n > piece_limit",
        "p6_found": f"{_CUT} SELECT s.doc_id FROM scored s JOIN cut ON s.lane = cut.lane WHERE s.quality >= cut.cutoff",
        "p6_cutoffs": f"{_CUT} SELECT s.lane, s.keep_fraction, any_value(cut.cutoff) AS cutoff, any_value(cut.n) AS scored, count(*) AS kept FROM scored s JOIN cut ON s.lane = cut.lane WHERE s.quality >= cut.cutoff GROUP BY s.lane, s.keep_fraction",
    }
