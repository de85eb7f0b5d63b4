"""Text, byte and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranking import ranked
from .base import Plans, Tables

P = Plans()
_S = T.SPACE
_CLEAN_PROSE = f"regexp_replace(regexp_replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '[{_S}]+', ' ', 'g'), '^ +| +$', '', 'g')"


@P.query(f"SELECT doc_id, {_CLEAN_PROSE} AS cleaned FROM documents WHERE text IS NOT NULL AND lane <> 'code'")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.where("text is not null and lane <> 'code'").select("doc_id", T.clean_prose(F.col("text")).alias("cleaned"))


@P.query(f"""
    WITH s AS (SELECT doc_id, regexp_replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '^[{_S}]+|[{_S}]+$', '', 'g') AS x FROM documents WHERE lane = 'code' AND text IS NOT NULL)
    SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(x, '{T.LINE}'), lambda l: regexp_replace(l, '[{_S}]+$', '')), chr(10)) AS cleaned FROM s
""")
def clean_code(t: Tables) -> DataFrame:
    return t.documents.where("lane = 'code' and text is not null").select("doc_id", T.clean_code(F.col("text")).alias("cleaned"))


@P.query("""
    WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (length(h) // 2)::INTEGER AS n_tokens,
      sha256('[' || array_to_string(list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::INTEGER + 3), ',') || ']') AS span_hash FROM b
""")
def byte_tokenize(t: Tables) -> DataFrame:
    tokens = t.documents.where("text is not null").select("doc_id", T.byte_tokens("text").alias("tokens"))
    text = F.concat(F.lit("["), F.array_join(F.col("tokens").cast("array<string>"), ","), F.lit("]"))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(text, 256).alias("span_hash"))


@P.query("SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id % 5 <> 0) AS exact, count(*) FILTER (WHERE doc_id % 5 = 0) AS undecodable FROM documents WHERE text IS NOT NULL")
def roundtrip(t: Tables) -> DataFrame:
    """Texts that come back from their tokens; those of every fifth id end in a byte that no UTF-8 has, and do not."""
    tokens = F.when(F.col("doc_id") % 5 == 0, F.concat(T.byte_tokens("text"), F.array(F.lit(255 + T.BYTE_OFFSET)))).otherwise(T.byte_tokens("text"))
    back = t.documents.where("text is not null").select("text", T.byte_text(tokens).alias("back"))
    return back.agg(F.count("*").alias("documents"), F.count_if(F.col("text") == F.col("back")).alias("exact"), F.count_if(F.col("back").isNull()).alias("undecodable"))


@P.query("""
    WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text IS NOT NULL AND text <> '')
    SELECT ch, (row_number() OVER (ORDER BY encode(ch)) - 1)::INTEGER AS id, n FROM (SELECT ch, count(*) AS n FROM c GROUP BY ch)
""")
def char_vocab(t: Tables) -> DataFrame:
    chars = t.documents.where("text is not null and text <> ''").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    # The alphabet is small whatever the corpus; the counts are combined before any shuffle.
    return chars.groupBy("ch").agg(F.count("*").alias("n")).select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"), "n")


@P.query("""
    SELECT doc_id, array_to_string(list_transform(turns, lambda x: '<' || coalesce(x.role, '') || '> ' || coalesce(x.text, '') || chr(10)), '') AS rendered FROM documents WHERE turns IS NOT NULL
""")
def render_turns(t: Tables) -> DataFrame:
    return t.documents.where("turns is not null").select("doc_id", T.rendered_turns(F.col("turns")).alias("rendered"))


@P.query("""
    SELECT lane, count(*) AS rows_seen, count(*)::DOUBLE / count(*) AS valid_rate FROM shard_rows WHERE tokens IS NOT NULL GROUP BY lane
""")
def valid_utf8_rate(t: Tables) -> DataFrame:
    """Share of token rows whose bytes are valid UTF-8 (all of the test tables' rows are)."""
    rows = t.shard_rows.where("tokens is not null").select("lane", T.byte_text("tokens").isNotNull().alias("ok"))
    return rows.groupBy("lane").agg(F.count("*").alias("rows_seen"), (F.count_if("ok") / F.count("*")).alias("valid_rate"))


@P.query("""
    SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
""")
def byte_edit_distance(t: Tables) -> DataFrame:
    """Levenshtein distance over bytes; the pairs of a fixed dimension table of 25 rows."""
    raw = F.decode(F.encode(F.col("n_name"), "UTF-8"), "ISO-8859-1")
    a = t.nation.select(F.col("n_nationkey").alias("left_key"), raw.alias("x"))
    b = t.nation.select(F.col("n_nationkey").alias("right_key"), raw.alias("y"))
    return a.join(F.broadcast(b), F.col("left_key") < F.col("right_key")).select("left_key", "right_key", F.levenshtein("x", "y").alias("distance"))


_WORDS = "SELECT doc_id, coalesce(language, '') AS language, unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) AS w FROM documents WHERE text IS NOT NULL"


def _words(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.coalesce("language", F.lit("")).alias("language"), F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("w"))


@P.query(f"""
    WITH b AS (SELECT octet_length(encode(w)) AS n FROM ({_WORDS}))
    SELECT CASE WHEN n <= 8 THEN '1-8' WHEN n <= 16 THEN '9-16' WHEN n <= 32 THEN '17-32' WHEN n <= 64 THEN '33-64' ELSE '65-128' END AS bucket, count(*) AS n FROM b GROUP BY 1
""")
def length_buckets(t: Tables) -> DataFrame:
    return _words(t).groupBy(T.length_bucket(F.octet_length("w")).alias("bucket")).agg(F.count("*").alias("n"))


@P.query(f"""
    SELECT language, count(*) AS tokens, count(*) FILTER (WHERE octet_length(encode(w)) > 32) AS over_32, round(count(*) FILTER (WHERE octet_length(encode(w)) > 32) / count(*), 9) AS over_32_fraction, max(octet_length(encode(w)))::INTEGER AS longest
    FROM ({_WORDS}) GROUP BY language
""")
def over_limit_stats(t: Tables) -> DataFrame:
    n = F.octet_length("w")
    return _words(t).groupBy("language").agg(F.count("*").alias("tokens"), F.count_if(n > 32).alias("over_32"), F.round(F.count_if(n > 32) / F.count("*"), 9).alias("over_32_fraction"), F.max(n).alias("longest"))


@P.query("""
    WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), b AS (SELECT p_partkey, least(length(h) // 2, 32) AS n, h FROM h)
    SELECT p_partkey, i::INTEGER * 256 + ('0x' || h[2 * i + 1 : 2 * i + 2])::INTEGER AS coordinate, round(1 / sqrt(n), 9) AS scale FROM b, unnest(range(0, n)) AS r(i)
""")
def k32_coordinates(t: Tables) -> DataFrame:
    """Sparse position-byte coordinates of the first 32 bytes, scaled by 1 / sqrt(length)."""
    h = t.part.select("p_partkey", F.hex(F.encode("p_name", "UTF-8")).alias("h")).withColumn("n", F.least(F.floor(F.length("h") / 2), F.lit(32)).cast("int"))
    rows = h.where("n > 0").select("p_partkey", "h", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    byte = F.conv(F.substr(F.col("h"), F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("p_partkey", (F.col("i") * 256 + byte).alias("coordinate"), F.round(1 / F.sqrt("n"), 9).alias("scale"))


@P.query(f"""
    WITH d AS (SELECT DISTINCT w FROM ({_WORDS}) WHERE w <> ''), p AS (SELECT hex(encode(w))[1:64] AS prefix FROM d)
    SELECT prefix, count(*) AS tokens FROM p GROUP BY prefix HAVING count(*) > 1
""")
def prefix_collisions(t: Tables) -> DataFrame:
    prefix = F.substring(F.hex(F.encode("w", "UTF-8")), 1, 64)
    return _words(t).where("w <> ''").select("w").distinct().groupBy(prefix.alias("prefix")).agg(F.count("*").alias("tokens")).where("tokens > 1")


@P.query("""
    WITH v AS (SELECT o_orderkey, o_totalprice * o_totalprice AS b FROM orders)
    SELECT o_orderkey, CASE WHEN b < 1024 THEN format('{:.2f} B', b) WHEN b / 1024 < 1024 THEN format('{:.2f} KiB', b / 1024) WHEN b / 1048576 < 1024 THEN format('{:.2f} MiB', b / 1048576) WHEN b / 1073741824 < 1024 THEN format('{:.2f} GiB', b / 1073741824) ELSE format('{:.2f} TiB', b / 1099511627776) END AS size FROM v
""")
def human_bytes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.human_bytes(F.col("o_totalprice") * F.col("o_totalprice")).alias("size"))


_VOCAB = f"SELECT w FROM ({_WORDS}) WHERE w <> '' GROUP BY w HAVING count(*) >= 5"


def _vocab(t: Tables) -> DataFrame:
    return _words(t).where("w <> ''").groupBy("w").count().where("count >= 5").select("w")


@P.query(f"""
    WITH v AS ({_VOCAB}) SELECT x.language, count(*) AS tokens, count(v.w) AS known, round(count(v.w) / count(*), 9) AS known_rate FROM ({_WORDS}) x LEFT JOIN v ON x.w = v.w GROUP BY x.language
""")
def known_vocab_rate(t: Tables) -> DataFrame:
    counted = _words(t).groupBy("language", "w").count()
    known = _vocab(t).withColumn("known", F.lit(1))
    hit = F.sum(F.when(F.col("known") == 1, F.col("count")).otherwise(0))
    return counted.join(known, "w", "left").groupBy("language").agg(F.sum("count").alias("tokens"), hit.alias("known"), F.round(hit / F.sum("count"), 9).alias("known_rate"))


@P.query(f"""
    WITH v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) - 1 AS id FROM ({_VOCAB})) SELECT count(*) AS tokens, count(DISTINCT w) AS found, sum(id)::BIGINT AS id_sum FROM v
""")
def vocab_roundtrip(t: Tables) -> DataFrame:
    """Ids to words and back, through both maps."""
    ids = ranked(_vocab(t), [], [F.asc("w")], "k").select("w", (F.col("k") - 1).cast("long").alias("id"))
    back = ids.join(ids.select(F.col("id").alias("id2"), F.col("w").alias("w2")), F.col("id") == F.col("id2")).where("w = w2")
    return back.agg(F.count("*").alias("tokens"), F.countDistinct("w2").alias("found"), F.sum("id2").alias("id_sum"))


@P.query(f"""
    WITH x AS (SELECT language, count(*) AS words, sum(octet_length(encode(w)))::BIGINT AS bytes FROM ({_WORDS}) WHERE w <> '' GROUP BY language) SELECT language, words, bytes, round(bytes / words, 6) AS fertility FROM x
""")
def fertility(t: Tables) -> DataFrame:
    """Byte tokens per word, by label."""
    x = _words(t).where("w <> ''").groupBy("language").agg(F.count("*").alias("words"), F.sum(F.octet_length("w")).alias("bytes"))
    return x.withColumn("fertility", F.round(F.col("bytes") / F.col("words"), 6))


@P.query(f"""
    WITH v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) AS id FROM ({_VOCAB})) SELECT x.doc_id, count(*) AS words, count(*) FILTER (WHERE v.id IS NULL) AS unknown, sum(coalesce(v.id, 0))::BIGINT AS id_sum FROM ({_WORDS}) x LEFT JOIN v ON x.w = v.w WHERE x.w <> '' GROUP BY x.doc_id
""")
def word_tokenize_unk(t: Tables) -> DataFrame:
    """Word ids with 0 for words outside the vocabulary."""
    ids = ranked(_vocab(t), [], [F.asc("w")], "id").select("w", F.col("id").cast("long").alias("id"))
    per = _words(t).where("w <> ''").groupBy("doc_id", "w").count().join(ids, "w", "left")
    n = F.col("count")
    return per.groupBy("doc_id").agg(F.sum(n).alias("words"), F.sum(F.when(F.col("id").isNull(), n).otherwise(0)).alias("unknown"), F.sum(F.coalesce("id", F.lit(0)) * n).alias("id_sum"))


@P.query("""
    SELECT event_id, round(CASE WHEN value::VARCHAR IN ('nan', 'inf', '-inf') THEN NULL ELSE value END, 8) AS value FROM events
""")
def clean_numeric(t: Tables) -> DataFrame:
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return t.events.select("event_id", F.round(F.when(bad, None).otherwise(F.col("value")), 8).alias("value"))


@P.query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@P.query("""
    WITH b AS (SELECT shard_id, row_id, tokens, generate_subscripts(tokens, 1) AS i FROM (SELECT DISTINCT ON (shard_id, row_id) * FROM shard_rows ORDER BY shard_id, row_id, written_at DESC))
    SELECT tokens[i] AS x, tokens[i + 1] AS y, count(*) AS n FROM b WHERE i < len(tokens) GROUP BY 1, 2
""")
def bigram_counts(t: Tables) -> DataFrame:
    from ..operators.corpus import delivered

    rows = delivered(t.shard_rows, "tokens").where("size(tokens) > 1")
    pairs = rows.select(F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("x"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("y"))).alias("p"))
    return pairs.groupBy("p.x", "p.y").agg(F.count("*").alias("n"))


@P.query("""
    WITH w AS (SELECT DISTINCT w FROM (@WORDS) WHERE octet_length(encode(w)) = length(w) AND length(w) > 32)
    SELECT w AS word, i::INTEGER AS block, w[i * 32 + 1:(i + 1) * 32] AS piece FROM w, unnest(range(0, (length(w) + 31) // 32)) AS r(i)
""".replace("@WORDS", _WORDS))
def overflow_blocks_ascii(t: Tables) -> DataFrame:
    """The same for words of ASCII, where blocks are characters."""
    from ..operators.blocks import overflow_blocks as blocks

    return blocks(_words(t).where((F.octet_length("w") > 32) & (F.octet_length("w") == F.length("w"))).select("w").distinct(), "w", 32)


@P.query()
def overflow_blocks(t: Tables) -> DataFrame:
    """Blocks of at most 32 bytes of each word, cut before a character; p words longer than that only."""
    from ..operators.blocks import overflow_blocks as blocks

    return blocks(_words(t).where(F.octet_length("w") > 32).select("w").distinct(), "w", 32)


_BITS = """
    SELECT p_partkey, v, e, ((e + 127)::BIGINT << 23) | ((v / pow(2, e) - 1) * 8388608)::BIGINT AS b, least(round_even(v / pow(2, e - 3), 0)::BIGINT + ((e + 6)::BIGINT << 3), 126) AS q
    FROM (SELECT p_partkey, v, floor(log2(v))::BIGINT AS e FROM (SELECT p_partkey, (p_retailprice / 64)::FLOAT::DOUBLE AS v FROM part WHERE p_retailprice > 1))
"""


@P.query(f"""
    SELECT p_partkey, fp32[1:1] || ' ' || fp32[2:9] || ' ' || fp32[10:] AS fp32, bf16[1:1] || ' ' || bf16[2:9] || ' ' || bf16[10:] AS bf16, fp8[1:1] || ' ' || fp8[2:5] || ' ' || fp8[6:] AS fp8,
      (1 + (q & 7) / 8.0::DOUBLE) * pow(2, (q >> 3) - 7) AS fp8_value
    FROM (SELECT p_partkey, q, lpad(bin(b), 32, '0') AS fp32, lpad(bin((b + 32767 + ((b >> 16) & 1)) >> 16), 16, '0') AS bf16, lpad(bin(q), 8, '0') AS fp8 FROM ({_BITS}))
""")
def float_bits(t: Tables) -> DataFrame:
    """Bits of a value as FP32, BF16 and FP8 E4M3 (round to nearest, ties to even), by sign, exponent and mantissa, and what FP8 makes of it."""
    from ..functions.numeric import bf16_bits, fp8_bits, fp8_value, fp32_bits, grouped_bits

    v = (F.col("p_retailprice") / 64).cast("float")
    return t.part.where("p_retailprice > 1").select("p_partkey", grouped_bits(fp32_bits(v), 8).alias("fp32"), grouped_bits(bf16_bits(v), 8).alias("bf16"), grouped_bits(fp8_bits(v.cast("double")), 4).alias("fp8"), fp8_value(v.cast("double")).alias("fp8_value"))


@P.query("""
    WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part)
    SELECT p_partkey, i::INTEGER * 256 + ('0x' || h[2 * i + 1 : 2 * i + 2])::INTEGER AS coordinate, round(1.0::DOUBLE / greatest(length(h) // 2, 1), 9) AS value FROM h, unnest(range(0, length(h) // 2)) AS r(i) WHERE length(h) <= 64
""")
def k32_mean_code(t: Tables) -> DataFrame:
    """Position-byte coordinates of words of at most 32 bytes, each of one over the length; a longer word raises, so they are set aside first."""
    return T.mean_code(t.part.where(F.octet_length("p_name") <= 32), "p_partkey", "p_name")


@P.query("""
    WITH v AS (SELECT ch, row_number() OVER (ORDER BY encode(ch)) + 1 AS id FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part WHERE p_name <> '') WHERE ch <> ''),
    c AS (SELECT p_partkey, i, string_split(p_name, '')[i] AS ch FROM part, unnest(range(1, length(p_name) + 1)) AS r(i))
    SELECT p_partkey, string_agg(id::VARCHAR, ',' ORDER BY i) || ',1' AS ids, any_value(p_name) AS decoded FROM c JOIN v USING (ch) JOIN part USING (p_partkey) GROUP BY p_partkey
""")
def char_encode(t: Tables) -> DataFrame:
    """Ids of a character vocabulary behind pad and end, with an end each, and the text that they give back."""
    tokenizer = T.CharTokenizer.of(t.part, "p_name")
    ids = tokenizer.encode(F.col("p_name"))
    return t.part.where("p_name <> ''").select("p_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"), tokenizer.decode(ids).alias("decoded"))


@P.query("SELECT doc_id, lane, split, language FROM documents")
def metadata_view(t: Tables) -> DataFrame:
    """A record without its payload: keys dropped from a struct."""
    record = F.struct("doc_id", "lane", "split", "language", "text", "turns").dropFields("text", "turns")
    return t.documents.select(record.alias("r")).select("r.*")


QUERIES, SQL = P.QUERIES, P.SQL
