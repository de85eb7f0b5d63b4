"""Packing, sequence, batch and replay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import binpack as B
from ..operators.corpus import delivered
from .base import Plans, Tables

P = Plans()
L = 64
_ROWS = "(SELECT DISTINCT ON (shard_id, row_id) shard_id, row_id, doc_id, lane, split, tokens, roles, coalesce(len(tokens), 0)::INTEGER AS n FROM shard_rows ORDER BY shard_id, row_id, written_at DESC)"
_CHUNKS = f"(SELECT r.*, s AS token_start, least(s + {L - 2}, n) AS token_end FROM {_ROWS} r, unnest(range(0, n, {L - 2})) AS u(s) WHERE n > 0)"


def _sizes(t: Tables) -> DataFrame:
    """Delivered rows without their arrays: keys and lengths only are shuffled."""
    return delivered(t.shard_rows.select("shard_id", "row_id", "doc_id", "lane", "split", "written_at", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens")), "doc_id", "lane", "split", "n_tokens")


def _rows(t: Tables, *columns: str) -> DataFrame:
    return delivered(t.shard_rows, "doc_id", "lane", "split", *columns).withColumn("n_tokens", F.coalesce(F.size("tokens"), F.lit(0)))


@P.query(f"SELECT shard_id, row_id, token_start::INTEGER AS token_start, token_end::INTEGER AS token_end, sha256('[' || array_to_string(tokens[token_start + 1:token_end], ',') || ']') AS span_hash FROM {_CHUNKS}")
def chunk_rows(t: Tables) -> DataFrame:
    rows = _rows(t, "tokens")
    cut = F.slice("tokens", F.col("token_start") + 1, F.col("token_end") - F.col("token_start"))
    return B.chunks(rows, L).select("shard_id", "row_id", "token_start", "token_end", B.span_hash(cut).alias("span_hash"))


@P.query(f"SELECT lane, count(*) AS bins, sum(token_end - token_start + 2)::BIGINT AS non_pad FROM {_CHUNKS} GROUP BY lane")
def pack_structure(t: Tables) -> DataFrame:
    """One chunk per sequence."""
    return B.chunks(_sizes(t), L).groupBy("lane").agg(F.count("*").alias("bins"), F.sum(F.col("token_end") - F.col("token_start") + 2).alias("non_pad"))


_GREEDY = f"""
    WITH c AS (SELECT lane, list((token_end - token_start + 2)::BIGINT ORDER BY doc_id, token_start) AS sizes FROM {_CHUNKS} GROUP BY lane)
    SELECT lane, (list_reduce(list_prepend({L}::BIGINT, sizes), lambda acc, x: CASE WHEN acc % 1000 + x > {L} THEN (acc // 1000 + 1) * 1000 + x ELSE acc + x END) // 1000)::BIGINT AS bins, list_sum(sizes)::BIGINT AS non_pad FROM c
"""


@P.query(_GREEDY)
def pack_greedy(t: Tables) -> DataFrame:
    """Next-fit in document order."""
    return B.next_fit(B.chunks(_sizes(t), L), "lane", "doc_id", L)


@P.query(f"SELECT lane, bins, non_pad, round(non_pad / (bins * {L}), 9) AS utilization FROM ({_GREEDY})")
def packing_utilization(t: Tables) -> DataFrame:
    """Share of packed places that hold a token, by lane."""
    return pack_greedy(t).withColumn("utilization", F.round(F.col("non_pad") / (F.col("bins") * L), 9))


# Item by item: the first place counts bins, place 2 + g the gaps of g.
_BEST = f"""
    SELECT lane, acc[1] AS bins, non_pad FROM (
      SELECT lane, non_pad, list_reduce(list_prepend(list_transform(range(0, {L + 3}), lambda i: 0::BIGINT), items), lambda acc, x:
        list_transform([list_filter(range(x[1], {L + 1}), lambda g: acc[2 + g] > 0)[1]], lambda gap:
          list_transform(acc, lambda v, i: v + CASE WHEN gap IS NULL THEN (i = 1)::BIGINT + (i = 2 + {L} - x[1])::BIGINT ELSE (i = 2 + gap - x[1])::BIGINT - (i = 2 + gap)::BIGINT END))[1]) AS acc
      FROM (SELECT lane, list([(token_end - token_start + 2)::BIGINT] ORDER BY token_end - token_start DESC) AS items, sum(token_end - token_start + 2)::BIGINT AS non_pad FROM {_CHUNKS} GROUP BY lane))
"""


@P.query(f"SELECT lane, bins, non_pad, round(non_pad / (bins * {L}), 9) AS utilization FROM ({_BEST})")
def pack_best_fit(t: Tables) -> DataFrame:
    """Best-fit decreasing."""
    return B.best_fit(B.chunks(_sizes(t), L), "lane", L).withColumn("utilization", F.round(F.col("non_pad") / (F.col("bins") * L), 9))


@P.query(f"""
    SELECT lane, 'best_fit' AS policy, bins, non_pad FROM ({_BEST}) WHERE lane IN ('general_web', 'indic') UNION ALL
    SELECT lane, 'structure_preserving', count(*), sum(token_end - token_start + 2)::BIGINT FROM {_CHUNKS} WHERE lane = 'agentic' GROUP BY lane UNION ALL
    SELECT lane, 'greedy', bins, non_pad FROM ({_GREEDY}) WHERE coalesce(lane, '') NOT IN ('general_web', 'indic', 'agentic')
""")
def pack_by_policy(t: Tables) -> DataFrame:
    """Every lane by its own policy."""
    from ..operators.policies import pack_by_policy as packed

    return packed(B.chunks(_sizes(t), L), L)


_TRUNCATED = f"""
    WITH i AS (SELECT lane, list((n + 1)::BIGINT ORDER BY doc_id, shard_id, row_id) AS sizes, list([least(n + 1, {L})::BIGINT] ORDER BY n DESC) AS items, count(*) AS structure, sum(least(n + 1, {L}))::BIGINT AS kept FROM {_ROWS} GROUP BY lane)
    SELECT lane, (list_reduce(list_prepend(1000::BIGINT, sizes), lambda acc, x: CASE WHEN acc % 1000 + x > {L} THEN (acc // 1000 + 1) * 1000 + least(x, {L}) ELSE acc + x END) // 1000)::BIGINT AS greedy,
      list_reduce(list_prepend(list_transform(range(0, {L + 3}), lambda i: 0::BIGINT), items), lambda acc, x:
        list_transform([list_filter(range(x[1], {L + 1}), lambda g: acc[2 + g] > 0)[1]], lambda gap:
          list_transform(acc, lambda v, i: v + CASE WHEN gap IS NULL THEN (i = 1)::BIGINT + (i = 2 + {L} - x[1])::BIGINT ELSE (i = 2 + gap - x[1])::BIGINT - (i = 2 + gap)::BIGINT END))[1])[1] AS best_fit, structure, kept
    FROM i
"""


@P.query(_TRUNCATED)
def pack_truncating(t: Tables) -> DataFrame:
    """Documents with an end token, cut at the sequence's length: next-fit, best-fit, one a sequence."""
    rows = _sizes(t).withColumn("k", F.struct("doc_id", "shard_id", "row_id"))
    return B.truncated(rows, "lane", "k", L)


@P.query(f"SELECT lane, count(*) AS sequences, sum(least(n, {L - 2}) + 2)::BIGINT AS non_pad, sum(greatest(n - {L - 2}, 0))::BIGINT AS dropped FROM {_ROWS} GROUP BY lane")
def pack_pad_only(t: Tables) -> DataFrame:
    """One document a sequence, cut off."""
    n = F.col("n_tokens")
    return _sizes(t).groupBy("lane").agg(F.count("*").alias("sequences"), F.sum(F.least(n, F.lit(L - 2)) + 2).alias("non_pad"), F.sum(F.greatest(n - (L - 2), F.lit(0))).alias("dropped"))


@P.query(f"""
    WITH p AS (SELECT lane, doc_id, n + 1 AS m, sum(n + 1) OVER (PARTITION BY lane ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (n + 1) AS pos FROM {_ROWS})
    SELECT lane, doc_id, (pos // {L})::BIGINT AS first_sequence, (pos % {L})::INTEGER AS first_place, ((pos + m - 1) // {L})::BIGINT AS last_sequence FROM p
""")
def pack_concat_chop(t: Tables) -> DataFrame:
    """Documents with an end token each, one behind another, cut every L places."""
    from ..operators.running import running_sum

    r = running_sum(_sizes(t).select("lane", "doc_id", (F.col("n_tokens") + 1).cast("long").alias("m")), ["lane"], "doc_id", "m", "at")
    at, end = F.col("at"), F.col("at") + F.col("m") - 1
    return r.select("lane", "doc_id", F.floor(at / L).alias("first_sequence"), (at % L).cast("int").alias("first_place"), F.floor(end / L).alias("last_sequence"))


def _framed(t: Tables) -> DataFrame:
    """Roles are shuffled for the masks only, so none are here."""
    return B.framed(B.chunks(_rows(t, "tokens").withColumn("roles", F.lit(None).cast("array<string>")), L), L)


def _masks(t: Tables, *bearing: str) -> DataFrame:
    """Whether each place of a chunk's sequence bears loss, with the end token and the pads; roles become flags before they are shuffled."""
    flags = F.transform("roles", lambda r: r.isin(*bearing).cast("tinyint"))
    rows = delivered(t.shard_rows.select("shard_id", "row_id", "written_at", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"), flags.alias("flags")), "n_tokens", "flags")
    n = F.col("token_end") - F.col("token_start")
    flag = lambda x: F.lit(x).cast("tinyint")
    return B.chunks(rows, L).withColumn("mask", F.concat(F.slice("flags", F.col("token_start") + 1, n), F.array(flag(1)), F.array_repeat(flag(0), L - 1 - n)))


_FRAMED = f"""
    (SELECT shard_id, row_id, token_start, len_, ids, rl,
      list_append(ids[2:], 0) AS labels, list_append(list_transform(rl[2:], lambda r: (r IN ('content', 'assistant', 'tool_call', 'eos'))::INTEGER), 0) AS mask
     FROM (SELECT shard_id, row_id, token_start, token_end - token_start + 2 AS len_,
       list_concat(list_concat(list_concat([1], tokens[token_start + 1:token_end]), [2]), list_transform(range(0, {L - 2} - (token_end - token_start)), lambda i: 0)) AS ids,
       list_concat(list_concat(list_concat(['bos'], roles[token_start + 1:token_end]), ['eos']), list_transform(range(0, {L - 2} - (token_end - token_start)), lambda i: 'pad')) AS rl
       FROM {_CHUNKS}))
"""


@P.query(f"SELECT shard_id, row_id, token_start::INTEGER AS token_start, sha256(array_to_string(ids, ',')) AS ids_hash, sha256(array_to_string(labels, ',')) AS labels_hash, len_::INTEGER AS non_pad FROM {_FRAMED}")
def packed_rows(t: Tables) -> DataFrame:
    """Framed and padded sequences with their labels, as hashes."""
    h = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return _framed(t).select("shard_id", "row_id", "token_start", h("input_ids").alias("ids_hash"), h("labels").alias("labels_hash"), (F.col("token_end") - F.col("token_start") + 2).alias("non_pad"))


@P.query(f"SELECT shard_id, row_id, token_start::INTEGER AS token_start, list_sum(mask)::BIGINT AS loss_bearing, sha256(array_to_string(mask, '')) AS mask_hash FROM {_FRAMED}")
def loss_mask(t: Tables) -> DataFrame:
    return _masks(t, *B.BEARING).select("shard_id", "row_id", "token_start", B.total("mask").alias("loss_bearing"), F.sha2(F.array_join(F.col("mask").cast("array<string>"), ""), 256).alias("mask_hash"))


@P.query(f"SELECT shard_id, row_id, token_start::INTEGER AS token_start, len(list_filter(rl[2:], lambda r: r IN ('assistant', 'eos')))::INTEGER AS loss_bearing FROM {_FRAMED}")
def role_loss_mask(t: Tables) -> DataFrame:
    """The stricter mask: assistant and end tokens only."""
    return _masks(t, "assistant", "eos").select("shard_id", "row_id", "token_start", F.size(F.filter("mask", lambda x: x == 1)).alias("loss_bearing"))


@P.query(f"SELECT shard_id, row_id, token_start::INTEGER AS token_start, (len_ * (len_ + 1) // 2 + {L} - len_)::INTEGER AS allowed FROM {_FRAMED}")
def attention_pairs(t: Tables) -> DataFrame:
    """Pairs that the block-causal mask allows: within the segment up to oneself, pads to themselves; never materialised."""
    n = F.col("token_end") - F.col("token_start") + 2
    return B.chunks(_sizes(t), L).select("shard_id", "row_id", "token_start", (n * (n + 1) / 2 + L - n).cast("int").alias("allowed"))


_EVENTS = "(SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def _by_user(t: Tables) -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@P.query("SELECT event_id, lead(event_id) OVER w AS next_id, lead(event_id, 2) OVER w AS next_two FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def shift_labels(t: Tables) -> DataFrame:
    """Targets one and two places ahead within a sequence (here a user's events)."""
    w = _by_user(t)
    return t.events.select("event_id", F.lead("event_id").over(w).alias("next_id"), F.lead("event_id", 2).over(w).alias("next_two"))


@P.query("SELECT event_id, coalesce(event_type = lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same_segment FROM events")
def boundary_mask(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.col("event_type") == F.lead("event_type").over(_by_user(t)), F.lit(False)).alias("same_segment"))


@P.query("""
    WITH c AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM c)
    SELECT event_id, segment::BIGINT AS segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) - 1 AS position FROM g
""")
def position_ids(t: Tables) -> DataFrame:
    """Positions that start at 0 in every segment."""
    w = _by_user(t)
    new = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    g = t.events.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("event_id", "segment", (F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("ts", "event_id")) - 1).cast("long").alias("position"))


@P.query("SELECT l_orderkey, l_linenumber, (sum(l_quantity) OVER w - l_quantity)::BIGINT AS packed_start, sum(l_quantity) OVER w::BIGINT AS packed_end FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)".replace("sum(l_quantity) OVER w::BIGINT", "(sum(l_quantity) OVER w)::BIGINT"))
def pack_offsets(t: Tables) -> DataFrame:
    """Where the parts of a sequence (an order's lines, sized by quantity) begin and end."""
    r = B.offsets(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
    return r.select("l_orderkey", "l_linenumber", F.col("packed_start").cast("long").alias("packed_start"), F.col("packed_end").cast("long").alias("packed_end"))


_SPANS = "(SELECT DISTINCT ON (span_id) * FROM source_spans ORDER BY span_id, arrived_at DESC)"


def _spans(t: Tables, *columns: str) -> DataFrame:
    return t.source_spans.groupBy("span_id").agg(F.max(F.struct("arrived_at", *columns)).alias("r")).select("span_id", *(F.col(f"r.{c}").alias(c) for c in columns))


@P.query(f"""
    SELECT s.span_id, len(r.tokens[s.token_start + 1:s.token_end])::INTEGER AS n, sha256('[' || array_to_string(r.tokens[s.token_start + 1:s.token_end], ',') || ']') AS span_hash
    FROM {_SPANS} s JOIN {_ROWS} r ON s.shard_id = r.shard_id AND s.row_id = r.row_id WHERE r.tokens IS NOT NULL
""")
def replay_reconstruct(t: Tables) -> DataFrame:
    """Each span's tokens found again by shard and row."""
    rows = delivered(t.shard_rows, "tokens").where("tokens is not null")
    cut = F.slice("tokens", F.col("token_start") + 1, F.greatest(F.lit(0), F.col("token_end") - F.col("token_start")))
    j = _spans(t, "shard_id", "row_id", "token_start", "token_end").join(rows, ["shard_id", "row_id"])
    return j.select("span_id", F.size(cut).alias("n"), B.span_hash(cut).alias("span_hash"))


@P.query(f"""
    WITH p AS (SELECT run_id, stage, global_step, slot, i AS place FROM (SELECT DISTINCT run_id, stage, global_step, slot FROM {_SPANS}), range(0, 2048) AS r(i))
    SELECT s.span_id, p.place::BIGINT AS place, (s.token_start + greatest(0, least(p.place - s.packed_start - 1, s.token_end - s.token_start)))::BIGINT AS source_offset
    FROM p JOIN {_SPANS} s ON p.run_id = s.run_id AND p.stage = s.stage AND p.global_step = s.global_step AND p.slot = s.slot AND p.place >= s.packed_start AND p.place < s.packed_end
""")
def token_source_trace(t: Tables) -> DataFrame:
    """Every place of the packed sequences to the span it comes from: each span lists its own places, so nothing is joined. Spans without a full sequence key have none."""
    key = ["run_id", "stage", "global_step", "slot"]
    s = _spans(t, *key, "token_start", "token_end", "packed_start", "packed_end").dropna(subset=key).where("packed_end > packed_start")
    j = s.withColumn("place", F.explode(F.sequence(F.col("packed_start").cast("long"), F.col("packed_end").cast("long") - 1)))
    return j.select("span_id", "place", (F.col("token_start") + F.greatest(F.lit(0), F.least(F.col("place") - F.col("packed_start") - 1, F.col("token_end") - F.col("token_start")))).cast("long").alias("source_offset"))


@P.query(f"SELECT run_id, global_step, count(*) AS spans, count(DISTINCT slot) AS sequences, sum(token_end - token_start)::BIGINT AS tokens, sha256(string_agg(span_id::VARCHAR, ',' ORDER BY slot, packed_start, span_id)) AS batch_hash FROM {_SPANS} GROUP BY run_id, global_step")
def batch_summary(t: Tables) -> DataFrame:
    """Spans, sequences, tokens and ordered hash of each batch (bounded by a batch)."""
    s = _spans(t, "run_id", "global_step", "slot", "token_start", "token_end", "packed_start")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "packed_start", "span_id"))), lambda x: x["span_id"].cast("string"))
    return s.groupBy("run_id", "global_step").agg(F.count("*").alias("spans"), F.countDistinct("slot").alias("sequences"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.sha2(F.array_join(ids, ","), 256).alias("batch_hash"))


@P.query(f"SELECT stage, lane, count(*) AS spans, sum(token_end - token_start)::BIGINT AS source_tokens, sum(packed_end - packed_start)::BIGINT AS non_pad FROM {_SPANS} GROUP BY stage, lane")
def token_accounting(t: Tables) -> DataFrame:
    s = _spans(t, "stage", "lane", "token_start", "token_end", "packed_start", "packed_end")
    return s.groupBy("stage", "lane").agg(F.count("*").alias("spans"), F.sum(F.col("token_end") - F.col("token_start")).alias("source_tokens"), F.sum(F.col("packed_end") - F.col("packed_start")).alias("non_pad"))


_RAGGED = "(SELECT l_orderkey, list(l_quantity::INTEGER ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)"


@P.query(f"SELECT l_orderkey, len(q)::INTEGER AS n, array_to_string(list_concat(q, list_transform(range(0, (SELECT max(len(q)) FROM {_RAGGED}) - len(q)), lambda i: 0)), ',') AS padded FROM {_RAGGED}")
def pad_ragged(t: Tables) -> DataFrame:
    """Rows padded with 0 to the longest row's length."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))))
    r = t.lineitem.groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["q"]).alias("q"))
    longest = t.lineitem.groupBy("l_orderkey").count().agg(F.max("count").cast("int").alias("longest"))
    return r.crossJoin(F.broadcast(longest)).select("l_orderkey", F.size("q").alias("n"), F.array_join(F.concat("q", F.array_repeat(F.lit(0), F.col("longest") - F.size("q"))).cast("array<string>"), ",").alias("padded"))


@P.query(f"SELECT shard_id, row_id, s::INTEGER AS window_start, list_sum(tokens[s + 1:s + 129])::BIGINT AS token_sum FROM {_ROWS}, unnest(range(0, greatest(n - 128, 0), 128)) AS u(s) WHERE split = 'validation'")
def eval_windows(t: Tables) -> DataFrame:
    """Fixed windows of 129 tokens, 128 apart, of the validation rows."""
    rows = delivered(t.shard_rows.where("split = 'validation'"), "tokens").where(F.size("tokens") > 128)
    w = rows.withColumn("window_start", F.explode(F.sequence(F.lit(0), F.size("tokens") - 129, F.lit(128))))
    return w.select("shard_id", "row_id", "window_start", F.aggregate(F.slice("tokens", F.col("window_start") + 1, F.lit(129)), F.lit(0).cast("long"), lambda s, x: s + x).alias("token_sum"))


@P.query("""
    WITH l AS (SELECT k - 1 AS k, language FROM (SELECT language, row_number() OVER (ORDER BY language) AS k FROM (SELECT DISTINCT language FROM eval_items))), s AS (SELECT i AS row FROM range(0, 1000) AS r(i))
    SELECT s.row, l.language, (('0x' || sha256('7|3|' || s.row)[1:8])::BIGINT % 4096)::BIGINT AS start FROM s JOIN l ON s.row % (SELECT count(*) FROM l) = l.k
""")
def balanced_windows(t: Tables) -> DataFrame:
    """Row r reads language r modulo their number, from a start hashed of seed, step and row."""
    langs = [r["language"] for r in t.eval_items.select("language").distinct().orderBy("language").collect()]
    pick = F.element_at(F.array(*[F.lit(x) for x in langs]), (F.col("id") % len(langs) + 1).cast("int"))
    start = F.conv(F.substring(F.sha2(F.concat(F.lit("7|3|"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 4096
    return t.spark.range(1000).select(F.col("id").alias("row"), pick.alias("language"), start.alias("start"))


@P.query("SELECT o_orderkey, ceil(o_totalprice / 512)::BIGINT AS rows_needed, (floor(o_totalprice)::BIGINT - (ceil(o_totalprice / 512)::BIGINT - 1) * 512)::BIGINT AS last_length FROM orders")
def partial_window_mask(t: Tables) -> DataFrame:
    """Rows of 512 that hold so many valid places, and the places valid in the last."""
    n = F.ceil(F.col("o_totalprice") / 512)
    return t.orders.select("o_orderkey", n.alias("rows_needed"), (F.floor("o_totalprice") - (n - 1) * 512).alias("last_length"))


@P.query("SELECT i AS step, (i * 37) % 911 AS a, (i * 53) % 911 AS b, 17 + (7 * i) % 300 AS c, 211 + (11 * i) % 300 AS d FROM range(0, 500) AS r(i)")
def stride_windows(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.spark.range(500).select(i.alias("step"), (i * 37 % 911).alias("a"), (i * 53 % 911).alias("b"), (17 + i * 7 % 300).alias("c"), (211 + i * 11 % 300).alias("d"))


@P.query("""
    WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), b AS (SELECT p_partkey, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INTEGER) AS b FROM h)
    SELECT p_partkey, (len(b) + 1)::INTEGER AS n, array_to_string(list_concat([256], b), ',') AS inputs, array_to_string(list_concat(b, [257]), ',') AS targets FROM b
""")
def teacher_forcing(t: Tables) -> DataFrame:
    """Inputs begin with 256, targets end with 257."""
    b = _bytes("p_name")
    r = t.part.select("p_partkey", b.alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return r.select("p_partkey", (F.size("b") + 1).alias("n"), text(F.concat(F.array(F.lit(256)), "b")).alias("inputs"), text(F.concat("b", F.array(F.lit(257)))).alias("targets"))


def _bytes(column: str):
    """Bytes of a short string as whole numbers."""
    h = F.hex(F.encode(F.col(column), "UTF-8"))
    n = F.octet_length(column)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


@P.query("""
    WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part)
    SELECT p_partkey, i::INTEGER AS position, ('0x' || h[2 * i + 1:2 * i + 2])::INTEGER AS target FROM h, unnest(range(0, length(h) // 2)) AS u(i)
""")
def flatten_bytes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(_bytes("p_name")).alias("position", "target"))


@P.query("SELECT g::BIGINT AS gpus, m::BIGINT AS micro, g * m * 2048 * 4 AS tokens FROM range(1, 9) AS a(g), range(1, 9) AS b(m)")
def global_batch_tokens(t: Tables) -> DataFrame:
    g = t.spark.range(1, 9).select(F.col("id").alias("gpus")).crossJoin(t.spark.range(1, 9).select(F.col("id").alias("micro")))
    return g.withColumn("tokens", F.col("gpus") * F.col("micro") * 2048 * 4)


_LOSS = f"(SELECT shard_id, row_id, lane, CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE (x % 10) / 10.0::DOUBLE + 1 END AS loss, x FROM (SELECT shard_id, row_id, lane, unnest(tokens) AS x FROM {_ROWS}))"


@P.query(f"SELECT lane, count(*) AS places, count(*) FILTER (WHERE x <> 0) AS useful, round(sum(loss), 3) AS loss FROM {_LOSS} GROUP BY lane")
def synthetic_token_loss(t: Tables) -> DataFrame:
    """A loss that depends on the token alone: 0 for pads, else its last digit over ten, plus one. Tenths are summed as whole numbers."""
    n, useful, tenths = _loss_sums()
    return _rows(t, "tokens").where("tokens is not null").groupBy("lane").agg(F.sum(n).alias("places"), F.sum(useful).alias("useful"), F.round(F.sum(tenths) / 10.0, 3).alias("loss"))


def _loss_sums():
    tokens = F.col("tokens")
    tenths = F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s + F.when(x == 0, 0).otherwise(x % 10 + 10))
    return F.size(tokens), F.size(F.array_remove(tokens, 0)), tenths


@P.query(f"SELECT shard_id, row_id, round(sum(CASE WHEN x = 0 THEN 0 ELSE x % 10 + 10 END)::DOUBLE / 10.0::DOUBLE / greatest(count(*) FILTER (WHERE x <> 0), 1), 6) AS step_loss FROM {_LOSS} GROUP BY shard_id, row_id")
def synthetic_step_loss(t: Tables) -> DataFrame:
    n, useful, tenths = _loss_sums()
    return delivered(t.shard_rows.where("tokens is not null").select("shard_id", "row_id", "written_at", n.alias("n"), useful.alias("u"), tenths.alias("t")), "n", "u", "t").where("n > 0").select("shard_id", "row_id", F.round(F.col("t") / 10.0 / F.greatest("u", F.lit(1)), 6).alias("step_loss"))


QUERIES, SQL = P.QUERIES, P.SQL
