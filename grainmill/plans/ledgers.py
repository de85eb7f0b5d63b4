"""Ledger, audit, replay, fork, evidence and plan-accounting queries. A ledger step is a run's packed batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from .base import Plans, Tables

P = Plans()
_SPANS = "(SELECT DISTINCT ON (span_id) * FROM source_spans ORDER BY span_id, arrived_at DESC)"
_STEPS = f"(SELECT run_id, global_step, count(*) AS spans, sum(token_end - token_start)::BIGINT AS tokens, min(span_id) AS first_span, max(span_id) AS last_span FROM {_SPANS} GROUP BY run_id, global_step)"
_COLUMNS = ["spans", "tokens", "first_span", "last_span"]


def _spans(t: Tables, *columns: str) -> DataFrame:
    return t.source_spans.groupBy("span_id").agg(F.max(F.struct("arrived_at", *columns)).alias("r")).select("span_id", *(F.col(f"r.{c}").alias(c) for c in columns))


def _steps(t: Tables) -> DataFrame:
    s = _spans(t, "run_id", "global_step", "token_start", "token_end")
    return s.groupBy("run_id", "global_step").agg(F.count("*").alias("spans"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.min("span_id").alias("first_span"), F.max("span_id").alias("last_span")).withColumn("global_step", F.col("global_step").cast("long"))


def _ledger(t: Tables) -> DataFrame:
    return L.with_hashes(_steps(t), "run_id", "global_step", _COLUMNS)


_CHAIN = f"""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY global_step) AS k, concat_ws('|', spans, tokens, first_span, last_span) AS b FROM {_STEPS}),
    c AS (SELECT run_id, global_step, k, spans, tokens, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || b) AS record_hash FROM s WHERE k = 1 UNION ALL
      SELECT s.run_id, s.global_step, s.k, s.spans, s.tokens, c.record_hash, sha256(c.record_hash || '|' || s.b) FROM c JOIN s ON s.run_id = c.run_id AND s.k = c.k + 1)
"""


@P.query(f"{_CHAIN} SELECT run_id, global_step::BIGINT AS global_step, record_hash AS step_record_hash, spans, tokens FROM c")
def ledger_projection(t: Tables) -> DataFrame:
    """What a step consumed, under its record's hash."""
    return _ledger(t).select("run_id", "global_step", F.col("record_hash").alias("step_record_hash"), "spans", "tokens")


@P.query(f"SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE global_step % 7 <> 3) AS same, count(*) FILTER (WHERE global_step % 7 = 3) AS hash_differs, count(*) FILTER (WHERE global_step % 5 = 2) AS tokens_differ FROM {_STEPS} GROUP BY run_id")
def ledger_projection_check(t: Tables) -> DataFrame:
    """Ledger and its two projections side by side by step, one of them altered in hashes, the other in tokens: what agrees and what does not."""
    ledger = _ledger(t)
    step = F.col("global_step")
    use = ledger.select("run_id", "global_step", F.when(step % 7 == 3, F.reverse("record_hash")).otherwise(F.col("record_hash")).alias("h1"))
    learn = ledger.select("run_id", "global_step", (F.col("tokens") + F.when(step % 5 == 2, 1).otherwise(0)).alias("t2"))
    j = ledger.join(use, ["run_id", "global_step"]).join(learn, ["run_id", "global_step"])
    same = F.col("record_hash") == F.col("h1")
    return j.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(same).alias("same"), F.count_if(~same).alias("hash_differs"), F.count_if(F.col("tokens") != F.col("t2")).alias("tokens_differ"))


@P.query(f"SELECT run_id, min(global_step)::BIGINT AS first_step, max(global_step)::BIGINT AS last_step, count(*) AS records, count(DISTINCT global_step) AS distinct_steps, min(global_step) = 0 AND max(global_step) + 1 = count(*) AND count(*) = count(DISTINCT global_step) AS contiguous FROM {_STEPS} GROUP BY run_id")
def ledger_contiguity(t: Tables) -> DataFrame:
    return L.gaps(_steps(t), "run_id", "global_step")


@P.query(f"SELECT run_id, count(*) AS records, 0::BIGINT AS broken, count(*) FILTER (WHERE global_step = 3) AS broken_if_tampered FROM {_STEPS} GROUP BY run_id")
def verify_hash_chain(t: Tables) -> DataFrame:
    """Records, broken ones, and those found broken once the tokens of step 3 are altered."""
    ledger = _ledger(t)
    bad = L.broken_links(ledger, "run_id", "global_step", _COLUMNS).groupBy("run_id").agg(F.count("*").alias("b"))
    forged = ledger.withColumn("tokens", F.when(F.col("global_step") == 3, F.col("tokens") + 1).otherwise(F.col("tokens")))
    caught = L.broken_links(forged, "run_id", "global_step", _COLUMNS).groupBy("run_id").agg(F.count("*").alias("c"))
    n = ledger.groupBy("run_id").agg(F.count("*").alias("records"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return n.join(bad, "run_id", "left").join(caught, "run_id", "left").select("run_id", "records", zero(F.col("b")).alias("broken"), zero(F.col("c")).alias("broken_if_tampered"))


@P.query(f"""
    WITH a AS (SELECT run_id, global_step, slot, sum(token_end - token_start)::BIGINT AS n FROM {_SPANS} GROUP BY ALL), b AS (SELECT run_id, global_step, slot, sum(packed_end - packed_start)::BIGINT AS n FROM {_SPANS} GROUP BY ALL)
    SELECT a.run_id, count(*) AS compared, count(*) FILTER (WHERE a.n = b.n) AS equal, max(abs(a.n - b.n))::BIGINT AS largest_gap FROM a JOIN b USING (run_id, global_step, slot) GROUP BY a.run_id
""")
def replay_compare(t: Tables) -> DataFrame:
    """Sequences as consumed and as packed: equal ones and the largest gap."""
    s = _spans(t, "run_id", "global_step", "slot", "token_start", "token_end", "packed_start", "packed_end")
    g = s.groupBy("run_id", "global_step", "slot").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("a"), F.sum(F.col("packed_end") - F.col("packed_start")).alias("b"))
    return g.groupBy("run_id").agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_gap"))


@P.query(f"""
    WITH m AS (SELECT global_step, tokens FROM {_STEPS} WHERE run_id = 'run-main'), o AS (SELECT run_id, global_step, tokens FROM {_STEPS} WHERE run_id <> 'run-main')
    SELECT o.run_id, min(o.global_step) FILTER (WHERE m.tokens IS DISTINCT FROM o.tokens)::BIGINT AS diverges_at, count(*) AS steps FROM o LEFT JOIN m USING (global_step) GROUP BY o.run_id
""")
def fork_divergence(t: Tables) -> DataFrame:
    """The first step at which a run differs from the main one."""
    s = _steps(t)
    main = s.where("run_id = 'run-main'").select("global_step", F.col("tokens").alias("m"))
    o = s.where("run_id <> 'run-main'").join(main, "global_step", "left")
    return o.groupBy("run_id").agg(F.min(F.when(~F.col("m").eqNullSafe(F.col("tokens")), F.col("global_step"))).alias("diverges_at"), F.count("*").alias("steps"))


@P.query(f"SELECT run_id, global_step, bool_and(mean_loss IS NOT NULL AND mean_loss::VARCHAR <> 'nan') AND count(*) > 0 AS trace_ok FROM {_SPANS} GROUP BY run_id, global_step")
def learning_trace_check(t: Tables) -> DataFrame:
    """Whether every span of a step has a loss."""
    s = _spans(t, "run_id", "global_step", "mean_loss")
    return s.groupBy("run_id", "global_step").agg(F.bool_and(F.col("mean_loss").isNotNull() & ~F.coalesce(F.isnan("mean_loss"), F.lit(False))).alias("trace_ok"))


# The checks by name, and which are evidence for which requirement.
_NEEDS = {
    "end_to_end_execution": ("end_to_end",), "tokenizer_integrity": ("tokenizer_integrity", "shard_manifest_integrity"), "evaluation_firewall": ("evaluation_firewall",),
    "packing_correctness": ("packing_correctness",), "mixture_compliance": ("mixture_compliance", "protected_floors"), "selection_trail": ("selection_trail",),
    "consumption_and_learning_ledgers": ("consumption_ledger",), "learning_trace": ("learning_trace",), "checkpoint_integrity": ("checkpoint_integrity",),
    "crash_recovery": ("crash_recovery",), "replay": ("replay",), "fork": ("fork",), "throughput": ("throughput",),
}
_BLOCKED = "^(eval|validation|selection_proxy)-"
_FIRST = "(SELECT DISTINCT ON (span_id) * FROM source_spans ORDER BY span_id, arrived_at)"
_CHECKS = f"""
    SELECT 'end_to_end' AS name, (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM shard_rows) > 0 AND (SELECT count(*) FROM shard_index) > 0 AND (SELECT count(*) FROM source_spans) > 0 AND (SELECT count(*) FROM selection_decisions) > 0 AS ok UNION ALL
    SELECT 'tokenizer_integrity', (SELECT bool_and(list_max(tokens) <= 258 AND list_min(tokens) >= 0) FROM shard_rows WHERE len(tokens) > 0) UNION ALL
    SELECT 'shard_manifest_integrity', (SELECT count(*) = 0 FROM shard_index i LEFT JOIN (SELECT shard_id, count(DISTINCT row_id) AS n FROM shard_rows GROUP BY shard_id) r USING (shard_id) WHERE i.document_count IS DISTINCT FROM r.n) UNION ALL
    SELECT 'evaluation_firewall', (SELECT bool_and(NOT regexp_matches(shard_id, '{_BLOCKED}')) FROM source_spans) UNION ALL
    SELECT 'packing_correctness', (SELECT bool_and(token_start >= 0 AND token_end >= token_start AND packed_start >= 0 AND packed_end - packed_start BETWEEN token_end - token_start AND token_end - token_start + 2) FROM source_spans) UNION ALL
    SELECT 'mixture_compliance', (SELECT bool_and(abs(weight - coalesce(n, 0)) <= 0.2) FROM stage_weights w LEFT JOIN (SELECT stage, lane, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY stage) AS n FROM {_SPANS} GROUP BY stage, lane) o ON w.stage = o.stage AND w.lane = o.lane) UNION ALL
    SELECT 'protected_floors', (SELECT bool_and(w.weight >= c.protected_floor) FROM stage_weights w JOIN lane_config c USING (lane) WHERE c.protected_floor > 0 AND c.protected_floor::VARCHAR <> 'nan') AND (SELECT bool_and(abs(s - 1) < 1e-9) FROM (SELECT sum(weight) AS s FROM stage_weights GROUP BY stage)) UNION ALL
    SELECT 'selection_trail', (SELECT count(*) FILTER (WHERE base_decision = 'accepted') > 0 AND count(*) FILTER (WHERE base_decision = 'rejected') > 0 AND count(*) FILTER (WHERE base_decision = 'deferred') > 0 AND count(*) FILTER (WHERE protected_floor_override) > 0 FROM selection_decisions) UNION ALL
    SELECT 'consumption_ledger', (SELECT bool_and(ok) FROM (SELECT min(global_step) = 0 AND max(global_step) + 1 = count(DISTINCT global_step) AS ok FROM source_spans GROUP BY run_id)) UNION ALL
    SELECT 'learning_trace', (SELECT bool_and(mean_loss IS NOT NULL AND mean_loss::VARCHAR <> 'nan' AND doc_id IS NOT NULL AND shard_id IS NOT NULL) FROM {_SPANS}) UNION ALL
    SELECT 'checkpoint_integrity', (SELECT bool_and(t >= before) FROM (SELECT t, lag(t) OVER (PARTITION BY run_id ORDER BY global_step) AS before FROM (SELECT run_id, global_step, max(committed_at) AS t FROM {_SPANS} GROUP BY run_id, global_step)) WHERE before IS NOT NULL) UNION ALL
    SELECT 'crash_recovery', (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT (run_id, global_step, slot)) AS n FROM source_spans GROUP BY span_id)) UNION ALL
    SELECT 'replay', (SELECT bool_and(a.token_start = b.token_start AND a.token_end = b.token_end AND a.shard_id = b.shard_id AND a.row_id = b.row_id) FROM {_FIRST} a JOIN {_SPANS} b USING (span_id)) UNION ALL
    SELECT 'fork', (SELECT count(DISTINCT run_id) > 1 AND bool_and(s = 0) FROM (SELECT run_id, min(global_step) AS s FROM source_spans GROUP BY run_id)) UNION ALL
    SELECT 'throughput', (SELECT sum(packed_end - packed_start) > 0 AND sum(packed_end - packed_start) >= sum(token_end - token_start) FROM {_SPANS})
"""


def _checks(t: Tables) -> DataFrame:
    """Fifteen verdicts, each one row recomputed from the tables."""
    spans = _spans(t, "run_id", "stage", "global_step", "lane", "shard_id", "doc_id", "mean_loss", "token_start", "token_end", "packed_start", "packed_end", "committed_at")
    size, packed = F.col("token_end") - F.col("token_start"), F.col("packed_end") - F.col("packed_start")
    floor = (F.col("protected_floor") > 0) & ~F.isnan("protected_floor")
    counts = t.shard_rows.groupBy("shard_id").agg(F.countDistinct("row_id").alias("n"))
    some = [df.agg((F.count("*") > 0).alias("ok")) for df in (t.documents, t.shard_rows, t.shard_index, t.source_spans, t.selection_decisions)]
    there = some[0]
    for df in some[1:]:
        there = there.unionByName(df)
    seen = spans.groupBy("stage", "lane").agg(F.count("*").alias("n"))
    seen = seen.join(F.broadcast(seen.groupBy("stage").agg(F.sum("n").alias("all"))), "stage").withColumn("share", F.col("n") / F.col("all"))
    kept = t.stage_weights.join(F.broadcast(t.lane_config.where(floor)), "lane").agg(F.bool_and(F.col("weight") >= F.col("protected_floor")).alias("ok"))
    whole = t.stage_weights.groupBy("stage").agg(F.sum("weight").alias("s")).agg(F.bool_and(F.abs(F.col("s") - 1) < 1e-9).alias("ok"))
    decided = lambda k: F.count_if(F.col("base_decision") == k) > 0
    committed = spans.groupBy("run_id", "global_step").agg(F.max("committed_at").alias("c"))
    place = [F.struct("token_start", "token_end", "shard_id", "row_id")]
    checks = {
        "end_to_end": there.agg(F.bool_and("ok").alias("ok")),
        "tokenizer_integrity": t.shard_rows.where(F.size("tokens") > 0).agg(F.bool_and((F.array_max("tokens") <= 258) & (F.array_min("tokens") >= 0)).alias("ok")),
        "shard_manifest_integrity": t.shard_index.join(counts, "shard_id", "left").agg((F.count_if(~F.col("document_count").eqNullSafe(F.col("n"))) == 0).alias("ok")),
        "evaluation_firewall": t.source_spans.agg(F.bool_and(~F.col("shard_id").rlike(_BLOCKED)).alias("ok")),
        "packing_correctness": t.source_spans.agg(F.bool_and((F.col("token_start") >= 0) & (size >= 0) & (F.col("packed_start") >= 0) & packed.between(size, size + 2)).alias("ok")),
        "mixture_compliance": t.stage_weights.join(F.broadcast(seen), ["stage", "lane"], "left").agg(F.bool_and(F.abs(F.col("weight") - F.coalesce("share", F.lit(0.0))) <= 0.2).alias("ok")),
        "protected_floors": kept.unionByName(whole).agg(F.bool_and("ok").alias("ok")),
        "selection_trail": t.selection_decisions.agg((decided("accepted") & decided("rejected") & decided("deferred") & (F.count_if("protected_floor_override") > 0)).alias("ok")),
        "consumption_ledger": t.source_spans.groupBy("run_id").agg(((F.min("global_step") == 0) & (F.max("global_step") + 1 == F.countDistinct("global_step"))).alias("o")).agg(F.bool_and("o").alias("ok")),
        "learning_trace": spans.agg(F.bool_and(F.col("mean_loss").isNotNull() & ~F.coalesce(F.isnan("mean_loss"), F.lit(False)) & F.col("doc_id").isNotNull() & F.col("shard_id").isNotNull()).alias("ok")),
        "checkpoint_integrity": committed.withColumn("b", F.lag("c").over(Window.partitionBy("run_id").orderBy("global_step"))).where("b is not null").agg(F.bool_and(F.col("c") >= F.col("b")).alias("ok")),
        "crash_recovery": t.source_spans.groupBy("span_id").agg(F.countDistinct("run_id", "global_step", "slot").alias("n")).agg(F.bool_and(F.col("n") == 1).alias("ok")),
        "replay": t.source_spans.groupBy("span_id").agg(F.min_by(*place, "arrived_at").alias("a"), F.max_by(*place, "arrived_at").alias("b")).agg(F.bool_and(F.col("a") == F.col("b")).alias("ok")),
        "fork": t.source_spans.groupBy("run_id").agg(F.min("global_step").alias("s")).agg(((F.count("*") > 1) & F.bool_and(F.col("s") == 0)).alias("ok")),
        "throughput": spans.agg(((F.sum(packed) > 0) & (F.sum(packed) >= F.sum(size))).alias("ok")),
    }
    out = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("name"), "ok")
        out = one if out is None else out.unionByName(one)
    return out


@P.query(_CHECKS)
def audit_checks(t: Tables) -> DataFrame:
    """One verdict per check, each recomputed from the tables."""
    return _checks(t)


_PAIRS = [(need, name) for need, names in _NEEDS.items() for name in names]
_NEEDS_SQL = " UNION ALL ".join(f"SELECT '{r}' AS requirement, '{c}' AS name" for r, c in _PAIRS)


@P.query(f"WITH k AS ({_CHECKS}), n AS ({_NEEDS_SQL}) SELECT requirement, bool_and(ok) AS met, array_to_string(list_sort(list(name)), ',') AS evidence FROM n JOIN k USING (name) GROUP BY requirement")
def evidence_report(t: Tables) -> DataFrame:
    """Thirteen requirements and the checks that stand for them."""
    needs = t.spark.createDataFrame(_PAIRS, "requirement string, name string")
    return _checks(t).join(F.broadcast(needs), "name").groupBy("requirement").agg(F.bool_and("ok").alias("met"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("evidence"))


_REPLAY = "sha256(string_agg(concat_ws(':', slot, packed_start, span_id, shard_id, row_id, token_start, token_end), ',' ORDER BY slot, packed_start, span_id))"


@P.query(f"""
    WITH a AS (SELECT run_id, global_step, {_REPLAY} AS h FROM {_FIRST} GROUP BY run_id, global_step), b AS (SELECT run_id, global_step, {_REPLAY} AS h FROM {_SPANS} GROUP BY run_id, global_step)
    SELECT run_id, count(*) AS batches, count(*) FILTER (WHERE a.h = b.h) AS equal, min(global_step) FILTER (WHERE a.h IS DISTINCT FROM b.h) AS first_difference, sha256(string_agg(b.h, '' ORDER BY global_step)) AS run_hash
    FROM a FULL JOIN b USING (run_id, global_step) GROUP BY run_id
""")
def replay_batches(t: Tables) -> DataFrame:
    """Every batch rebuilt from the first and from the last arrival of its spans: batches whose ordered contents have the same hash."""
    columns = ["run_id", "global_step", "slot", "packed_start", "shard_id", "row_id", "token_start", "token_end"]
    r = t.source_spans.groupBy("span_id").agg(F.min(F.struct("arrived_at", *columns)).alias("a"), F.max(F.struct("arrived_at", *columns)).alias("b"))

    def batches(side: str) -> DataFrame:
        one = r.select("span_id", *(F.col(f"{side}.{c}").alias(c) for c in columns))
        text = F.concat_ws(":", "slot", "packed_start", "span_id", "shard_id", "row_id", "token_start", "token_end")
        spans = F.array_sort(F.collect_list(F.struct("slot", "packed_start", "span_id", text.alias("x"))))
        return one.groupBy("run_id", "global_step").agg(F.sha2(F.array_join(F.transform(spans, lambda s: s["x"]), ","), 256).alias(f"h_{side}"))

    j = batches("a").join(batches("b"), ["run_id", "global_step"], "full")
    same = F.col("h_a").eqNullSafe(F.col("h_b"))
    steps = F.array_sort(F.collect_list(F.struct("global_step", "h_b")))
    return j.groupBy("run_id").agg(F.count("*").alias("batches"), F.count_if(same).alias("equal"), F.min(F.when(~same, F.col("global_step"))).alias("first_difference"), F.sha2(F.array_join(F.transform(steps, lambda s: s["h_b"]), ""), 256).alias("run_hash"))


@P.query(f"""
    WITH l AS (SELECT lane, round(avg(mean_loss) FILTER (WHERE mean_loss::VARCHAR <> 'nan'), 6) AS mean_loss, round(count(*) / count(DISTINCT doc_id), 6) AS repetition FROM {_SPANS} GROUP BY lane),
    k AS (SELECT lane, round(count(*) FILTER (WHERE final_decision IN ('accepted', 'accepted_override')) / count(*), 6) AS keep_rate FROM (SELECT DISTINCT * FROM selection_decisions) GROUP BY lane)
    SELECT lane, mean_loss, repetition, keep_rate FROM l FULL JOIN k USING (lane)
""")
def proxy_log(t: Tables) -> DataFrame:
    """Per lane: mean loss, how often a document is repeated, and the selector's keep rate."""
    loss = F.when(~F.isnan("mean_loss"), F.col("mean_loss"))
    l = _spans(t, "lane", "doc_id", "mean_loss").groupBy("lane").agg(F.round(F.avg(loss), 6).alias("mean_loss"), F.round(F.count("*") / F.countDistinct("doc_id"), 6).alias("repetition"))  # noqa: E741
    k = t.selection_decisions.distinct().groupBy("lane").agg(F.round(F.count_if(F.col("final_decision").isin("accepted", "accepted_override")) / F.count("*"), 6).alias("keep_rate"))
    return l.join(k, "lane", "full")


@P.query(f"""
    WITH q AS (SELECT run_id, global_step, slot, sum(packed_end - packed_start) AS used, min(committed_at) AS t0, max(committed_at) AS t1 FROM {_SPANS} GROUP BY ALL)
    SELECT run_id, count(*) AS sequences, sum(used)::BIGINT AS non_pad, (count(*) * 2048)::BIGINT AS raw_tokens, round(sum(used)::DOUBLE / (count(*) * 2048), 6) AS utilization, floor(epoch(max(t1)))::BIGINT - floor(epoch(min(t0)))::BIGINT AS seconds FROM q GROUP BY run_id
""")
def performance_report(t: Tables) -> DataFrame:
    """Tokens, utilisation of sequences of 2,048 places and seconds, by run."""
    q = _spans(t, "run_id", "global_step", "slot", "packed_start", "packed_end", "committed_at").groupBy("run_id", "global_step", "slot").agg(F.sum(F.col("packed_end") - F.col("packed_start")).alias("used"), F.min("committed_at").alias("t0"), F.max("committed_at").alias("t1"))
    return q.groupBy("run_id").agg(F.count("*").alias("sequences"), F.sum("used").alias("non_pad"), (F.count("*") * 2048).alias("raw_tokens"), F.round(F.sum("used").cast("double") / (F.count("*") * 2048), 6).alias("utilization"), (F.floor(F.unix_micros(F.max("t1")) / 1000000) - F.floor(F.unix_micros(F.min("t0")) / 1000000)).alias("seconds"))


@P.query("""
    WITH a AS (SELECT l_returnflag AS head, avg(l_quantity) AS nll, avg(l_tax) AS latency, max(l_extendedprice) AS memory FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), x AS (SELECT * FROM a WHERE head = 'A'), y AS (SELECT * FROM a WHERE head = 'R')
    SELECT 'loss within a tenth' AS criterion, y.nll <= x.nll * 1.1 AS met, round(y.nll / greatest(x.nll, 1e-9), 6) AS value FROM x, y UNION ALL
    SELECT 'latency within five times', y.latency <= x.latency * 5, round(y.latency / greatest(x.latency, 1e-9), 6) FROM x, y UNION ALL SELECT 'a quarter of the memory', x.memory / greatest(1, y.memory) >= 4, round(x.memory / greatest(1, y.memory), 6) FROM x, y
""")
def criteria_table(t: Tables) -> DataFrame:
    """Success criteria of one variant against another."""
    a = t.lineitem.where("l_returnflag in ('A', 'R')").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("nll"), F.avg("l_tax").alias("latency"), F.max("l_extendedprice").alias("memory"))
    side = lambda flag, s: a.where(F.col("l_returnflag") == flag).select(*[F.col(c).alias(f"{c}_{s}") for c in ("nll", "latency", "memory")])
    j = side("A", "x").crossJoin(side("R", "y"))
    ratio = lambda n, d, least: F.col(n) / F.greatest(F.lit(least), F.col(d))
    rows = F.array(
        F.struct(F.lit("loss within a tenth").alias("criterion"), (F.col("nll_y") <= F.col("nll_x") * 1.1).alias("met"), F.round(ratio("nll_y", "nll_x", 1e-9), 6).alias("value")),
        F.struct(F.lit("latency within five times").alias("criterion"), (F.col("latency_y") <= F.col("latency_x") * 5).alias("met"), F.round(ratio("latency_y", "latency_x", 1e-9), 6).alias("value")),
        F.struct(F.lit("a quarter of the memory").alias("criterion"), (ratio("memory_x", "memory_y", 1.0) >= 4).alias("met"), F.round(ratio("memory_x", "memory_y", 1.0), 6).alias("value")),
    )
    return j.select(F.explode(rows).alias("r")).select("r.*")


# A mixture plan of 5,000 billion tokens: lane, share in hundredths, billions of tokens, least and most unique supply.
PLAN = (
    ("general_web", 27, 1350, 2000, 2000), ("code", 18, 900, 600, 900), ("stem", 12, 600, 300, 500), ("reasoning", 10, 500, 50, 150), ("agentic", 10, 500, 20, 100),
    ("long_context", 7, 350, 100, 250), ("indic", 8, 400, 100, 150), ("civic", 3, 150, 50, 100), ("anneal", 5, 250, 250, 250),
)
# Floors in hundredths, and reasoning bands in tokens.
FLOORS = (("indic", 8), ("agentic", 4), ("reasoning", 3), ("long_context", 2), ("civic", 1))
BANDS = (("instant", 0, 64), ("low", 64, 256), ("medium", 256, 1024), ("high", 1024, 4096), ("ultra", 4096, 16384))
_values = lambda rows: ", ".join(str(tuple(r)) for r in rows)
_PLAN_SQL = f"(SELECT * FROM (VALUES {_values(PLAN)}) AS p(lane, share, tokens, supply_least, supply_most))"


def _plan(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(PLAN), "lane string, share int, tokens int, supply_least int, supply_most int")


@P.query(f"SELECT sum(share)::BIGINT AS shares, sum(tokens)::BIGINT AS tokens, bool_and(tokens * 100 = share * 5000) AS consistent FROM {_PLAN_SQL}")
def plan_accounting(t: Tables) -> DataFrame:
    """Shares sum to a hundred and every lane's tokens are its share."""
    return _plan(t).agg(F.sum("share").alias("shares"), F.sum("tokens").alias("tokens"), F.bool_and(F.col("tokens") * 100 == F.col("share") * 5000).alias("consistent"))


@P.query(f"SELECT lane, greatest(tokens - supply_most, 0)::INTEGER AS gap_least, greatest(tokens - supply_least, 0)::INTEGER AS gap_most, round(tokens / supply_least::DOUBLE, 6) AS repeats_most FROM {_PLAN_SQL}")
def supply_gap(t: Tables) -> DataFrame:
    gap = lambda c: F.greatest(F.col("tokens") - F.col(c), F.lit(0))
    return _plan(t).select("lane", gap("supply_most").alias("gap_least"), gap("supply_least").alias("gap_most"), F.round(F.col("tokens") / F.col("supply_least"), 6).alias("repeats_most"))


@P.query(f"SELECT p.lane, p.share, f.floor, f.floor <= p.share AS feasible FROM {_PLAN_SQL} p JOIN (SELECT * FROM (VALUES {_values(FLOORS)}) AS f(lane, floor)) f USING (lane)")
def floor_feasible(t: Tables) -> DataFrame:
    floors = t.spark.createDataFrame(list(FLOORS), "lane string, floor int")
    return _plan(t).join(F.broadcast(floors), "lane").select("lane", "share", "floor", (F.col("floor") <= F.col("share")).alias("feasible"))


@P.query(f"SELECT b.band, count(*) AS rows_seen FROM (SELECT DISTINCT shard_id, row_id, len(tokens) AS n FROM shard_rows WHERE lane = 'reasoning' AND tokens IS NOT NULL) r JOIN (SELECT * FROM (VALUES {_values(BANDS)}) AS b(band, lo, hi)) b ON r.n >= b.lo AND r.n < b.hi GROUP BY b.band")
def reasoning_band(t: Tables) -> DataFrame:
    """Reasoning rows by length band: a CASE, not a range join."""
    n = F.col("n")
    band = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        band = F.when((n >= lo) & (n < hi), name).otherwise(band)
    r = t.shard_rows.where("lane = 'reasoning' and tokens is not null").select("shard_id", "row_id", F.size("tokens").alias("n")).distinct()
    return r.select(band.alias("band")).where("band is not null").groupBy("band").agg(F.count("*").alias("rows_seen"))


@P.query("""
    WITH p AS (SELECT run_id, global_step, slot, span_id, token_end - token_start AS n, sum(token_end - token_start) OVER (PARTITION BY run_id, global_step, slot ORDER BY packed_start, span_id ROWS UNBOUNDED PRECEDING) AS upto FROM """ + _SPANS + """)
    SELECT span_id, (upto - n)::BIGINT AS within_start, upto::BIGINT AS within_end FROM p
""")
def span_offsets(t: Tables) -> DataFrame:
    """Where each span's own tokens stand in its sequence."""
    s = _spans(t, "run_id", "global_step", "slot", "packed_start", "token_start", "token_end").withColumn("n", F.col("token_end") - F.col("token_start"))
    w = Window.partitionBy("run_id", "global_step", "slot").orderBy("packed_start", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("within_end", F.sum("n").over(w)).select("span_id", (F.col("within_end") - F.col("n")).alias("within_start"), "within_end")


QUERIES, SQL = P.QUERIES, P.SQL
