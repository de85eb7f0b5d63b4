"""Mixture, selection and batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import delivered
from ..operators.mixture import alignment, decide, quotas, schedule
from ..operators.ranking import ranked
from ..session import cut_lineage
from .base import Plans, Tables

P = Plans()
BATCH, STEPS, TOTAL = 8, 4, 997
_DECISIONS = "(SELECT DISTINCT stage_index, doc_id, lane, base_decision, final_decision, reason, protected_floor_override, gradient_alignment, quality, decision_id, shard_id, row_id FROM selection_decisions)"


def _floors(t: Tables) -> DataFrame:
    return t.lane_config.where("protected_floor > 0 and not isnan(protected_floor)").groupBy("lane").agg(F.max("protected_floor").alias("floor"))


_QUOTAS = """
    w AS (SELECT s.stage, s.stage_index, s.lane, s.weight, ({total})::BIGINT AS total, ({least})::BIGINT AS least FROM stage_weights s LEFT JOIN f ON s.lane = f.lane),
    b AS (SELECT *, greatest(least, floor(weight * total))::BIGINT AS base FROM w),
    o AS (SELECT *, weight * total - base AS due, (total - sum(base) OVER (PARTITION BY stage))::BIGINT AS open FROM b),
    u AS (SELECT stage, lane, open, CASE WHEN open >= 0 THEN -(due - k) ELSE due + k END AS key, CASE WHEN open >= 0 THEN -1 ELSE 1 END AS way
      FROM o, unnest(range(0, CASE WHEN open >= 0 THEN open ELSE least(-open, base - least) END)) AS r(k)),
    names AS (SELECT lane, row_number() OVER (ORDER BY lane) AS name FROM (SELECT DISTINCT lane FROM stage_weights)),
    r AS (SELECT stage, u.lane, open, row_number() OVER (PARTITION BY stage ORDER BY key, way * name) AS k FROM u JOIN names USING (lane)),
    g AS (SELECT stage, lane, count(*) AS units FROM r WHERE k <= abs(open) GROUP BY stage, lane),
    q AS (SELECT o.stage, o.stage_index, o.lane, o.weight, (base + sign(open) * coalesce(units, 0))::BIGINT AS quota FROM o LEFT JOIN g ON o.stage = g.stage AND o.lane = g.lane)
"""
_F = "f AS (SELECT lane, max(protected_floor) AS floor FROM lane_config WHERE protected_floor > 0 AND protected_floor::VARCHAR <> 'nan' GROUP BY lane)"


@P.query(f"WITH {_F}, {_QUOTAS.format(total=TOTAL, least=0)} SELECT stage, lane, quota FROM q")
def lane_quotas(t: Tables) -> DataFrame:
    """Largest-remainder quotas of a stage's sequences."""
    return quotas(t.stage_weights.select("stage", "stage_index", "lane", "weight"), "stage", TOTAL).select("stage", "lane", "quota")


@P.query(f"WITH {_F}, {_QUOTAS.format(total=BATCH * STEPS, least=f'coalesce(ceil(f.floor * {BATCH}), 0) * {STEPS}')} SELECT stage, lane, quota FROM q")
def floor_quotas(t: Tables) -> DataFrame:
    """Quotas of a short stage, lifted to the floors' slots in every batch."""
    w = t.stage_weights.select("stage", "stage_index", "lane", "weight").join(F.broadcast(_floors(t)), "lane", "left")
    return quotas(w, "stage", BATCH * STEPS, F.coalesce(F.ceil(F.col("floor") * BATCH), F.lit(0)) * STEPS).select("stage", "lane", "quota")


_SCHEDULE = f"""
    WITH RECURSIVE {_F}, {_QUOTAS.format(total=BATCH * STEPS, least=f'coalesce(ceil(f.floor * {BATCH}), 0) * {STEPS}')},
    st AS (SELECT q.stage, stage_index, list(q.lane ORDER BY q.lane) AS lanes, list(weight ORDER BY q.lane) AS w, list(quota ORDER BY q.lane) AS quota,
      list(q.lane ORDER BY q.lane) FILTER (WHERE f.floor IS NOT NULL) AS held FROM q LEFT JOIN f ON q.lane = f.lane GROUP BY q.stage, stage_index),
    s AS (
      SELECT stage, 0 AS n, list_transform(lanes, lambda x: 0::BIGINT) AS used, NULL::VARCHAR AS lane FROM st UNION ALL
      SELECT stage, n + 1, list_transform(range(1, len(lanes) + 1), lambda i: used[i] + CASE WHEN lanes[i] = pick THEN 1 ELSE 0 END), pick
      FROM (
        SELECT s.stage, s.n, s.used, st.lanes, CASE WHEN s.n % {BATCH} < coalesce(len(held), 0) THEN held[s.n % {BATCH} + 1]
          ELSE list_reverse_sort(list_transform(coalesce(nullif(list_filter(range(1, len(lanes) + 1), lambda i: used[i] < quota[i]), []), range(1, len(lanes) + 1)), lambda i: {{'due': w[i] * (s.n + 1) - used[i], 'lane': lanes[i]}}))[1].lane END AS pick
        FROM s JOIN st ON s.stage = st.stage WHERE s.n < {BATCH * STEPS}
      )
    ),
    sched AS (SELECT s.stage, ((dense_rank() OVER (ORDER BY stage_index, s.stage) - 1) * {STEPS} + (n - 1) // {BATCH})::INTEGER AS batch, ((n - 1) % {BATCH})::INTEGER AS slot, lane FROM s JOIN st ON s.stage = st.stage WHERE n > 0)
"""


@P.query(f"{_SCHEDULE} SELECT stage, batch, slot, lane FROM sched")
def lane_schedule(t: Tables) -> DataFrame:
    """stage, batch, slot, lane of every sequence: floors first in each batch, then the lane furthest behind."""
    return schedule(t.stage_weights.select("stage", "stage_index", "lane", "weight"), _floors(t), BATCH, STEPS)


@P.query(f"""{_SCHEDULE},
    pool AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lane) AS n FROM documents WHERE split = 'train' AND lane IS NOT NULL),
    c AS (SELECT *, row_number() OVER (PARTITION BY stage, lane ORDER BY batch, slot) - 1 AS cursor FROM sched),
    built AS (SELECT stage, batch, string_agg(c.lane || ':' || doc_id, ',' ORDER BY slot) AS members FROM c JOIN pool p ON p.lane = c.lane AND p.k = c.cursor % p.n GROUP BY stage, batch)
    SELECT stage, batch, printf('batch-%04d-%s', batch, sha256(members)[1:16]) AS batch_id, members FROM built
""")
def built_batches(t: Tables) -> DataFrame:
    """The schedule's batches filled from their lanes' pools: a cursor of each stage and lane goes round its pool. The id holds a hash of the contents."""
    pool = ranked(_train(t).select("lane", "doc_id"), ["lane"], [F.asc("doc_id")], "k")
    n = pool.groupBy("lane").agg(F.count("*").alias("n"))
    # The schedule is as small as the stages' batches; pools are joined by place.
    slots = lane_schedule(t).withColumn("cursor", F.row_number().over(Window.partitionBy("stage", "lane").orderBy("batch", "slot")) - 1)
    placed = slots.join(n, "lane").withColumn("k", F.col("cursor") % F.col("n") + 1).join(pool, ["lane", "k"])
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.concat_ws(":", "lane", "doc_id").alias("m")))), lambda x: x["m"]), ",")
    return placed.groupBy("stage", "batch").agg(members.alias("members")).select("stage", "batch", F.format_string("batch-%04d-%s", "batch", F.substring(F.sha2("members", 256), 1, 16)).alias("batch_id"), "members")


@P.query("""
    WITH c AS (SELECT stage, lane, sum(weight) OVER (PARTITION BY stage ORDER BY lane) AS upto, sum(weight) OVER (PARTITION BY stage ORDER BY lane) - weight AS since FROM stage_weights),
    d AS (SELECT stage, i AS draw, ('0x' || sha256('11|' || stage || '|' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT stage FROM stage_weights), range(0, 1000) AS r(i))
    SELECT d.stage, draw, lane FROM d JOIN c ON d.stage = c.stage AND u >= since AND u < upto
""")
def random_lanes(t: Tables) -> DataFrame:
    """A lane drawn by weight for each of a thousand slots, from a hash of seed, stage and slot: to be stored, and the same when drawn again."""
    w = Window.partitionBy("stage").orderBy("lane")
    c = t.stage_weights.select("stage", "lane", F.sum("weight").over(w).alias("upto"), (F.sum("weight").over(w) - F.col("weight")).alias("since"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("11"), "stage", "draw"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    d = t.stage_weights.select("stage").distinct().crossJoin(t.spark.range(1000).withColumnRenamed("id", "draw")).withColumn("u", u)
    return d.join(F.broadcast(c), "stage").where((F.col("u") >= F.col("since")) & (F.col("u") < F.col("upto"))).select("stage", "draw", "lane")


@P.query("""
    WITH d AS (SELECT DISTINCT stage_index, doc_id FROM selection_decisions), s AS (SELECT shard_id, split, lane FROM shard_index)
    SELECT 'decision' AS kind, printf('sel-%02d-%04d', stage_index, row_number() OVER (PARTITION BY stage_index ORDER BY doc_id) - 1) AS id FROM d UNION ALL
    SELECT 'shard', split || '-' || coalesce(lane, 'none') || '-' || sha256(shard_id)[1:12] FROM s
""")
def formatted_ids(t: Tables) -> DataFrame:
    """Ids of decisions (stage, ordinal) and of shards (split, lane, hash)."""
    k = ranked(t.selection_decisions.select("stage_index", "doc_id").distinct(), ["stage_index"], [F.asc("doc_id")], "k")
    a = k.select(F.lit("decision").alias("kind"), F.format_string("sel-%02d-%04d", "stage_index", F.col("k") - 1).alias("id"))
    b = t.shard_index.select(F.lit("shard").alias("kind"), F.concat_ws("-", "split", F.coalesce("lane", F.lit("none")), F.substring(F.sha2("shard_id", 256), 1, 12)).alias("id"))
    return a.unionByName(b)


def _train(t: Tables) -> DataFrame:
    return t.documents.where("split = 'train' and lane is not null")


_ALIGN = """
    WITH rows_ AS (SELECT DISTINCT ON (shard_id, row_id) * FROM shard_rows ORDER BY shard_id, row_id, written_at DESC),
    pref AS (SELECT shard_id, row_id, doc_id, split, tokens[1:16] AS p FROM rows_ WHERE len(tokens) > 1),
    pr AS (SELECT shard_id, row_id, doc_id, split, p[i] AS x, p[i + 1] AS y FROM pref, unnest(range(1, len(p))) AS u(i)),
    ref2 AS (SELECT x, y, count(*) AS r FROM pr WHERE split = 'selection_proxy' GROUP BY x, y), ref1 AS (SELECT x, sum(r) AS r FROM ref2 GROUP BY x),
    own2 AS (SELECT doc_id, x, y, count(*) AS c FROM pr WHERE split = 'train' GROUP BY doc_id, x, y), own1 AS (SELECT doc_id, x, sum(c) AS c FROM own2 GROUP BY doc_id, x),
    a AS (SELECT doc_id, sum(c * coalesce(r, 0)) AS cr, sum(c * c) AS cc FROM own2 LEFT JOIN ref2 USING (x, y) GROUP BY doc_id),
    b AS (SELECT doc_id, sum(c * coalesce(r, 0)) AS nr, sum(c * c) AS nn FROM own1 LEFT JOIN ref1 USING (x) GROUP BY doc_id),
    w AS (SELECT (SELECT sum(r * r) FROM ref2) AS rr2, (SELECT sum(r * r) FROM ref1) AS rr1),
    s AS (SELECT doc_id, round((cr - nr / 259.0::DOUBLE) / (sqrt(cc - nn / 259.0::DOUBLE) * sqrt(rr2 - rr1 / 259.0::DOUBLE)), 9) AS alignment FROM a JOIN b USING (doc_id), w),
    docs AS (SELECT d.doc_id, d.lane, d.min_stage, CASE WHEN quality BETWEEN 0 AND 1 AND quality::VARCHAR <> 'nan' THEN quality ELSE 0.5 END AS quality, s.alignment FROM documents d LEFT JOIN s USING (doc_id) WHERE d.split = 'train' AND d.lane IS NOT NULL),
    st AS (SELECT DISTINCT stage, stage_index FROM stage_weights), every AS (SELECT * FROM docs, st),
    ok AS (SELECT *, row_number() OVER g AS rank, count(*) OVER (PARTITION BY stage_index, lane) AS n FROM every WHERE min_stage <= stage_index AND alignment IS NOT NULL WINDOW g AS (PARTITION BY stage_index, lane ORDER BY alignment DESC, quality DESC, doc_id)),
    lim AS (SELECT ok.*, greatest(1, ceil(n * 0.4::DOUBLE)) AS acc, CASE WHEN n >= 3 THEN greatest(1, ceil(n * 0.3::DOUBLE)) ELSE 0 END AS def, coalesce(CASE WHEN c.protected_floor > 0 AND c.protected_floor::VARCHAR <> 'nan' THEN (n * 6) // 10 END, 0) AS need FROM ok LEFT JOIN lane_config c USING (lane)),
    dec AS (SELECT stage, stage_index, doc_id, lane, rank, CASE WHEN rank <= acc THEN 'accepted' WHEN rank <= acc + def THEN 'deferred' ELSE 'rejected' END AS base_decision, (rank > acc AND rank <= least(n, need)) AS rescued FROM lim)
"""


def _decisions(t: Tables) -> DataFrame:
    rows = delivered(t.shard_rows.where("split in ('train', 'selection_proxy')").select("shard_id", "row_id", "written_at", "doc_id", "split", F.slice("tokens", 1, 16).alias("tokens")), "doc_id", "split", "tokens")
    scores = alignment(rows.where("split = 'train'"), rows.where("split = 'selection_proxy'")).select("doc_id", "alignment")
    quality = F.when((F.col("quality") >= 0) & (F.col("quality") <= 1), F.col("quality")).otherwise(0.5)
    # Scored once; need, candidates and the rest all start here.
    docs = cut_lineage(_train(t).select("doc_id", "lane", "min_stage", quality.alias("quality")).join(scores, "doc_id", "left"))
    stages = t.stage_weights.select("stage", "stage_index").distinct()
    # The exposures that a protected lane needs: here six tenths of its eligible documents.
    eligible = docs.where("alignment is not null").crossJoin(F.broadcast(stages)).where("min_stage <= stage_index").groupBy("stage_index", "lane").agg(F.count("*").alias("n"))
    guarded = t.lane_config.where("protected_floor > 0 and not isnan(protected_floor)").select("lane")
    need = eligible.join(F.broadcast(guarded), "lane").select("stage_index", "lane", F.floor(F.col("n") * 6 / 10).alias("need"))
    return decide(docs, stages, need)


@P.query(f"""{_ALIGN}
    SELECT stage, stage_index, doc_id, lane, rank, base_decision FROM dec UNION ALL
    SELECT stage, stage_index, doc_id, lane, NULL, 'deferred' FROM every WHERE NOT (min_stage <= stage_index AND alignment IS NOT NULL)
""")
def select_decisions(t: Tables) -> DataFrame:
    return _decisions(t).select("stage", "stage_index", "doc_id", "lane", "rank", "base_decision")


@P.query(f"{_ALIGN} SELECT stage_index, lane, count(*) AS overrides FROM dec WHERE rescued GROUP BY stage_index, lane")
def protected_override(t: Tables) -> DataFrame:
    return _decisions(t).where("final_decision = 'accepted_override'").groupBy("stage_index", "lane").agg(F.count("*").alias("overrides"))


def _admitted(t: Tables) -> DataFrame:
    return t.selection_decisions.where(F.col("final_decision").isin("accepted", "accepted_override"))


@P.query("SELECT DISTINCT shard_id, row_id, doc_id, lane FROM shard_rows r WHERE split = 'train' AND EXISTS (SELECT 1 FROM selection_decisions d WHERE d.doc_id = r.doc_id AND d.lane = r.lane AND d.stage_index = 1 AND d.final_decision IN ('accepted', 'accepted_override'))")
def admitted_rows(t: Tables) -> DataFrame:
    rows = t.shard_rows.where("split = 'train'").select("shard_id", "row_id", "doc_id", "lane")
    return rows.join(_admitted(t).where("stage_index = 1").select("doc_id", "lane"), ["doc_id", "lane"], "left_semi").distinct()


@P.query("""
    WITH s AS (SELECT DISTINCT ON (span_id) span_id, stage, doc_id FROM source_spans ORDER BY span_id, arrived_at DESC), d AS (SELECT DISTINCT stage, doc_id, decision_id, final_decision FROM selection_decisions)
    SELECT s.span_id, d.decision_id, d.final_decision FROM s LEFT JOIN d ON s.stage = d.stage AND s.doc_id = d.doc_id
""")
def attach_decisions(t: Tables) -> DataFrame:
    """Each span with its document's decision of the stage."""
    decisions = t.selection_decisions.select("stage", "doc_id", "decision_id", "final_decision").distinct()
    return _spans(t, "stage", "doc_id").join(decisions, ["stage", "doc_id"], "left").select("span_id", "decision_id", "final_decision")


def _spans(t: Tables, *columns: str) -> DataFrame:
    """One row per span: the last to arrive."""
    return t.source_spans.groupBy("span_id").agg(F.max(F.struct("arrived_at", *columns)).alias("r")).select("span_id", *(F.col(f"r.{c}").alias(c) for c in columns))


@P.query("""
    WITH s AS (SELECT DISTINCT ON (span_id) span_id, run_id, stage, global_step, slot, doc_id FROM source_spans ORDER BY span_id, arrived_at DESC), d AS (SELECT DISTINCT stage, doc_id, decision_id FROM selection_decisions)
    SELECT run_id, global_step, slot, array_to_string(list_sort(list_distinct(list(decision_id))), ',') AS decision_ids FROM s JOIN d ON s.stage = d.stage AND s.doc_id = d.doc_id GROUP BY ALL
""")
def pack_decision_ids(t: Tables) -> DataFrame:
    """Sorted distinct decisions of each pack (bounded by the spans of one sequence)."""
    d = t.selection_decisions.select("stage", "doc_id", "decision_id").distinct()
    s = _spans(t, "run_id", "stage", "global_step", "slot", "doc_id").join(d, ["stage", "doc_id"])
    return s.groupBy("run_id", "global_step", "slot").agg(F.array_join(F.array_sort(F.collect_set("decision_id")), ",").alias("decision_ids"))


@P.query(f"SELECT stage_index, lane, count(*) FILTER (WHERE final_decision = 'accepted') AS accepted, count(*) FILTER (WHERE final_decision = 'deferred') AS deferred, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected, count(*) FILTER (WHERE protected_floor_override) AS overrides FROM {_DECISIONS} GROUP BY stage_index, lane")
def decision_summary(t: Tables) -> DataFrame:
    d = t.selection_decisions.distinct()
    kind = lambda k: F.count_if(F.col("final_decision") == k)
    return d.groupBy("stage_index", "lane").agg(kind("accepted").alias("accepted"), kind("deferred").alias("deferred"), kind("rejected").alias("rejected"), F.count_if("protected_floor_override").alias("overrides"))


@P.query(f"SELECT lane, count(*) AS decisions, round(count(*) FILTER (WHERE final_decision IN ('accepted', 'accepted_override')) / count(*), 9) AS keep_rate FROM {_DECISIONS} GROUP BY lane")
def selector_keep_rate(t: Tables) -> DataFrame:
    keep = F.count_if(F.col("final_decision").isin("accepted", "accepted_override"))
    return t.selection_decisions.distinct().groupBy("lane").agg(F.count("*").alias("decisions"), F.round(keep / F.count("*"), 9).alias("keep_rate"))


@P.query("SELECT d.doc_id, d.lane FROM documents d JOIN lane_config c USING (lane) WHERE (c.protected_floor > 0 AND c.protected_floor::VARCHAR <> 'nan') OR (d.quality >= 0.7 AND d.quality::VARCHAR <> 'nan')")
def threshold_select(t: Tables) -> DataFrame:
    """Protected lanes bypass the threshold."""
    guarded = (F.col("protected_floor") > 0) & ~F.isnan("protected_floor")
    return t.documents.join(F.broadcast(t.lane_config.select("lane", "protected_floor")), "lane").where(F.coalesce(guarded, F.lit(False)) | ((F.col("quality") >= 0.7) & ~F.isnan("quality"))).select("doc_id", "lane")


@P.query("SELECT i::INTEGER AS step, round(greatest(0, least(1, (i - 20) / 60.0::DOUBLE)), 9) AS mix FROM range(0, 101) AS r(i)")
def linear_mix(t: Tables) -> DataFrame:
    """An annealing ramp: 0 before its start, 1 after its end."""
    return t.spark.range(101).select(F.col("id").cast("int").alias("step"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("id") - 20) / F.lit(60.0))), 9).alias("mix"))


@P.query("""
    WITH s AS (SELECT DISTINCT ON (span_id) stage, lane FROM source_spans ORDER BY span_id, arrived_at DESC), o AS (SELECT stage, lane, count(*) AS n FROM s GROUP BY stage, lane)
    SELECT coalesce(w.stage, o.stage) AS stage, coalesce(w.lane, o.lane) AS lane, w.weight AS planned, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY coalesce(w.stage, o.stage)), 9) AS observed FROM stage_weights w FULL JOIN o ON w.stage = o.stage AND w.lane = o.lane
""")
def mixture_compliance(t: Tables) -> DataFrame:
    """Planned against observed lane shares of the spans, by stage."""
    o = _spans(t, "stage", "lane").groupBy("stage", "lane").agg(F.count("*").alias("n"))
    both = t.stage_weights.select("stage", "lane", F.col("weight").alias("planned")).join(o, ["stage", "lane"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = both.groupBy("stage").agg(F.sum("n").alias("total"))
    return both.join(F.broadcast(total), "stage").select("stage", "lane", "planned", F.round(F.col("n") / F.col("total"), 9).alias("observed"))


@P.query("""
    WITH pool AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lane) AS n FROM documents WHERE split = 'train' AND lane IS NOT NULL),
    slots AS (SELECT lane, unnest(range(0, 2 * n + 3)) AS slot FROM (SELECT lane, any_value(n) AS n FROM pool GROUP BY lane) JOIN (SELECT DISTINCT lane FROM lane_config) USING (lane)) SELECT s.lane, s.slot::BIGINT AS slot, p.doc_id FROM slots s JOIN pool p ON p.lane = s.lane AND p.k = s.slot % p.n
""")
def round_robin_assign(t: Tables) -> DataFrame:
    """Each slot of a lane takes the lane's next document, from the start again when all are used: two rounds of every pool and three slots more."""
    pool = ranked(_train(t).select("lane", "doc_id"), ["lane"], [F.asc("doc_id")], "k")
    n = pool.groupBy("lane").agg(F.count("*").alias("n"))
    # A pool's places and the slots that come round to them; no lane's slots are listed in one row.
    rounds = pool.join(F.broadcast(t.lane_config.select("lane").distinct()), "lane", "left_semi").join(n, "lane").withColumn("slot", F.explode(F.expr("sequence(k - 1, 2 * n + 2, n)")))
    return rounds.select("lane", "slot", "doc_id")


QUERIES, SQL = P.QUERIES, P.SQL
