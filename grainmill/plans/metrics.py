"""Evaluation, telemetry, optimiser and vector queries.

lineitem, orders and events stand for runs and their measurements: an order is a microbatch or sequence, its lines the
losses in it; event types are layers, users are runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine as cos
from ..functions.numeric import dot
from .base import Plans, Tables

P = Plans()
#: Sums of doubles are taken over whole hundredths, so that their order cannot show.
_CENTS = "round(l_extendedprice * 100)::BIGINT"


def _cents(column: str = "l_extendedprice"):
    return F.round(F.col(column) * 100).cast("long")


@P.query(f"""
    WITH m AS (SELECT l_returnflag, l_orderkey, sum({_CENTS})::DOUBLE AS loss, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, round(sum(loss) / sum(n), 4) AS token_weighted, round(avg(loss / n), 4) AS mean_of_means FROM m GROUP BY l_returnflag
""")
def weighted_vs_naive_mean(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_returnflag", "l_orderkey").agg(F.sum(_cents()).cast("double").alias("loss"), F.sum("l_quantity").cast("double").alias("n"))
    return m.groupBy("l_returnflag").agg(F.round(F.sum("loss") / F.sum("n"), 4).alias("token_weighted"), F.round(F.avg(F.col("loss") / F.col("n")), 4).alias("mean_of_means"))


@P.query(f"SELECT l_orderkey, round(coalesce(sum({_CENTS}) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE / greatest(count(*) FILTER (WHERE l_returnflag = 'R'), 1), 6) AS masked_mean FROM lineitem GROUP BY l_orderkey")
def masked_mean(t: Tables) -> DataFrame:
    on = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.when(on, _cents()).otherwise(0)).cast("double") / F.greatest(F.count_if(on), F.lit(1)), 6).alias("masked_mean"))


_SPAN_LOSS = "(SELECT DISTINCT ON (span_id) span_id, stage, lane, round(mean_loss * 1000000)::BIGINT AS micro, token_end - token_start AS n FROM source_spans WHERE mean_loss IS NOT NULL AND mean_loss::VARCHAR <> 'nan' ORDER BY span_id, arrived_at DESC)"


def _span_loss(t: Tables) -> DataFrame:
    good = t.source_spans.where("mean_loss is not null and not isnan(mean_loss)")
    last = good.groupBy("span_id").agg(F.max(F.struct("arrived_at", "stage", "lane", "mean_loss", (F.col("token_end") - F.col("token_start")).alias("n"))).alias("r"))
    return last.select("span_id", "r.stage", "r.lane", F.round(F.col("r.mean_loss") * 1000000).cast("long").alias("micro"), "r.n")


@P.query(f"SELECT stage, round(exp(least(avg(micro) / 1000000, 20)), 6) AS perplexity FROM {_SPAN_LOSS} GROUP BY stage")
def perplexity(t: Tables) -> DataFrame:
    return _span_loss(t).groupBy("stage").agg(F.round(F.exp(F.least(F.avg("micro") / 1000000, F.lit(20.0))), 6).alias("perplexity"))


@P.query(f"SELECT lane, round(sum(micro * n)::DOUBLE / 1000000 / sum(n) / ln(2.0::DOUBLE), 6) AS bits_per_byte FROM {_SPAN_LOSS} GROUP BY lane")
def bits_per_byte(t: Tables) -> DataFrame:
    """Summed loss over bytes (a token is a byte), in bits."""
    return _span_loss(t).groupBy("lane").agg(F.round(F.sum(F.col("micro") * F.col("n")).cast("double") / 1000000 / F.sum("n") / math.log(2.0), 6).alias("bits_per_byte"))


_EVAL = """(SELECT coalesce(d.language, '') AS language, CASE WHEN n <= 256 THEN 'short' WHEN n <= 1024 THEN 'middle' ELSE 'long' END AS bucket, n, quality >= 0.5 AND quality::VARCHAR <> 'nan' AS exact
    FROM (SELECT language, quality, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL) d)"""


def _eval(t: Tables) -> DataFrame:
    n = F.octet_length("text")
    bucket = F.when(n <= 256, "short").when(n <= 1024, "middle").otherwise("long")
    return t.documents.where("text is not null").select(F.coalesce("language", F.lit("")).alias("language"), bucket.alias("bucket"), n.alias("n"), ((F.col("quality") >= 0.5) & ~F.isnan("quality")).alias("exact"))


@P.query(f"SELECT language, bucket, count(*) AS rows_seen, sum(n)::BIGINT AS bytes, round(sum(exact::INTEGER) / greatest(count(*), 1), 9) AS exact_rate FROM {_EVAL} GROUP BY GROUPING SETS ((), (language), (bucket))")
def eval_grouping_sets(t: Tables) -> DataFrame:
    """Overall, by label and by length class in one pass."""
    exact = F.round(F.coalesce(F.sum(F.col("exact").cast("int")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 9)
    e = _eval(t)
    return e.groupingSets([[], ["language"], ["bucket"]], "language", "bucket").agg(F.count("*").alias("rows_seen"), F.sum("n").alias("bytes"), exact.alias("exact_rate"))


@P.query(f"SELECT language, count(*) AS rows_seen, round(coalesce(sum(exact::INTEGER), 0) / greatest(count(*), 1), 9) AS exact_rate, round(coalesce(sum(exact::INTEGER) FILTER (WHERE n <= 512), 0) / greatest(count(*) FILTER (WHERE n <= 512), 1), 9) AS short_exact, round(coalesce(sum(exact::INTEGER) FILTER (WHERE n > 512), 0) / greatest(count(*) FILTER (WHERE n > 512), 1), 9) AS long_exact FROM {_EVAL} GROUP BY language")
def decode_metrics(t: Tables) -> DataFrame:
    """Exact rates, and those of the short and long subsets."""
    ok = F.coalesce(F.col("exact"), F.lit(False))
    rate = lambda on: F.round(F.count_if(on & ok) / F.greatest(F.count_if(on), F.lit(1)), 9)
    return _eval(t).groupBy("language").agg(F.count("*").alias("rows_seen"), rate(F.lit(True)).alias("exact_rate"), rate(F.col("n") <= 512).alias("short_exact"), rate(F.col("n") > 512).alias("long_exact"))


_SWEEP = f"(SELECT l_returnflag AS schedule, l_linenumber AS width, l_tax AS lr, avg({_CENTS}) / 100 AS loss, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"


def _sweep(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("schedule"), F.col("l_linenumber").alias("width"), F.col("l_tax").alias("lr")).agg((F.avg(_cents()) / 100).alias("loss"), F.count("*").alias("n"))


@P.query(f"SELECT schedule, width, arg_min(lr, (round(loss, 6), lr)) AS best_lr, round(min(loss), 6) AS loss FROM {_SWEEP} GROUP BY schedule, width")
def best_lr(t: Tables) -> DataFrame:
    """The rate of least loss, the smaller one among equals."""
    return _sweep(t).groupBy("schedule", "width").agg(F.min_by("lr", F.struct(F.round("loss", 6), "lr")).alias("best_lr"), F.round(F.min("loss"), 6).alias("loss"))


@P.query(f"SELECT schedule, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS sd FROM {_SWEEP} GROUP BY schedule")
def seed_summary_pop(t: Tables) -> DataFrame:
    return _sweep(t).groupBy("schedule").agg(F.round(F.avg("loss"), 6).alias("mean"), F.round(F.stddev_pop("loss"), 6).alias("sd"))


@P.query(f"SELECT schedule, width, round(avg(loss), 6) AS mean, round(coalesce(stddev_samp(loss), 0), 6) AS sd, max(n) AS most FROM {_SWEEP} GROUP BY schedule, width")
def seed_summary_samp(t: Tables) -> DataFrame:
    return _sweep(t).groupBy("schedule", "width").agg(F.round(F.avg("loss"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("loss"), F.lit(0.0)), 6).alias("sd"), F.max("n").alias("most"))


@P.query(f"SELECT l_returnflag AS schedule, l_linenumber AS step, round(avg({_CENTS}), 4) AS loss FROM lineitem GROUP BY 1, 2")
def mean_curve(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("schedule"), F.col("l_linenumber").alias("step")).agg(F.round(F.avg(_cents()), 4).alias("loss"))


@P.query(f"""
    WITH b AS (SELECT schedule, width, arg_min(lr, (round(loss, 6), lr)) + 0.01 AS lr FROM {_SWEEP} GROUP BY schedule, width), r AS (SELECT schedule, regr_slope(ln(lr::DOUBLE), ln(width::DOUBLE)) AS slope, regr_intercept(ln(lr::DOUBLE), ln(width::DOUBLE)) AS intercept, max(lr) / min(lr) AS spread FROM b GROUP BY schedule)
    SELECT schedule, round(slope, 6) AS slope, round(exp(intercept + slope * ln(4096.0::DOUBLE)), 9) AS lr_4096, CASE WHEN spread <= 2 THEN 'high' WHEN spread <= 4 THEN 'medium' ELSE 'low' END AS confidence FROM r
""")
def loglog_extrapolate(t: Tables) -> DataFrame:
    """Log-log least squares of the best rate on width, carried on to width 4,096."""
    b = _sweep(t).groupBy("schedule", "width").agg((F.min_by("lr", F.struct(F.round("loss", 6), "lr")) + 0.01).alias("lr"))
    y, x = F.log("lr"), F.log(F.col("width").cast("double"))
    r = b.groupBy("schedule").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("i"), (F.max("lr") / F.min("lr")).alias("spread"))
    level = F.when(F.col("spread") <= 2, "high").when(F.col("spread") <= 4, "medium").otherwise("low")
    return r.select("schedule", F.round("slope", 6).alias("slope"), F.round(F.exp(F.col("i") + F.col("slope") * math.log(4096.0)), 9).alias("lr_4096"), level.alias("confidence"))


@P.query("SELECT label, round(sqrt(sum(x * x)), 4) AS norm FROM (SELECT label, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings) GROUP BY label")
def global_norm(t: Tables) -> DataFrame:
    e = t.embeddings.select("label", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.round(x.cast("double"), 6) * F.round(x.cast("double"), 6)).alias("q"))
    return e.groupBy("label").agg(F.round(F.sqrt(F.sum("q")), 4).alias("norm"))


@P.query("SELECT l_shipmode, gap FROM (SELECT l_linestatus AS l_shipmode, round(max(abs(l_discount - l_tax)), 6) AS gap FROM lineitem GROUP BY 1)")
def max_abs_gap(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.round(F.max(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("gap"))


@P.query("SELECT event_type, round(median(value), 6) AS p50, round(max(value), 6) AS p95 FROM events WHERE value IS NOT NULL AND value::VARCHAR <> 'nan' GROUP BY event_type")
def latency_summary(t: Tables) -> DataFrame:
    """The median, and the maximum under the name of a 95th percentile, as few samples make it."""
    return t.events.where("value is not null and not isnan(value)").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("p50"), F.round(F.max("value"), 6).alias("p95"))


@P.query("SELECT count(*) AS parameters, sum(p_size)::BIGINT AS size FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)")
def unique_param_count(t: Tables) -> DataFrame:
    """Shared parameters count once."""
    return t.part.select("p_brand", "p_type", "p_size").distinct().agg(F.count("*").alias("parameters"), F.sum("p_size").alias("size"))


@P.query("SELECT l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS nll FROM lineitem GROUP BY l_suppkey")
def scatter_add(t: Tables) -> DataFrame:
    """Step losses summed to the row they belong to."""
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(_cents()).alias("nll"))


_SERIES = "(SELECT event_type, event_id, value, lag(value) OVER w AS before, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING) AS smooth, row_number() OVER w AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"


@P.query("""
    WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 4) AS v FROM events GROUP BY 1, 2),
    s AS (SELECT *, row_number() OVER w AS step, abs(n - lag(n) OVER w) / greatest(lag(n) OVER w, 1e-12) AS nc, abs(v - lag(v) OVER w) / greatest(lag(v) OVER w, 1e-12) AS lc FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    c AS (SELECT user_id, step, round(nc, 6) AS nc, round(lc, 6) AS lc, CASE WHEN nc >= 0.05 AND lc <= 0.005 THEN 0 ELSE 1 END AS late FROM s WHERE nc IS NOT NULL AND lc IS NOT NULL)
    SELECT user_id, step, nc AS norm_change, lc AS loss_change FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY late, CASE WHEN late = 0 THEN step::DOUBLE ELSE -round(nc - lc, 5) END, step) AS k FROM c) WHERE k = 1
""")
def gradient_lead(t: Tables) -> DataFrame:
    """Per run the first step at which the norm moved by 5 % while the loss moved by at most half a percent, else that of the largest difference."""
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    change = lambda c: F.abs(F.col(c) - F.lag(c).over(w)) / F.greatest(F.lag(c).over(w).cast("double"), F.lit(1e-12))
    s = d.select("user_id", F.row_number().over(w).cast("long").alias("step"), change("n").alias("nc"), change("v").alias("lc")).where("nc is not null and lc is not null")
    late = F.when((F.col("nc") >= 0.05) & (F.col("lc") <= 0.005), 0).otherwise(1)
    c = s.select("user_id", "step", F.round("nc", 6).alias("norm_change"), F.round("lc", 6).alias("loss_change"), late.alias("late"))
    by = F.when(F.col("late") == 0, F.col("step").cast("double")).otherwise(-F.round(F.col("norm_change") - F.col("loss_change"), 5))
    first = F.min_by(F.struct("step", "norm_change", "loss_change"), F.struct("late", by, "step"))
    return c.groupBy("user_id").agg(first.alias("f")).select("user_id", "f.step", "f.norm_change", "f.loss_change")


@P.query("""
    WITH s AS (SELECT user_id, row_number() OVER w AS step, (value < 40) AS ok, bool_and(value < 40) OVER f AS all_ok, count(*) OVER f AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT user_id, min(step) AS stable_from FROM s WHERE all_ok AND n = 3 GROUP BY user_id
""")
def stable_from_step(t: Tables) -> DataFrame:
    """The first step from which three measurements in a row stay below a limit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = w.rowsBetween(0, 2)
    s = t.events.select("user_id", F.row_number().over(w).cast("long").alias("step"), F.bool_and(F.col("value") < 40).over(f).alias("ok"), F.count("*").over(f).alias("n"))
    return s.where("ok and n = 3").groupBy("user_id").agg(F.min("step").alias("stable_from"))


@P.query("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS first_step FROM lineitem WHERE l_orderkey >= 100 GROUP BY 1, 2")
def first_step_ge(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey >= 100").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_orderkey").alias("first_step"))


@P.query("SELECT o_orderkey AS step FROM orders WHERE o_orderkey = 1 OR o_orderkey % 50 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def log_points(t: Tables) -> DataFrame:
    """The first, every fiftieth and the last step."""
    last = t.orders.agg(F.max("o_orderkey").alias("last"))
    return t.orders.crossJoin(F.broadcast(last)).where("o_orderkey = 1 or o_orderkey % 50 = 0 or o_orderkey = last").select(F.col("o_orderkey").alias("step"))


_ADAM = """
    WITH RECURSIVE a(step, m, v, w) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE UNION ALL
      SELECT step + 1, 0.9::DOUBLE * m + 0.1::DOUBLE * g, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g,
        w - 0.001::DOUBLE * ((0.9::DOUBLE * m + 0.1::DOUBLE * g) / (1 - pow(0.9::DOUBLE, step + 1))) / (sqrt((0.999::DOUBLE * v + 0.001::DOUBLE * g * g) / (1 - pow(0.999::DOUBLE, step + 1))) + 1e-8::DOUBLE)
      FROM (SELECT *, 0.2::DOUBLE * sin(0.7::DOUBLE * (step + 1)) + 0.05::DOUBLE * cos(0.13::DOUBLE * (step + 1)) AS g FROM a WHERE step < 200))
"""


@P.query(f"{_ADAM} SELECT step::BIGINT AS step, round(m, 9) AS m, round(v, 9) AS v, round(w, 9) AS weight FROM a WHERE step > 0")
def adam_trace(t: Tables) -> DataFrame:
    """The optimiser's two moments and weight, step by step: a fold whose state is kept at each step."""
    return _adam(t).select("step", F.round("m", 9).alias("m"), F.round("v", 9).alias("v"), F.round("w", 9).alias("weight"))


def _adam(t: Tables) -> DataFrame:
    i = F.sequence(F.lit(1), F.lit(200))
    grads = F.transform(i, lambda k: F.struct(k.cast("double").alias("k"), (F.sin(k * 0.7) * 0.2 + F.cos(k * 0.13) * 0.05).alias("g")))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0.8).alias("w"))

    def step(s, x):
        m, v = s["last"]["m"] * 0.9 + x["g"] * 0.1, s["last"]["v"] * 0.999 + x["g"] * x["g"] * 0.001
        w = s["last"]["w"] - (m / (1 - F.pow(F.lit(0.9), x["k"]))) * 0.001 / (F.sqrt(v / (1 - F.pow(F.lit(0.999), x["k"]))) + 1e-8)
        now = F.struct(m.alias("m"), v.alias("v"), w.alias("w"))
        return F.struct(now.alias("last"), F.concat(s["all"], F.array(now)).alias("all"))

    start = F.struct(zero.alias("last"), F.array().cast("array<struct<m:double,v:double,w:double>>").alias("all"))
    states = F.aggregate(grads, start, step, lambda s: s["all"])
    return t.spark.range(1).select(F.posexplode(states).alias("k", "s")).select((F.col("k") + 1).cast("long").alias("step"), "s.m", "s.v", "s.w")


@P.query(f"{_ADAM}, u AS (SELECT step, m / (1 - pow(0.9::DOUBLE, step)) / (sqrt(v / (1 - pow(0.999::DOUBLE, step))) + 1e-8::DOUBLE) AS c, m / (sqrt(v) + 1e-8::DOUBLE) AS r FROM a WHERE step > 0) SELECT step::BIGINT AS step, round(abs(r - c) / greatest(abs(c), 1e-12::DOUBLE), 6) AS gap FROM u")
def bias_gap(t: Tables) -> DataFrame:
    """How far an uncorrected update is from the corrected one."""
    k = F.col("step").cast("double")
    c = F.col("m") / (1 - F.pow(F.lit(0.9), k)) / (F.sqrt(F.col("v") / (1 - F.pow(F.lit(0.999), k))) + 1e-8)
    r = F.col("m") / (F.sqrt("v") + 1e-8)
    return _adam(t).select("step", F.round(F.abs(r - c) / F.greatest(F.abs(c), F.lit(1e-12)), 6).alias("gap"))


@P.query("SELECT p_partkey, round(p_size / (p_retailprice + 1e-12::DOUBLE), 9) AS ratio FROM part")
def update_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.col("p_size") / (F.col("p_retailprice") + 1e-12), 9).alias("ratio"))


@P.query("WITH x AS (SELECT i / 10.0::DOUBLE AS x FROM range(1, 101) AS r(i)) SELECT round(x, 1) AS x, round((pow(x + 0.01, 3) - pow(x - 0.01, 3)) / 0.02, 6) AS centred, round((pow(x + 0.01, 3) - pow(x, 3)) / 0.01, 6) AS one_sided FROM x")
def finite_diff(t: Tables) -> DataFrame:
    x = F.col("id") / F.lit(10.0)
    f = lambda v: F.pow(v, F.lit(3.0))
    return t.spark.range(1, 101).select(F.round(x, 1).alias("x"), F.round((f(x + 0.01) - f(x - 0.01)) / 0.02, 6).alias("centred"), F.round((f(x + 0.01) - f(x)) / 0.01, 6).alias("one_sided"))


@P.query("""
    SELECT i AS step,
      round(CASE WHEN i < 10 THEN (i + 1) / 10.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * (i - 10) / 190.0::DOUBLE)) END, 9) AS cosine_zero,
      round(CASE WHEN i <= 10 THEN i / 10.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (i - 10) / 190.0::DOUBLE)) END, 9) AS cosine_floor,
      round(CASE WHEN i <= 10 THEN i / 10.0::DOUBLE WHEN i <= 180 THEN 1.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (i - 180) / 20.0::DOUBLE)) END, 9) AS wsd,
      round(least((i + 1) / 10.0::DOUBLE, 0.5 * (1 + cos(pi() * greatest(0, i - 10) / 190.0::DOUBLE))), 9) AS least_of_both,
      round(greatest(0.5, 1 - 0.5 * i / 200.0::DOUBLE), 9) AS linear
    FROM range(0, 201) AS r(i)
""")
def lr_schedules(t: Tables) -> DataFrame:
    """Warm-up of 10 of 200 steps, then cosine to 0, cosine to a tenth, stable with a late cosine, the lesser of line and cosine, line to a half."""
    i = F.col("id")
    half = lambda a, n: (F.cos((i - a) * math.pi / n) + 1) * 0.5
    up = i / F.lit(10.0)
    return t.spark.range(201).select(
        i.alias("step"),
        F.round(F.when(i < 10, (i + 1) / F.lit(10.0)).otherwise(half(10, 190.0)), 9).alias("cosine_zero"),
        F.round(F.when(i <= 10, up).otherwise(half(10, 190.0) * 0.9 + 0.1), 9).alias("cosine_floor"),
        F.round(F.when(i <= 10, up).when(i <= 180, 1.0).otherwise(half(180, 20.0) * 0.9 + 0.1), 9).alias("wsd"),
        F.round(F.least((i + 1) / F.lit(10.0), (F.cos(F.greatest(F.lit(0), i - 10) * math.pi / 190.0) + 1) * 0.5), 9).alias("least_of_both"),
        F.round(F.greatest(F.lit(0.5), 1 - i * 0.5 / 200.0), 9).alias("linear"),
    )


@P.query("SELECT o_orderkey, round(6 * 1e6::DOUBLE * o_totalprice / CASE WHEN o_orderstatus = 'O' THEN 1e12::DOUBLE END, 9) AS mfu FROM orders")
def mfu(t: Tables) -> DataFrame:
    """6 N tokens/s over the peak; null where no peak is known."""
    peak = F.when(F.col("o_orderstatus") == "O", F.lit(1e12))
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 6e6 / peak, 9).alias("mfu"))


@P.query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)
    SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[64], e.embedding::DOUBLE[64]) / (sqrt(list_dot_product(q.embedding::DOUBLE[64], q.embedding::DOUBLE[64])) * sqrt(list_dot_product(e.embedding::DOUBLE[64], e.embedding::DOUBLE[64]))), 6) AS similarity FROM q, embeddings e
""")
def cosine(t: Tables) -> DataFrame:
    """Similarities of the query set (ids divisible by 50) to all vectors."""
    from ..operators.vectors import similarities

    return similarities(t.embeddings, "vec_id", "embedding")


_NEAREST = """
    WITH q AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.embedding::DOUBLE[64]) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.embedding::DOUBLE[64], e.embedding::DOUBLE[64]))), 6) AS similarity FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
"""


@P.query(f"{_NEAREST} SELECT query_id, vec_id, similarity FROM r WHERE rank = 1")
def codebook_nn(t: Tables) -> DataFrame:
    """The nearest other vector of each query, by exact search of all rows in blocks; the first id among equals."""
    from ..operators.vectors import nearest

    return nearest(t.embeddings, "vec_id", "embedding", 1).select("query_id", "vec_id", "similarity")


@P.query(f"{_NEAREST} SELECT query_id, vec_id, rank, similarity FROM r WHERE rank <= 5")
def topk_neighbors(t: Tables) -> DataFrame:
    from ..operators.vectors import nearest

    return nearest(t.embeddings, "vec_id", "embedding", 5)


@P.query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[64], embedding::DOUBLE[64]) / 64), 6) AS rms FROM embeddings")
def rms(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding")) / F.size("embedding")), 6).alias("rms"))


_CE = "(SELECT vec_id, embedding::DOUBLE[] AS x, (label % 64)::INTEGER + 1 AS y FROM embeddings)"


def _ce(t: Tables) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    top = F.array_max(x)
    lse = F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top
    return t.embeddings.select("vec_id", "label", (lse - F.element_at(x, (F.col("label") % 64 + 1).cast("int"))).alias("ce"))


@P.query(f"SELECT vec_id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[y], 6) AS ce FROM {_CE}")
def cross_entropy(t: Tables) -> DataFrame:
    return _ce(t).select("vec_id", F.round("ce", 6).alias("ce"))


@P.query(f"SELECT count(*) AS rows_seen, round(avg(round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[y], 6)), 5) AS mean_ce FROM {_CE}")
def chunked_ce(t: Tables) -> DataFrame:
    """Sums of chunks of 128 rows, then their total: the same as over all rows."""
    parts = _ce(t).groupBy(F.floor(F.col("vec_id") / 128)).agg(F.sum(F.round("ce", 6)).alias("s"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("rows_seen"), F.round(F.sum("s") / F.sum("n"), 5).alias("mean_ce"))


@P.query("SELECT p_brand, max(p_size) FILTER (WHERE p_retailprice <= 0.7 * 2000) AS max_batch FROM part GROUP BY p_brand")
def max_safe_batch(t: Tables) -> DataFrame:
    """The largest batch of a probe table that stays below 70 % of memory."""
    return t.part.groupBy("p_brand").agg(F.max(F.when(F.col("p_retailprice") <= 0.7 * 2000, F.col("p_size"))).alias("max_batch"))


@P.query()
def beam_search_table(t: Tables) -> DataFrame:
    """Best paths of length four over a transition table (which event type follows which), three beams."""
    from ..operators.beam import beam_search

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").count()
    totals = pairs.groupBy("src").agg(F.sum("count").alias("all"))
    moves = pairs.join(totals, "src").select("src", "dst", F.log(F.col("count") / F.col("all")).alias("logp"))
    return beam_search(moves, width=3, length=4)


# Predictions: a name with its last bytes missing, and for every seventh a byte that no UTF-8 has.
_PREDICTED = """
    (SELECT p_brand, target, length(target) AS n, left_ = target AND NOT broken AS exact, NOT broken AS valid, NOT broken AND left_ IN (SELECT p_name FROM part) AS known, levenshtein(target, left_) + broken::INTEGER AS errors
     FROM (SELECT p_brand, p_name AS target, p_name[1:length(p_name) - p_partkey % 3] AS left_, p_partkey % 7 = 0 AS broken FROM part))
"""
_RATES = "count(*) AS tokens, sum(n)::BIGINT AS bytes, round(sum(exact::INTEGER) / greatest(count(*), 1), 9) AS exact_accuracy, round(sum(valid::INTEGER) / greatest(count(*), 1), 9) AS valid_utf8_rate, round(sum(known::INTEGER) / greatest(count(*), 1), 9) AS known_vocab_rate"


def _predicted(t: Tables) -> DataFrame:
    cut = F.substring(F.col("p_name"), F.lit(1), (F.length("p_name") - F.col("p_partkey") % 3).cast("int"))
    raw = F.concat(F.hex(F.encode(cut, "UTF-8")), F.when(F.col("p_partkey") % 7 == 0, "FF").otherwise(""))
    p = t.part.select("p_brand", F.col("p_name").alias("target"), cut.alias("left"), F.unhex(raw).alias("raw"))
    known = t.part.select(F.encode("p_name", "UTF-8").alias("raw"), F.lit(True).alias("known")).distinct()
    # Bytes beyond the text are an error each; names are ASCII, so characters are bytes.
    errors = F.levenshtein("target", "left") + F.octet_length("raw") - F.length("left")
    j = p.join(known, "raw", "left")
    return j.select("p_brand", F.length("target").alias("n"), (F.col("raw") == F.encode("target", "UTF-8")).alias("exact"), F.is_valid_utf8(F.col("raw").cast("string")).alias("valid"), F.coalesce("known", F.lit(False)).alias("known"), errors.alias("errors"))


def _rate(on) -> F.Column:
    return F.round(F.sum(on.cast("int")) / F.greatest(F.count("*"), F.lit(1)), 9)


@P.query(f"SELECT p_brand, bucket, {_RATES}, round(sum(errors) / greatest(sum(n), 1), 9) AS byte_error_rate FROM (SELECT *, CASE WHEN n <= 12 THEN 'short' ELSE 'long' END AS bucket FROM {_PREDICTED}) GROUP BY GROUPING SETS ((), (p_brand), (bucket))")
def eval_rates(t: Tables) -> DataFrame:
    """Overall, by brand and by length in one pass: exact, valid UTF-8, known words, byte errors."""
    p = _predicted(t).withColumn("bucket", F.when(F.col("n") <= 12, "short").otherwise("long"))
    return p.groupingSets([[], ["p_brand"], ["bucket"]], "p_brand", "bucket").agg(
        F.count("*").alias("tokens"), F.sum("n").alias("bytes"), _rate(F.col("exact")).alias("exact_accuracy"), _rate(F.col("valid")).alias("valid_utf8_rate"), _rate(F.col("known")).alias("known_vocab_rate"),
        F.round(F.sum("errors") / F.greatest(F.sum("n"), F.lit(1)), 9).alias("byte_error_rate"),
    )


@P.query(f"SELECT p_brand, {_RATES}, count(*) FILTER (WHERE n <= 12) AS short_tokens, round(count(*) FILTER (WHERE exact AND n <= 12) / greatest(count(*) FILTER (WHERE n <= 12), 1), 9) AS short_exact, count(*) FILTER (WHERE n > 12) AS long_tokens, round(count(*) FILTER (WHERE exact AND n > 12) / greatest(count(*) FILTER (WHERE n > 12), 1), 9) AS long_exact FROM {_PREDICTED} GROUP BY p_brand")
def reconstruction_metrics(t: Tables) -> DataFrame:
    """The same rates by brand, with the exact ones of short and long words."""
    n, exact = F.col("n"), F.col("exact")
    part = lambda on: F.round(F.count_if(on & exact) / F.greatest(F.count_if(on), F.lit(1)), 9)
    return _predicted(t).groupBy("p_brand").agg(
        F.count("*").alias("tokens"), F.sum("n").alias("bytes"), _rate(exact).alias("exact_accuracy"), _rate(F.col("valid")).alias("valid_utf8_rate"), _rate(F.col("known")).alias("known_vocab_rate"),
        F.count_if(n <= 12).alias("short_tokens"), part(n <= 12).alias("short_exact"), F.count_if(n > 12).alias("long_tokens"), part(n > 12).alias("long_exact"),
    )


@P.query("SELECT v::BIGINT * 1000 AS vocabulary, d::BIGINT * 64 AS width, v * 1000 * d * 64 AS embedding, 0::BIGINT AS tied_head, v * 1000 * d * 64 AS untied_head, 12 * (d * 64) * (d * 64) + v * 1000 * d * 64 AS tied_total, 12 * (d * 64) * (d * 64) + 2 * v * 1000 * d * 64 AS untied_total FROM range(1, 11) AS a(v), range(1, 17) AS b(d)")
def tied_parameters(t: Tables) -> DataFrame:
    """Parameters of a model of one block (12 D squared) with a head that shares the embedding, and with one of its own."""
    g = t.spark.range(1, 11).select((F.col("id") * 1000).alias("vocabulary")).crossJoin(t.spark.range(1, 17).select((F.col("id") * 64).alias("width")))
    e, body = F.col("vocabulary") * F.col("width"), 12 * F.col("width") * F.col("width")
    return g.select("vocabulary", "width", e.alias("embedding"), F.lit(0).cast("long").alias("tied_head"), e.alias("untied_head"), (body + e).alias("tied_total"), (body + 2 * e).alias("untied_total"))


@P.query("SELECT p_partkey, least(1024, floor(1400 / (p_retailprice / 64)))::INTEGER AS batch FROM part WHERE p_retailprice > 0")
def batch_search(t: Tables) -> DataFrame:
    """The largest batch below 70 % of memory, found by doubling and bisection of a probe (here batch times a cost by part)."""
    from ..functions.numeric import largest_safe

    return t.part.where("p_retailprice > 0").select("p_partkey", largest_safe(lambda n: n * (F.col("p_retailprice") / 64) <= 1400, 1024).alias("batch"))


QUERIES, SQL = P.QUERIES, P.SQL
