"""Lane quotas, batch schedules and selection of documents by gradient alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Tokens of the byte vocabulary.
VOCABULARY = 259


def quotas(weights: DataFrame, by: str, total: int | Column, least: Column | None = None) -> DataFrame:
    """weights (by, lane, weight) with `quota`: whole numbers that sum to `total` in each `by`, none below `least`.

    A lane starts at the whole part of its due, or its minimum if that is more. What is then missing (or too much) is a number
    of single units. A lane's k-th unit more stands at its remaining due less k, its k-th unit less at its remaining due plus
    k: the units of largest remaining due are added, largest name first among equals, or those of smallest taken away,
    smallest name first, down to the minimum. So all units are ranked at once. Infeasible minimums raise an error when the
    result is read. A `by` has as many rows as lanes, of a fixed table.
    """
    every = Window.partitionBy(by)
    w = weights.withColumn("_total", F.lit(total) if isinstance(total, int) else total).withColumn("_least", (F.lit(0) if least is None else F.coalesce(least, F.lit(0))).cast("long"))
    w = w.withColumn("_base", F.greatest("_least", F.floor(F.col("weight") * F.col("_total"))))
    w = w.withColumn("_due", F.col("weight") * F.col("_total") - F.col("_base")).withColumn("_open", F.col("_total") - F.sum("_base").over(every))
    w = w.withColumn("_feasible", F.sum("_least").over(every) <= F.col("_total"))
    spare = F.when(F.col("_open") >= 0, F.col("_open")).otherwise(F.least(-F.col("_open"), F.col("_base") - F.col("_least")))
    units = w.where(spare > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), spare.cast("long") - 1)))
    grow, shrink = F.col("_due") - F.col("_k"), F.col("_due") + F.col("_k")
    up = F.row_number().over(every.orderBy(grow.desc(), F.desc("lane")))
    down = F.row_number().over(every.orderBy(shrink.asc(), F.asc("lane")))
    taken = units.withColumn("_rank", F.when(F.col("_open") >= 0, up).otherwise(down)).where(F.col("_rank") <= F.abs("_open"))
    more = taken.groupBy(by, "lane").agg(F.count("*").alias("_units"))
    quota = F.col("_base") + F.signum(F.col("_open")).cast("long") * F.coalesce("_units", F.lit(0))
    quota = F.when(F.col("_feasible"), quota).otherwise(F.raise_error(F.lit("minimums exceed the total")).cast("long"))
    return w.join(more, [by, "lane"], "left").select(*weights.columns, quota.alias("quota"))


def schedule(weights: DataFrame, floors: DataFrame, batch: int, steps: int, strict: bool = True) -> DataFrame:
    """stage, batch, slot, lane of each sequence of `steps` batches a stage. weights: stage, stage_index, lane, weight; floors: lane, floor.

    Every batch opens with its protected lanes in order of name: one slot each if strict, else as many as the floor's share
    of a batch asks for. Each further slot goes to the lane furthest behind its weight so far (largest name among equals) that
    has quota left, or to any if none has. Quotas keep the floors. A stage is one row: a fold over its slots carries the
    counts of its lanes. Stages and lanes are fixed tables, and steps are a stage's batches.
    """
    slots = F.ceil(F.col("floor") * batch).cast("int")
    w = weights.join(F.broadcast(floors), "lane", "left")
    q = quotas(w, "stage", batch * steps, F.coalesce(slots, F.lit(0)) * steps)
    lanes = F.array_sort(F.collect_list(F.struct("lane", "weight", "quota", F.coalesce(slots, F.lit(0)).alias("held"))))
    stage = q.groupBy("stage", "stage_index").agg(lanes.alias("lanes"))
    place = F.sequence(F.lit(0), F.size("lanes") - 1)
    copies = F.transform(place, lambda i: F.array_repeat(i, F.when(F.get("lanes", i)["held"] > 0, F.lit(1) if strict else F.get("lanes", i)["held"]).otherwise(0)))
    stage = stage.withColumn("first", F.slice(F.flatten(copies), 1, batch))

    def pick(s: Column, at: Column) -> Column:
        used, number = s["used"], at + 1
        behind = lambda free: F.array_max(F.transform(F.filter(place, lambda i: F.lit(True) if free else F.get(used, i) < F.get("lanes", i)["quota"]), lambda i: F.struct((F.get("lanes", i)["weight"] * number - F.get(used, i)).alias("due"), i.alias("i"))))["i"]
        lane = F.coalesce(F.get("first", (at % batch).cast("int")), behind(False), behind(True))
        return F.struct(F.transform(place, lambda i: F.get(used, i) + F.when(i == lane, 1).otherwise(0)).alias("used"), F.concat(s["picks"], F.array(lane)).alias("picks"))

    # The protected lanes of a batch count as placed before its first free slot is chosen, as they stand in front.
    begin = F.struct(F.transform(place, lambda i: F.lit(0)).alias("used"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(batch * steps - 1)), begin, pick, lambda s: s["picks"])
    at = stage.withColumn("picks", picks).select("stage", "stage_index", "lanes", F.posexplode("picks").alias("at", "i"))
    order = F.dense_rank().over(Window.orderBy("stage_index", "stage")) - 1
    return at.select("stage", (order * steps + F.floor(F.col("at") / batch)).cast("int").alias("batch"), (F.col("at") % batch).alias("slot"), F.get("lanes", F.col("i"))["lane"].alias("lane"))


def alignment(rows: DataFrame, proxy: DataFrame, prefix: int = 16) -> DataFrame:
    """rows with `alignment`: the cosine between the gradients of a zero-weight bigram softmax on a row's prefix and on the proxy's.

    With counts c of token pairs and n of first tokens, the dot product of two gradients is
    (sum c_a c_b - sum n_a n_b / V) / (N_a N_b). A row without a pair has none. rows: shard_id, row_id, tokens and more;
    the proxy's counts are bounded by the squared vocabulary and are broadcast.
    """

    def pairs(df: DataFrame, *keep: str) -> DataFrame:
        cut = F.slice("tokens", 1, prefix)
        return df.where(F.size("tokens") > 1).select(*keep, F.explode(F.zip_with(F.slice(cut, F.lit(1), F.size(cut) - 1), F.slice(cut, F.lit(2), F.size(cut) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p")).select(*keep, "p.x", "p.y")

    key = ["shard_id", "row_id"]
    ref2 = pairs(proxy).groupBy("x", "y").agg(F.count("*").alias("r"))
    ref1 = ref2.groupBy("x").agg(F.sum("r").alias("r"))
    own2 = pairs(rows, *key).groupBy(*key, "x", "y").agg(F.count("*").alias("c"))
    own1 = own2.groupBy(*key, "x").agg(F.sum("c").alias("c"))
    a = own2.join(F.broadcast(ref2), ["x", "y"], "left").groupBy(*key).agg(F.sum(F.col("c") * F.coalesce("r", F.lit(0))).alias("cr"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    b = own1.join(F.broadcast(ref1), "x", "left").groupBy(*key).agg(F.sum(F.col("c") * F.coalesce("r", F.lit(0))).alias("nr"), F.sum(F.col("c") * F.col("c")).alias("nn"))
    whole = ref2.agg(F.sum(F.col("r") * F.col("r")).alias("rr2")).crossJoin(ref1.agg(F.sum(F.col("r") * F.col("r")).alias("rr1")))
    v = F.lit(float(VOCABULARY))
    cos = (F.col("cr") - F.col("nr") / v) / (F.sqrt(F.col("cc") - F.col("nn") / v) * F.sqrt(F.col("rr2") - F.col("rr1") / v))
    scores = a.join(b, key).crossJoin(F.broadcast(whole)).select(*key, F.round(cos, 9).alias("alignment"))
    return rows.join(scores, key, "left")


def decide(scored: DataFrame, stages: DataFrame, required: DataFrame) -> DataFrame:
    """One decision per stage and document: accepted, deferred or rejected by rank within lane, and rescues to a protected floor.

    scored: doc_id, lane, min_stage, quality, alignment. stages: stage, stage_index. required: stage_index, lane, need (exposures of a
    protected lane). The first 40 % (one at least) are accepted, the next 30 % deferred if three are eligible, the rest rejected.
    A protected lane's best others are accepted by override until its need, or all that are eligible, is met.
    Documents not eligible for a stage, or without a score, are deferred.

    Documents are sorted once, by lane and alignment: the ranks of a stage are running counts of its eligible documents along
    that order, within range partitions and over those before. stages is a fixed table of a few rows.
    """
    named = sorted((r["stage_index"], r["stage"]) for r in stages.select("stage", "stage_index").distinct().collect())
    order = [F.desc_nulls_last("alignment"), F.desc("quality"), F.asc("doc_id")]
    n = max(4, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(scored.repartitionByRange(n, F.col("lane"), *order).withColumn("_part", F.spark_partition_id()))
    ok = [F.col("alignment").isNotNull() & F.coalesce(F.col("min_stage") <= index, F.lit(False)) for index, _ in named]
    counts = placed.groupBy("lane", "_part").agg(F.array(*[F.count_if(x) for x in ok]).alias("_c"))
    upto, whole = Window.partitionBy("lane").orderBy("_part"), Window.partitionBy("lane")
    sums = lambda w: F.array(*[F.sum(F.get("_c", F.lit(i))).over(w) for i in range(len(named))])
    # A row per lane and range partition.
    counts = counts.select(F.col("lane").alias("_lane"), F.col("_part").alias("_p"), F.zip_with(sums(upto), "_c", lambda x, y: x - y).alias("_before"), sums(whole).alias("_n"))
    d = placed.join(counts, F.col("lane").eqNullSafe(F.col("_lane")) & (F.col("_part") == F.col("_p")))
    along = Window.partitionBy("lane", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = [
        F.struct(
            F.lit(stage).alias("stage"), F.lit(index).alias("stage_index"), F.get("_n", F.lit(i)).alias("n"),
            F.when(ok[i], F.get("_before", F.lit(i)) + F.sum(ok[i].cast("int")).over(along)).alias("rank"),
        )
        for i, (index, stage) in enumerate(named)
    ]
    d = d.select("doc_id", "lane", "alignment", F.array(*each).alias("_each")).select("doc_id", "lane", "alignment", F.explode("_each").alias("s")).select("doc_id", "lane", "alignment", "s.*")
    d = d.join(F.broadcast(required), ["stage_index", "lane"], "left")
    accept = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.4)))
    defer = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.3)))).otherwise(0)
    ranked_ = F.col("rank").isNotNull()
    base = F.when(~ranked_, "deferred").when(F.col("rank") <= accept, "accepted").when(F.col("rank") <= accept + defer, "deferred").otherwise("rejected")
    # Ranks behind the accepted ones are the candidates in order, so a rescue is a bound on the rank.
    rescued = ranked_ & (F.col("rank") > accept) & (F.col("rank") <= F.least(F.col("n"), F.coalesce("need", F.lit(0))))
    return d.select(
        "stage", "stage_index", "doc_id", "lane", F.when(ranked_, F.col("alignment")).alias("alignment"), "rank", base.alias("base_decision"), F.when(rescued, "accepted_override").otherwise(base).alias("final_decision")
    )
