"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate of at most ``CAP`` copies. Among all rates that give each source
its target of words, entropy balancing takes those nearest to one copy each: the rates
exp(multiplier * size), cut at the cap. The multipliers solve a convex dual problem, one
dimension for each source, by Newton steps whose sums run as grouped aggregates over the
(source, size) histogram. Rates are rounded into whole copies by systematic rounding in order
of size, with the start that brings the source's words nearest to its target; what is then
missing or too much is made up by a few documents whose sizes fit the gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, words_of

#: Fixed values of the mix: weights by turns, share of all words, most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Newton steps at most, and the relative error of a source's words at which they end.
STEPS, CLOSE = 60, 1e-9
#: Times that copies are corrected towards the targets.
CORRECTIONS = 3
#: Starts that systematic rounding tries; rows of one (source, size) ranked in one task.
STARTS, RANKED = 64, 500


def targets(sums: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Turns go by the order of all sources, so one task orders a row of four numbers for each source,
    never documents: ten million sources are some hundred megabytes. The excess of sources at their cap is
    shared again by weight until none is above: the final level of words for each weight is
    found from the sources in order of cap per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    rows = sums.select("source", "source_size", weight.alias("w"), (CAP * F.col("source_size")).cast("double").alias("cap"))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # the level if all sources from this one on are below their caps; it holds from the first where it is
    rows = rows.withColumn("level", left / weights).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    rows = rows.withColumn("first", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(every))
    return rows.select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("w"))).alias("target"))


def multipliers(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows (source, slope): rates are least(CAP, exp(slope * size)); null slope stands for CAP throughout.

    ``cells`` has (source, size, n), ``goals`` (source, source_size, target). Newton steps are
    kept inside a bracket that each step narrows, so they settle from any start.
    """
    x = F.col("size") / F.col("scale")
    rate = F.least(F.lit(float(CAP)), F.exp(F.least(F.col("b") * x, F.lit(50.0))))
    state = goals.where("source_size > 0 and target < %d * source_size" % CAP)
    scale = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = state.alias("g").join(scale.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "target", "scale", F.lit(0.0).alias("b"), F.lit(-750.0).alias("lo"), F.lit(750.0).alias("hi"), F.lit(1.0).alias("off"))
    state = stored(state)
    for _ in range(STEPS):
        sums = (
            cells.where("size > 0").alias("c").join(small(state).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
            .groupBy("t.source", "target", "scale", "b", "lo", "hi")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < CAP, F.col("n") * F.col("size") * x * rate)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        step = sums.select(
            "source", "target", "scale", "b",
            F.when(gap < 0, F.col("b")).otherwise(F.col("lo")).alias("lo"),
            F.when(gap > 0, F.col("b")).otherwise(F.col("hi")).alias("hi"),
            (F.col("b") - gap / F.nullif("slope", F.lit(0.0))).alias("newton"),
            (F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("off"),
        )
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        moved = F.when(F.col("off") <= CLOSE, F.col("b")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = stored(step.select("source", "target", "scale", moved.alias("b"), "lo", "hi", "off"))
        if (state.agg(F.max("off")).first()[0] or 0) <= CLOSE:
            break
    found = state.select("source", (F.col("b") / F.col("scale")).alias("slope"))
    return goals.alias("g").join(small(found).alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left").select("g.source", "source_size", "target", "slope")


def _nearer(plan: DataFrame) -> DataFrame:
    """Bring the words taken nearer to the targets: copies ``k`` of cells are raised or lowered, the largest sizes within the gap first."""
    every = Window.partitionBy("source")
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(every)).cast("long")
    rows = plan.withColumn("gap", gap)
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
    rows = rows.withColumn("room", F.when(fits, F.when(F.col("gap") > 0, CAP * F.col("n") - F.col("k")).otherwise(F.col("k"))).otherwise(0))
    left = F.abs("gap") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(down), F.lit(0))
    moved = F.greatest(F.lit(0), F.least("room", F.floor(left / F.greatest("size", F.lit(1)))))
    return rows.withColumn("k", F.col("k") + F.signum("gap").cast("long") * moved).drop("gap", "room")


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies, part), one for each document; ``part`` is a hash of its text.

    Null and blank texts have size 0 and take nothing; the null source is one source, the last.
    Repeated rows count as documents of their own. Ties in size are ordered by a hash of doc_id.
    """
    sizes = stored(docs.select("doc_id", F.xxhash64("text").alias("part"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")))
    cells = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = stored(targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    rates = stored(multipliers(cells, goals))

    rate = F.when(F.col("size") == 0, 0.0).when(F.col("slope").isNull(), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("slope") * F.col("size"), F.lit(50.0)))))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    priced = cells.alias("c").join(small(rates).alias("r"), F.col("c.source").eqNullSafe(F.col("r.source"))).select("c.source", "size", "n", "source_size", "target", rate.alias("rate"))
    priced = stored(priced.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(upto), F.lit(0.0))))

    ends = F.col("before") + F.col("n") * F.col("rate")
    off = [F.abs(F.sum(F.col("size") * (F.floor(ends + k / STARTS + 1e-9) - F.floor(F.col("before") + k / STARTS + 1e-9))) - F.max("target")) for k in range(STARTS)]
    best = priced.groupBy("source").agg(*[x.alias(f"o{k}") for k, x in enumerate(off)])
    start = F.array_min(F.array(*[F.struct(F.round(f"o{k}", 3).alias("off"), F.lit(k / STARTS).alias("start")) for k in range(STARTS)]))["start"]
    starts = stored(best.select("source", start.alias("start")))
    turns = F.floor(ends + F.col("start") + 1e-9) - F.floor(F.col("before") + F.col("start") + 1e-9)
    plan = priced.alias("p").join(small(starts).alias("b"), F.col("p.source").eqNullSafe(F.col("b.source"))).select(
        "p.source", "size", "n", "source_size", "target", F.when(F.col("rate") >= CAP, CAP * F.col("n")).otherwise(F.least(turns, CAP * F.col("n"))).cast("long").alias("k")
    )
    for _ in range(CORRECTIONS):
        plan = _nearer(plan)
    plan = plan.select(F.col("source").alias("src"), F.col("size").alias("sz"), "source_size", "target", "n", "k", F.ceil(F.col("n") / RANKED).cast("int").alias("salts"))
    plan = small(stored(plan))

    own = sizes.join(plan, sizes["source"].eqNullSafe(F.col("src")) & (sizes["size"] == F.col("sz")))
    own = own.withColumn("mark", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.shiftright("mark", 17), F.col("salts")))
    group = ["source", "size", "salt"]
    ranked = own.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("mark", "doc_id")))
    # rows of a split cell go on from where the salts before them end
    split = own.where("salts > 1").groupBy(*group).agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = small(split.select(F.col("source").alias("s1"), F.col("size").alias("s2"), F.col("salt").alias("s3"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("shift")))
    ranked = ranked.join(shift, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("s2")) & (F.col("salt") == F.col("s3")), "left")
    at = F.col("at") - 1 + F.coalesce("shift", F.lit(0))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("k") / F.col("n")) + (at < F.col("k") % F.col("n")).cast("int")).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "part")
