"""Mixing sources to target weights by entropy balancing.

Each source has a target of words; a document of size z gets a rate r = 2 / (1 + exp(-lambda z / mean)), the
exponential tilt of even odds that stays between 0 and 2 copies. The lambdas solve the convex dual of the relative
entropy problem under "the rates of a source use up its target", by Newton steps (with bisection where a step would
leave the bracket). A step's sums run over all documents as a distributed aggregate by source, on the table of
(source, size, count), so repeated passes never read texts again. Sources are a table too, however many they are.

Rates become copies by systematic rounding: documents of a source in order of size, the count so far of the rates
rounded down; a document gets what the count gains. The words so taken differ from the target by about one document.
Ranks within (source, size) are salted by id and text, and rows that are alike in both are ranked as one with a weight,
so that no source, id or group of copies that holds a third of all rows is ranked by one task.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; they share ``budget`` times all words, none
beyond ``most`` times its own words; the excess is shared again by weight until none is above.

Defined results: a null text has size 0 and is taken 0 words; a very long text is one document of its size; a source
without words has target 0; ties between equal sizes are broken by a hash of id and text, then the id; rows repeated
under one id are documents of their own; null ids take part; steps that do not converge are an error; an empty table
gives an empty table; columns other than id, source and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brindle.llm.common import discard, salted_rank, whole_row, written

WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton steps at most, how near to its target a source must come, and the grain of the sums.
STEPS, CLOSE, GRAIN = 300, 1e-7, float(1 << 30)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(sources: DataFrame) -> DataFrame:
    """Add ``nth``: the place of each source in code point order, null last. Ranges of sources are sorted apart; only their
    sizes meet in one task."""
    null, source = F.col("source").isNull(), F.col("source")
    placed = written(sources.repartitionByRange(null, source).sortWithinPartitions(null, source).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(W.Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.join(F.broadcast(starts), part == F.col("part")).withColumn("nth", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "start")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sources`` (source, words, ...) with the target of each.

    A source is capped if its share would be above ``most`` times its words. Capping some raises the share of the rest, so
    rounds go on until none is capped; all that a round needs of the last is the share of a unit of weight.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    known = written(in_order(sources).withColumn("weight", weigh), "weighed")
    ceiling = F.lit(float(most)) * F.col("words")
    share, capped = 0.0, -1
    while True:
        full = F.lit(share) * F.col("weight") > ceiling
        row = known.agg(F.sum("words").alias("all"), F.sum(F.when(full, ceiling)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("capped")).first()
        if row["capped"] == capped or not row["weight"]:
            break
        share, capped = max(share, (budget * (row["all"] or 0) - (row["given"] or 0.0)) / row["weight"]), row["capped"]
    return known.withColumn("target", F.least(ceiling, F.lit(share) * F.col("weight"))).drop("weight", "nth")


def rate(most: float, lam: Column, z: Column) -> Column:
    return F.lit(float(most)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * z))))


def balance(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``sources`` (source, words, n, target) with ``unit``, its mean size, and ``lam``; that is infinite where the target is
    all that the source can give, minus infinite where it is nothing."""
    inf = F.lit(math.inf)
    solved = F.when(F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("words"), inf).when(F.col("target") <= 0, -inf)
    start = sources.withColumn("unit", F.greatest(F.lit(1.0), F.col("words") / F.col("n"))).withColumn("lam", F.coalesce(solved, F.lit(0.0)))
    start = start.withColumn("done", solved.isNotNull()).withColumn("low", -60.0 * F.col("n") - 60).withColumn("high", 60.0 * F.col("n") + 60)
    state = written(start, "state")
    for _ in range(STEPS):
        live = state.where("NOT done").select(F.col("source").alias("own"), "unit", "lam")
        if live.isEmpty():
            return state.select("source", "words", "n", "target", "unit", "lam")
        z = F.col("size") / F.col("unit")
        r = rate(most, F.col("lam"), z)
        # sums of whole multiples of 1 / GRAIN are exact in any order, so reruns agree to the bit
        part = lambda x: F.sum((F.col("n") * F.col("size")).cast("decimal(20,0)") * F.floor(x * GRAIN).cast("decimal(17,0)")).cast("double") / GRAIN
        sums = cells.join(live, cells["source"].eqNullSafe(live["own"])).groupBy("own").agg(part(r).alias("used"), part(z * r * (1 - r / most)).alias("slope"))
        moved = state.join(sums, state["source"].eqNullSafe(sums["own"]), "left")
        gap, lam = F.col("target") - F.col("used"), F.col("lam")
        low, high = F.when(gap > 0, lam).otherwise(F.col("low")), F.when(gap > 0, F.col("high")).otherwise(lam)
        step = lam + F.when(F.col("slope") > 0, gap / F.col("slope"))
        middle = (low + high) / 2
        to = F.when(step.isNotNull() & (step > low) & (step < high), step).otherwise(middle)
        near = (F.abs(gap) <= CLOSE * F.col("target")) | ((middle <= low) | (middle >= high))  # or no number lies between
        done = F.col("done") | near
        moved = moved.select("source", "words", "n", "target", "unit", F.when(done, lam).otherwise(to).alias("lam"), F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), done.alias("done"))
        after = written(moved, "state")
        discard(state)
        state = after
    raise RuntimeError(f"no convergence after {STEPS} steps")


def ranges(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, budget: float, most: float) -> DataFrame:
    """(id, source, hash, size, many, source_size, target, rate, so_far, rank): one row for each id, source and text, the
    ``many`` rows it stands for ranked from ``rank`` on."""
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(text).alias("hash"))
    light = written(light, "sizes")
    cells = written(light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"))
    solved = balance(cells, written(targets(totals, weights, budget, most), "targets"), most)
    solved = solved.select(F.col("source").alias("own"), F.col("words").alias("source_size"), "target", "unit", "lam")
    lam = F.col("lam")
    own = F.when(F.col("size") == 0, 0.0).when(lam == math.inf, float(most)).when(lam == -math.inf, 0.0).otherwise(rate(most, lam, F.col("size") / F.col("unit")))
    rated = cells.join(solved, cells["source"].eqNullSafe(solved["own"])).withColumn("rate", own)
    before = W.Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.Window.unboundedPreceding, -1)
    rated = rated.withColumn("so_far", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))
    rated = written(rated.select("own", F.col("size").alias("z"), "source_size", "target", "rate", "so_far"), "rates")
    alike = light.groupBy("id", "source", "size", "hash").agg(F.count(F.lit(1)).alias("many"))
    ranked = salted_rank(alike, ["source", "size"], ["id", "hash"], F.xxhash64(F.col("id").cast("string"), "hash"), "rank", weight=F.col("many"))
    return ranked.join(rated, ranked["source"].eqNullSafe(rated["own"]) & (ranked["size"] == rated["z"])).drop("own", "z")


def copies(rank: Column, most: float) -> Column:
    """How often the document of a rank is taken."""
    upto = lambda k: F.floor(F.col("so_far") + (rank + k) * F.col("rate") + F.lit(0.5))
    return F.when(F.col("rate") == float(most), F.lit(int(most))).otherwise(F.least(F.lit(math.ceil(most)), upto(1) - upto(0))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies, taken."""
    each = ranges(docs, id_col, source_col, text_col, weights, budget, most)
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).withColumn("copies", copies(F.col("rank") + F.col("nth"), most))
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, with all its columns.

    Where no id is repeated, ids tell the rows (a row each, so never for broadcast). Else id, source and text do, and rows alike in these are numbered, by
    blocks, as they are written.
    """
    plan = written(ranges(docs, id_col, source_col, text_col, weights, budget, most).select("id", "source", "hash", "many", "rank", "rate", "so_far"), "mix")
    again = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("own"))
    same = F.col("own").eqNullSafe(F.col("id"))
    if plan.groupBy("id").agg(F.sum("many").alias("many")).where("many > 1").isEmpty():
        taken = plan.select("id", copies(F.col("rank"), most).alias("copies")).where("copies > 0")
        return rows.join(taken.hint("merge"), same).select("row", again.alias("copy")).select("row.*")
    rows = rows.withColumn("from", F.col("row")[source_col].cast("string")).withColumn("like", F.xxhash64(F.col("row")[text_col].cast("string")))
    same = same & F.col("from").eqNullSafe(F.col("source")) & (F.col("like") == F.col("hash"))
    single = rows.join(plan.where("many = 1"), same).select("row", copies(F.col("rank"), most).alias("copies"))
    several = written(rows.join(plan.where("many > 1"), same).withColumn("uid", F.monotonically_increasing_id()), "several")
    places = salted_rank(several.select("own", "from", "like", "rank", "rate", "so_far", "uid"), ["own", "from", "like"], ["uid"], F.xxhash64("uid"), "nth")
    places = places.select(F.col("uid").alias("place"), copies(F.col("rank") + F.col("nth"), most).alias("copies"))
    several = several.select("row", "uid").join(places, F.col("uid") == F.col("place")).select("row", "copies")
    return single.union(several).select("row", again.alias("copy")).select("row.*")
