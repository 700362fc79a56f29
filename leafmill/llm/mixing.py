"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

A document's size is its number of words. Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share
``total`` times all sizes; a target stops at ``most`` times its source's size and the excess is shared anew by weight.
The rates nearest to 1 in relative entropy that meet a source's words have the form exp(tilt * size), here
with ``most`` as upper bound. The tilts solve the convex dual: Newton steps, kept within a shrinking bracket, run for all
sources at once over the number of documents of each (source, size), which is all that the dual needs.

Rates are rounded to millionths and then into copies by carrying the remainder along the documents of a source in order of
size and hash, so the copies are 0, 1 or 2. What a source then lacks or has too much, less than its largest
document, is added to or taken from the last copy of one document that can bear it. The order comes from a partition by ranges; only sums of
each range and source are carried over, so that a source may hold any share of the rows. Sums are exact (decimal), so reruns agree.

Null text counts 0; documents of size 0 are taken 0 times; a null source is a source of its own; repeated rows count each.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, UNIT, STEPS = (5, 2, 1), 1_000_000, 40
#: Sources that are broadcast at most (some hundred bytes each); more are joined by a shuffle.
SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of runs of signs that aren't ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, from one row for each source. Rounds of sharing end when no target is above its bound."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(by) - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("bound", most * F.col("source_size")).withColumn("full", F.lit(False))
    rows = common.stage(rows, "sources")
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left, weights = rows.agg(F.lit(total) * F.lit(float(whole)) - F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))), F.lit(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        share = left / weights if weights else 0.0
        over = ~F.col("full") & (F.col("bound") < F.col("weight") * share)
        if not rows.where(over).limit(1).count():
            return rows.select("source", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * share).alias("target"), "full")
        rows = common.stage(rows.withColumn("full", F.col("full") | over), "sources")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(cells: DataFrame, sources: DataFrame, most: float = 2.0) -> DataFrame:
    """source_, tilt, mean: exp(tilt * size / mean) as rates meet the targets of ``sources``. cells: source, size, n."""
    cells = cells.where("size > 0")
    scale = sources.select(F.col("source").alias("source_"), "target", "full", "source_size").join(cells.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("docs")), _same("source_", "s")).drop("s")
    state = scale.select("source_", "target", "full", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"), F.lit(False).alias("done"))
    state = common.stage(state, "tilts")
    exact = "decimal(38,0)"
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.least(F.col("tilt") * z, F.lit(2.0))), F.lit(most))
        free = rate < most
        micro = F.round(rate * UNIT).cast("long")
        at = state.join(cells, _same("source_", "source")).groupBy("source_").agg(
            F.sum(F.col("n") * F.col("size") * micro.cast(exact)).cast("double").alias("got"),
            F.sum(F.when(free, F.col("n") * F.col("size") * F.round(rate * z * UNIT).cast("long").cast(exact)).otherwise(0)).cast("double").alias("slope"),
        )
        error = F.col("got") / UNIT - F.col("target")
        at = state.join(at.withColumnRenamed("source_", "s"), _same("source_", "s")).drop("s").withColumn("error", error)
        low, high = F.when(F.col("error") < 0, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("error") >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.col("error") / F.try_divide(F.col("slope"), F.lit(float(UNIT)))
        step = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.col("done") | F.col("full") | (F.abs(F.col("error")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-6))
        before = state
        state = common.stage(at.select("source_", "target", "full", "mean", F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")), "tilts")
        common.drop_stage(before)
        if not state.where("not done").limit(1).count():
            break
    else:
        warnings.warn(f"tilts of some sources have not settled in {STEPS} steps; their words are made up by rounding", stacklevel=2)
    return state.select("source_", "full", "mean", "tilt")


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), total: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source") -> DataFrame:
    """``carry`` columns (as c0, c1, ...) with size, source_size, target, copies (whole or begun) and taken (words)."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(*carry, text).alias("h"))
    cells = common.stage(docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = common.stage(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), total, most), "targets")
    solved = sources.select(F.col("source").alias("s"), "source_size", "target").join(tilts(cells, sources, most), _same("s", "source_"), "left")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), most).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(2.0))), F.lit(most)))
    order = ["source", "size", "h"]
    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("part", F.spark_partition_id())
    solved = common.stage(solved.select("s", "source_size", "target", "full", "mean", "tilt"), "solved")
    # a row for each source, or for each source and range: rows of the table needn't be dealt by their source
    small = F.broadcast if solved.count() <= SOURCES else (lambda one: one)
    dealt = common.stage(dealt, "dealt")
    rated = dealt.join(small(solved), _same("source", "s")).drop("s").withColumn("micro", F.round(rate * UNIT).cast("long"))
    # how much of each source the ranges before hold: a row for each range and source in it
    sums = rated.groupBy("source", "part").agg(F.sum("micro").alias("own"))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("own").over(Window.partitionBy("source").orderBy("part")) - F.col("own")).alias("before"))
    within = Window.partitionBy("part", "source").orderBy("size", "h", *[F.col(f"c{i}") for i, _ in enumerate(carry) if i < 1]).rowsBetween(Window.unboundedPreceding, 0)
    run = rated.withColumn("run", F.sum("micro").over(within)).join(small(sums), _same("source", "s") & (F.col("part") == F.col("p"))).drop("s", "p")
    copies = F.expr(f"(run + before + {UNIT // 2}) div {UNIT} - (run + before + {UNIT // 2} - micro) div {UNIT}")
    taken = common.stage(run.select(*[f"c{i}" for i in range(len(carry))], "source", "size", "h", "part", "source_size", "target", copies.alias("copies")), "copies")
    common.drop_stage(dealt)
    lacking = taken.groupBy(F.col("source").alias("s")).agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))
    able = taken.join(small(lacking), _same("source", "s")).where((F.col("lack") != 0) & (F.col("copies") * F.col("size") + F.col("lack")).between(0, 2 * F.col("size")))
    one = able.groupBy("source").agg(F.max(F.struct("size", "h", "part")).alias("who"), F.first("lack").alias("lack")).select(F.col("source").alias("s"), "who", "lack")
    rows = taken.join(small(one), _same("source", "s"), "left").drop("s")
    # equal rows have equal hashes; only a row that is the only one of its kind bears the rest
    chosen = F.col("who").isNotNull() & (F.col("size") == F.col("who.size")) & (F.col("h") == F.col("who.h")) & (F.col("part") == F.col("who.part"))
    rows = rows.withColumn("chosen", chosen)
    bears = rows.where("chosen").groupBy("source").agg(F.count("*").alias("equal"))
    rows = rows.join(small(bears.select(F.col("source").alias("s"), "equal")), _same("source", "s"), "left").drop("s")
    words_taken = F.col("copies") * F.col("size") + F.when(F.col("chosen") & (F.col("equal") == 1), F.col("lack")).otherwise(0)
    out = rows.withColumn("taken", words_taken.cast("long"))
    return out.select(*[f"c{i}" for i in range(len(carry))], "size", "source_size", "target", "copies", "taken")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("c0").alias("doc_id"), "size", "source_size", "target", "taken")
