"""As-of joins: for each row the last row of the other side at its time or before, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, stretch: Column, order: str | None = None) -> DataFrame:
    """``left`` with found, the row of ``right`` (as a struct) that is last at the same time or before it, or null.

    Both sides are one stream in order of time, in which the last value so far is filled forward: no pairs are made and a row isn't sent twice.
    ``stretch`` is the part of time that a row belongs to, from ``time`` alone and growing with it (a day, a thousand lines). It cuts a key, so that one that holds most rows isn't one
    task; the last value of each part, a row a part, is carried to those behind it. Of equal times in ``right`` the largest ``order`` counts. Null keys are a key; rows without a time find nothing.
    """
    place = [F.col(key).alias("k"), F.col(time).alias("t"), stretch.alias("part")]
    a = left.select(*place, F.lit(1).alias("side"), F.struct(*left.columns).alias("own"))
    b = right.where(F.col(time).isNotNull()).select(*place, F.lit(0).alias("side"), (F.col(order) if order else F.lit(0)).alias("tie"), F.struct(*right.columns).alias("value"))
    both = a.unionByName(b, allowMissingColumns=True)
    within = Window.partitionBy("k", "part").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("found", F.when(F.col("t").isNotNull(), F.last("value", ignorenulls=True).over(within)))
    ends = b.groupBy("k", "part").agg(F.max_by("value", F.struct("t", "tie")).alias("last"))
    parts = both.select("k", "part").distinct().join(ends.select(F.col("k").alias("k_"), F.col("part").alias("part_"), "last"), F.col("k").eqNullSafe(F.col("k_")) & F.col("part").eqNullSafe(F.col("part_")), "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select(F.col("k").alias("k_"), F.col("part").alias("part_"), before.alias("carried")).where("carried is not null")
    rows = filled.where("side = 1").join(carried, F.col("k").eqNullSafe(F.col("k_")) & (F.col("part") == F.col("part_")), "left")
    return rows.select("own.*", F.coalesce("found", "carried").alias("found"))
