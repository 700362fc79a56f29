"""The event log: roll-ups, and keyed upserts as union and latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(events: DataFrame) -> DataFrame:
    """Counts and latency by stage and over all."""
    return events.rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sources"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


def rollup_by(events: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts and latency by stage within each source or digest, and over each."""
    rows = events.withColumn(name, key)
    return rows.groupingSets([[F.col(name), F.col("event_type")], [F.col(name)]], name, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; of equal times the new one's."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("is_new")))
    return both.withColumn("nth", nth).where("nth = 1").drop("nth", "is_new")


def recent(events: DataFrame, n: int) -> DataFrame:
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return last.orderBy(F.desc("last_used"), "user_id").limit(n)


def percentiles(events: DataFrame) -> DataFrame:
    """Counts and exact percentiles of latency by stage, by day, by both and over all (``level``: which of the two are folded, as bits)."""
    rows = events.withColumn("day", F.to_date("ts"))
    held = rows.cube("event_type", "day").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"), F.grouping_id().alias("level"))
    return held.select("event_type", F.col("day").cast("string").alias("day"), "n", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{q}") for i, q in enumerate((50, 90, 99))], "level")


def sketches(events: DataFrame) -> DataFrame:
    """hour, event_type, n, users (HyperLogLog of 2^12 registers, standard error 1.6 %) and values (KLL of k = 200, rank error 1.33 % at 99 % confidence): what is kept of an hour, a few KB, and merged for any span."""
    rows = events.withColumn("hour", F.date_trunc("hour", "ts"))
    return rows.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.hll_sketch_agg("user_id", 12).alias("users"), F.kll_sketch_agg_double("value", 200).alias("values"))


def spans(kept: DataFrame, span: Column, name: str) -> DataFrame:
    """Hours merged into spans: name, event_type, n, users and percentiles, without reading an event again."""
    held = kept.groupBy(span.alias(name), "event_type").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("values").alias("k"))
    return held.select(name, "event_type", "n", "users", *[F.kll_sketch_get_quantile_double("k", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.99)])
