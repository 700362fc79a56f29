"""Event time: sessions, events that follow others, and late rows. The same functions work on a batch and on a stream."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sinks.files import write_atomic


def timed(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if events.isStreaming else rows


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """key, start, last, n, types, total: events of a key with less than ``gap`` between neighbours. Rows without a time or key are in none.

    A stream gives a session when the watermark has passed its end; counts and sums are merged map-side, so a key of most rows sends a row for each session of a task.
    """
    rows = timed(events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()), late)
    held = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.array_sort(F.collect_set("event_type")).alias("types"), F.round(F.sum("value"), 6).alias("total"))
    return held.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n", F.array_join("types", ",").alias("types"), "total")


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """first_id, then_id, key: each event of ``first`` with those of ``then`` of its key in the time ``within`` behind it.

    An equi-join on the key with a bound on times: a stream holds state for the watermark and ``within`` only; a batch joins on the stretch of time as well, so that a key of most rows is cut.
    """
    a = timed(first, late).select(F.col("event_id").alias("first_id"), F.col(key), F.col("ts").alias("first_ts"))
    b = timed(then, late).select(F.col("event_id").alias("then_id"), F.col(key).alias("key_"), F.col("ts").alias("then_ts"))
    near = (F.col(key) == F.col("key_")) & (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    if not (first.isStreaming or then.isStreaming):
        span = F.expr(f"unix_seconds(timestamp_seconds(0) + interval {within})")
        at = lambda c, more=0: F.floor(F.unix_seconds(c) / span) + more
        a = a.withColumn("part", F.explode(F.array(at(F.col("first_ts")), at(F.col("first_ts"), 1))))
        b = b.withColumn("part_", at(F.col("then_ts")))
        near = near & (F.col("part") == F.col("part_"))
    return a.join(b, near).select("first_id", "then_id", key)


def parted(on_time: Callable[[DataFrame, int], None], late_rows: Callable[[DataFrame, int], None], state: str, late_seconds: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: rows behind the watermark go to a sink of their own instead of being dropped unseen.

    The watermark of a batch is the highest time of the batches before it less ``late_seconds``; it is kept in the folder ``state``, a small file for each batch, so that a batch that is
    repeated after a failure is parted as it was. Sinks get the batch's number and must replace what an earlier try of it has written.
    """

    def part(batch: DataFrame, number: int) -> None:
        os.makedirs(state, exist_ok=True)
        before = [float(open(f"{state}/{f}").read()) for f in os.listdir(state) if f.isdigit() and int(f) < number]
        seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
        mark = max(before) - late_seconds if before else None
        is_late = seconds < mark if mark is not None else F.lit(False)
        on_time(batch.where(~F.coalesce(is_late, F.lit(False))), number)
        late_rows(batch.where(F.coalesce(is_late, F.lit(False))), number)
        highest = batch.agg(F.max(seconds)).first()[0]
        if highest is not None:
            write_atomic(f"{state}/{number}", repr(max([highest, *before])))
        for old in [f for f in os.listdir(state) if f.isdigit() and int(f) < number - 100]:
            os.unlink(f"{state}/{old}")

    return part
