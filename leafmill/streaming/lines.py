"""Lines of running jobs as a stream: progress, the last lines of each job, and a word when a job is silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "job string, at timestamp, line string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines (job, at, line) from the files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).json(path)


def tails(stream: DataFrame, n: int = 10) -> DataFrame:
    """After each batch the last ``n`` lines of each job that said something: state is bounded by n lines a job."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held = (held + frame.sort_values("at")["line"].tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({"job": [key[0]], "tail": [held]})

    return stream.groupBy("job").applyInPandasWithState(keep, "job string, tail array<string>", "tail array<string>", "update", GroupStateTimeout.NoTimeout)


def heartbeats(stream: DataFrame, silence_ms: int = 30_000) -> DataFrame:
    """The lines of each job, and a row of kind silent whenever one has said nothing for ``silence_ms``."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.update((n,))
            state.setTimeoutDuration(silence_ms)
            yield pd.DataFrame({"job": [key[0]], "kind": ["silent"], "line": [f"no output for {silence_ms // 1000} s after {n} lines"]})
            return
        n = state.get[0] if state.exists else 0
        for frame in frames:
            n += len(frame)
            yield pd.DataFrame({"job": key[0], "kind": "line", "line": frame.sort_values("at")["line"].tolist()})
        state.update((n,))
        state.setTimeoutDuration(silence_ms)

    return stream.groupBy("job").applyInPandasWithState(watch, "job string, kind string, line string", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress(done: DataFrame) -> DataFrame:
    """done of total and the name of each finished job (job, ord, total)."""
    return done.select("job", F.format_string("[%d/%d] %s", "ord", "total", "job").alias("line"))


def run_for(query, seconds: float) -> bool:
    """Wait for a streaming query and stop it after ``seconds``; whether it ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
