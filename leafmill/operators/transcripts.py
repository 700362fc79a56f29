"""Transcripts from timed segments, and media rules. A transcript is one file, so its segments are gathered by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS, half to even."""
    s = F.bround(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def _joined(order: str, line: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"]), by)


def to_markdown(segments: DataFrame, model: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A transcript section of each source. Columns: seg_start, speaker (or null), text."""
    line = F.concat(F.lit("["), timestamp(F.col("seg_start")), F.lit("] "), F.coalesce(F.concat(F.lit("**"), F.col("speaker"), F.lit(":** ")), F.lit("")), F.trim("text"))
    head = f"# Transcript\n\n<details>\n<summary>Auto-generated transcript ({model})</summary>\n\n"
    return segments.groupBy(key).agg(F.concat(F.lit(head), _joined(order, line, "\n"), F.lit("\n\n</details>")).alias("md"))


def to_srt(segments: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A SubRip file of each source; cues are numbered from 1 in order."""
    text = F.concat(F.coalesce(F.concat(F.lit("["), F.col("speaker"), F.lit("] ")), F.lit("")), F.trim("text"))
    line = F.concat(srt_time(F.col("seg_start")), F.lit(" --> "), srt_time(F.col("seg_end")), F.lit("\n"), text)
    cues = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["line"]))
    return segments.groupBy(key).agg(F.concat(F.array_join(cues, "\n\n"), F.lit("\n")).alias("srt"))


def same_duration(made: Column, source: Column) -> Column:
    """A stage's result counts where its length is within 5 % of the source's, or either isn't known."""
    return F.when((source > 0) & made.isNotNull(), F.abs(made - source) / source < 0.05).otherwise(F.lit(True))


def unused_audio(audio: DataFrame, used: DataFrame) -> DataFrame:
    return audio.join(used, ["dir", "stem"], "left_anti")
