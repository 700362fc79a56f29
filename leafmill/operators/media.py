"""Audio and transcript inputs: segments, turns, targets, windows over samples, versions of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.retrieval import AUDIO

SEGMENTS = "struct<segments:array<struct<start:double,end:double,text:string>>>"
TURNS = "array<struct<start:double,end:double,speaker:string,label:string>>"


def segments_of(replies: DataFrame, key: str = "source") -> DataFrame:
    """Segments of speech recognition replies (key, json): stripped texts, blank ones dropped, missing times 0; numbered from 0."""
    rows = replies.select(key, F.posexplode(F.from_json("json", SEGMENTS)["segments"]).alias("ord", "s"))
    rows = rows.select(key, "ord", F.coalesce("s.start", F.lit(0.0)).alias("start"), F.coalesce("s.end", F.lit(0.0)).alias("end"), T.strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    return rows.where("text <> ''")


def turns_of(replies: DataFrame, key: str = "source") -> DataFrame:
    """Speaker turns of replies (key, json), which are a list or hold one as turns; a turn is named by speaker, else label, else SPEAKER."""
    turns = F.when(F.col("json").rlike(r"^\s*\["), F.from_json("json", TURNS)).otherwise(F.from_json("json", f"struct<turns:{TURNS}>")["turns"])
    rows = replies.select(key, F.posexplode(turns).alias("turn_ord", "t"))
    named = F.coalesce(F.nullif(F.col("t.speaker"), F.lit("")), F.nullif(F.col("t.label"), F.lit("")), F.lit("SPEAKER"))
    return rows.select(key, "turn_ord", F.col("t.start").alias("t_start"), F.col("t.end").alias("t_end"), named.alias("speaker"))


def round_robin(durations: DataFrame, speakers: int = 2, seconds: float = 8.0, key: str = "source") -> DataFrame:
    """Turns of ``seconds`` in which speakers take their turn, up to each duration."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    rows = durations.where("duration > 0").select(key, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("turn_ord"))
    start = F.col("turn_ord") * seconds
    return rows.select(key, "turn_ord", start.alias("t_start"), F.least(start + seconds, F.col("duration")).alias("t_end"), F.format_string("SPEAKER_%02d", F.col("turn_ord") % max(1, speakers)).alias("speaker"))


def speech_seconds(regions: DataFrame, key: str = "source", least: float = 5.0) -> DataFrame:
    """Seconds of speech, and whether there are too few to isolate a voice."""
    total = regions.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("speech"))
    return total.withColumn("skip_isolation", F.col("speech") < least)


def targets(files: DataFrame) -> DataFrame:
    """Markdown and audio files (path); the engine's own transcripts and cleaned or isolated audio aren't targets."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rows = files.withColumns({"stem": stem, "ext": ext}).withColumn("kind", F.when(F.col("ext") == "md", "md").when(F.col("ext").isin(*AUDIO), "audio"))
    own = ((F.col("kind") == "md") & F.col("stem").contains(".transcript")) | ((F.col("kind") == "audio") & F.col("stem").rlike(r"\.(clean|isolated)(\.\d+)?$"))
    return rows.where(F.col("kind").isNotNull() & ~own)


def audio_to_markdown(audio: DataFrame, md: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """For each audio file (path, stem) the Markdown file it goes to: a given one (stem, to), else the first of its stem by ord, else none."""
    first = md.groupBy("stem").agg(F.min_by("path", "ord").alias("md"))
    out = audio.join(first, "stem", "left")
    if override is not None:
        out = out.join(override.select("stem", "to"), "stem", "left").withColumn("md", F.coalesce("to", "md")).drop("to")
    return out


def audio_override(md: DataFrame, audio: DataFrame) -> DataFrame:
    """Audio files named beside Markdown ones (path, stem): one goes to the Markdown of its stem; where there is one Markdown file alone, it takes the first."""
    sole = md.agg(F.count("*").alias("n"), F.min("path").alias("sole"))
    first = audio.agg(F.min_by("path", "ord").alias("first"))
    both = md.select("path", "stem").join(audio.groupBy("stem").agg(F.min_by("path", "ord").alias("audio")), "stem", "left")
    return both.join(F.broadcast(sole.join(F.broadcast(first))), F.lit(True)).select("path", F.coalesce("audio", F.when(F.col("n") == 1, F.col("first"))).alias("audio"))  # one row each


def free_version(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The first version (from 0) of each stem that no file has: existing holds stem and version of every artefact."""
    taken = existing.select("stem", "version").distinct()
    by = Window.partitionBy("stem").orderBy("version")
    # versions without a gap stand at their own place
    run = taken.withColumn("nth", F.row_number().over(by) - 1).where("version = nth").groupBy("stem").agg(F.max("version").alias("last"))
    return wanted.join(run, "stem", "left").withColumn("version", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")


def versioned(stem: Column, version: Column, suffix: str, ext: str) -> Column:
    """``a.transcript.md``, ``a.transcript.1.md``, ..."""
    return F.concat(stem, F.lit(f".{suffix}"), F.when(version > 0, F.concat(F.lit("."), version.cast("string"))).otherwise(""), F.lit(f".{ext}"))


def windows(totals: DataFrame, window: int, overlap: int, key: str = "source") -> DataFrame:
    """Windows (nth, begin, end) over ``total`` samples that overlap, and one more at the end where they don't reach it."""
    hop = max(window - overlap, 1)
    plain = F.when(F.col("total") <= window, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("total") - overlap - 1, F.lit(hop).cast("long")))
    rows = totals.where("total > 0").withColumn("begins", plain)
    tail = F.when(F.element_at("begins", -1) + window < F.col("total"), F.array(F.col("total") - window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(key, "total", F.posexplode(F.concat("begins", tail)).alias("nth", "begin"))
    return rows.withColumn("end", F.least(F.col("begin") + window, F.col("total")))


def overlap_add(pieces: DataFrame, overlap: int, key: str = "source") -> DataFrame:
    """One signal of each source from its windows (begin, end, total, values): linear ramps where windows overlap, divided by the summed weights.
    The samples of a window meet by their place, so a source may have any length."""
    ramp = lambda i: i / F.lit(float(max(overlap - 1, 1)))
    size = F.col("end") - F.col("begin")
    rows = pieces.select(key, "total", "begin", "end", F.posexplode("values").alias("i", "v"))
    up = F.when((F.col("begin") > 0) & (F.col("i") < overlap), ramp(F.col("i"))).otherwise(1.0)
    weight = F.when((F.col("end") < F.col("total")) & (size - 1 - F.col("i") < overlap), ramp(F.col("end") - F.col("begin") - 1 - F.col("i"))).otherwise(up)
    rows = rows.withColumns({"at": F.col("begin") + F.col("i"), "w": weight})
    return rows.groupBy(key, "at").agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("value"))


def pick_voice(sources: np.ndarray, speech: np.ndarray | None = None, tail: np.ndarray | None = None) -> int:
    """Which of the separated signals (samples, signals) is the voice: the most concentrated in speech, else the one that goes on as the tail did, else the loudest."""
    energy = (sources**2).sum(axis=0)
    if speech is not None and speech.any() and (energy > 0).any():
        return int(((sources[speech] ** 2).sum(axis=0) / (energy + 1e-8)).argmax())
    if tail is not None and len(tail):
        head = sources[: len(tail)]
        a, b = tail - tail.mean(), head - head.mean(axis=0)
        return int(((a[:, None] * b).sum(axis=0) / (np.linalg.norm(a) * np.linalg.norm(b, axis=0) + 1e-8)).argmax())
    return int(sources.std(axis=0).argmax())


def voices(windows_: DataFrame, key: str = "source") -> DataFrame:
    """key, nth, begin, end, total, values: the voice of each window (signals: array of arrays, speech: array of booleans or null). One source is followed in order, window by window."""
    kind = windows_.schema[key].dataType.simpleString()

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voice, end, own = None, 0, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if getattr(row, key) != own:
                    own, voice, end = getattr(row, key), None, 0
                signals = np.array([np.asarray(s, float) for s in row.signals]).T
                speech = None if row.speech is None else np.asarray(row.speech, bool)
                tail = None if voice is None or end <= row.begin else voice[-(end - row.begin) :]
                voice, end = signals[:, pick_voice(signals, speech, tail)], row.end
                out.append((own, row.nth, row.begin, row.end, row.total, voice.tolist()))
            yield pd.DataFrame(out, columns=[key, "nth", "begin", "end", "total", "values"])

    dealt = windows_.repartition(key).sortWithinPartitions(key, "nth")
    return dealt.mapInPandas(follow, f"{key} {kind}, nth int, begin long, end long, total long, values array<double>")


def without_title(md: Column) -> Column:
    return T.without_heading(md)


def tokens_used(usage: Column) -> Column:
    """Tokens that a model's reply (JSON text of usage) has cost."""
    return F.coalesce(F.get_json_object(usage, "$.completion_tokens").cast("long"), F.get_json_object(usage, "$.generated_tokens").cast("long"))


def tail(lines: Column, n: int = 10) -> Column:
    """The last lines that aren't blank."""
    kept = F.filter(lines, lambda x: T.strip(x) != "")
    return F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n)
