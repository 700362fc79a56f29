"""Text and binary files written by tasks: to a name of the attempt, then renamed, so that a retried task replaces its own file."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import markdown as M
from leafmill.operators import transcripts as S


def temp_sibling(path: str) -> str:
    """An empty file beside ``path`` with a name of its own."""
    fd, name = tempfile.mkstemp(prefix=os.path.basename(path) + ".", suffix=".tmp", dir=os.path.dirname(path) or ".")
    os.close(fd)
    return name


def write_atomic(path: str, content: str | bytes) -> None:
    """The whole file or none: on failure the temporary one goes."""
    name = temp_sibling(path)
    try:
        with open(name, "wb") as out:
            out.write(content.encode() if isinstance(content, str) else content)
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def write_files(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's content (text or binary) to its path, a local or mounted one; path, bytes and error of each. Folders are made."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at, what in zip(frame["path"], frame["content"], strict=True):
                try:
                    os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
                    write_atomic(at, what)
                    out.append((at, len(what.encode() if isinstance(what, str) else what), None))
                except OSError as e:
                    out.append((at, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    return rows.select(F.col(path).alias("path"), F.col(content).alias("content")).where("content is not null").mapInPandas(put, "path string, bytes long, error string")


def document_text(lines: Column) -> Column:
    """Lines of a document: joined, white space at the end gone, one line end."""
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), f"[{T.WHITE}]+$", ""), F.lit("\n"))


def markdown_files(documents: DataFrame, out: str) -> DataFrame:
    """path and content of each document (stem, lines): ``<out>/<stem>.md``."""
    return documents.select(F.concat(F.lit(out.rstrip("/") + "/"), F.col("stem"), F.lit(".md")).alias("path"), document_text(F.col("lines")).alias("content"))


def asset_files(images: DataFrame, out: str) -> DataFrame:
    """path and content of each distinct image (stem, filename, placement, blob): ``<out>/assets/<stem>/<filename>``."""
    return images.where("placement = 'inline'").select(F.concat_ws("/", F.lit(out.rstrip("/")), F.lit("assets"), "stem", "filename").alias("path"), F.col("blob").alias("content"))


def page_image(stem: Column, page: Column) -> Column:
    return F.format_string("%s_page_%02d.png", stem, page)


def polished_files(documents: DataFrame) -> DataFrame:
    """Documents (path, md) that polishing changes, as path and content."""
    new = M.polish(documents.select("path", "md"), "path").withColumnRenamed("md", "new")
    return documents.join(new, "path").where(F.col("md") != F.concat("new", F.lit("\n"))).select("path", F.concat("new", F.lit("\n")).alias("content"))


def attached(documents: DataFrame, segments: DataFrame, model: str, key: str = "stem", order: str = "ord") -> DataFrame:
    """Documents (key, md) with their transcript in place of an older one; documents without segments as they are. Attaching again changes nothing."""
    spoken = S.to_markdown(segments, model, key, order).withColumnRenamed("md", "transcript")
    bare = F.regexp_replace(M.strip_transcript(F.col("md")), r"\n+$", "")
    return documents.join(spoken, key, "left").withColumn("md", F.when(F.col("transcript").isNotNull(), F.concat(bare, F.lit("\n\n"), F.col("transcript"), F.lit("\n"))).otherwise(F.col("md"))).drop("transcript")


def transcript_files(segments: DataFrame, existing: DataFrame, model: str, overwrite: bool = False, key: str = "stem", order: str = "ord") -> DataFrame:
    """path and content of standalone transcripts and their SRT sidecars, under the first version that no artefact of the stem has."""
    from leafmill.operators import media

    stems = segments.select(key).distinct().withColumnRenamed(key, "stem")
    version = stems.withColumn("version", F.lit(0)) if overwrite else media.free_version(stems, existing)
    both = S.to_markdown(segments, model, key, order).join(S.to_srt(segments, key, order), key).withColumnRenamed(key, "stem").join(version, "stem")
    name = lambda ext: media.versioned(F.col("stem"), F.col("version"), "transcript", ext)
    made = F.array(F.struct(name("md").alias("path"), F.concat("md", F.lit("\n")).alias("content")), F.struct(name("srt").alias("path"), F.col("srt").alias("content")))
    return both.select(F.explode(made).alias("f")).select("f.*")


def report(results: DataFrame) -> DataFrame:
    """A line for each result (source, md_path, error, warnings) and one of totals, with the exit code: 0, or 1 if any failed."""
    line = F.when(F.col("error").isNull(), F.format_string("[OK] %s -> %s", "source", "md_path")).otherwise(F.format_string("[ERR] %s: %s", "source", "error"))
    rows = results.select("source", F.explode(F.concat(F.array(line), F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("[WARN] "), w)))).alias("line"))
    total = results.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count("*").alias("total"))
    done = total.select(F.lit(None).cast("string").alias("source"), F.format_string("Done: %d of %d converted", "ok", "total").alias("line"))
    return rows.unionByName(done).join(F.broadcast(total.select(F.when(F.col("ok") < F.col("total"), 1).otherwise(0).alias("exit_code"))), F.lit(True))  # one row
