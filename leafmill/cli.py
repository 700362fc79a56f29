"""Command line: decks to Markdown, and transcripts to documents. Work is done by the operators; this only names inputs and outputs."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import PASSES, Config
from leafmill.functions import text as T
from leafmill.operators import media, slides
from leafmill.sinks import files as sink
from leafmill.sources import inputs, pptx


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("leafmill", description="Slide decks to Markdown")
    out.add_argument("paths", nargs="+")
    out.add_argument("-o", "--output")
    out.add_argument("--no-recursive", action="store_true")
    out.add_argument("--no-recent", action="store_true")
    out.add_argument("-q", "--quiet", action="store_true")
    out.add_argument("--all", action="store_true")
    for name in PASSES:
        out.add_argument(f"--{name}", action="store_true")
    out.add_argument("--env", action="append", default=[], metavar="KEY=VALUE")
    return out


def config(args: argparse.Namespace) -> Config:
    on = [p for p in PASSES if args.all or getattr(args, p)]
    bad = [x for x in args.env if "=" not in x]
    if bad:
        raise SystemExit(f"not KEY=VALUE: {bad[0]}")
    return Config().enabled(*on).with_values(dict(x.split("=", 1) for x in args.env))


def local_path(path: str = "path"):
    return F.regexp_replace(path, r"^file:/+", "/")


def convert(spark: SparkSession, paths: list[str], output: str | None = None, recursive: bool = True) -> DataFrame:
    """source, md_path, error, warnings of each input, in order; Markdown and images are written."""
    listed = None
    for arg, path in enumerate(paths):
        folder = os.path.isdir(path)
        if os.path.exists(path):
            one = inputs.listing(spark, path, recursive or not folder, arg).withColumn("from_folder", F.lit(folder)).withColumn("missing", F.lit(False))
        else:
            one = spark.range(1).select(F.lit(arg).alias("arg"), F.lit(os.path.abspath(path)).alias("path"), F.lit(False).alias("from_folder"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("file_hash"), F.lit(True).alias("missing"))
        listed = one if listed is None else listed.unionByName(one)
    found = inputs.expand(listed.withColumn("path", local_path())).withColumnRenamed("path", "source")
    found = found.withColumn("error", F.when(F.col("missing"), "no such file").otherwise(F.col("error")))
    shapes = pptx.shapes(found.where((F.col("error").isNull()) & (F.lower("source").endswith(".pptx"))))
    folder = F.lit(output) if output else T.output_folder(F.col("source"))
    decks = slides.deck_markdown(shapes.where("error is null")).withColumn("md_path", F.concat(folder, F.lit("/"), F.col("stem"), F.lit(".md")))
    texts = decks.select("md_path", sink.document_text(F.col("lines")).alias("content"))
    images = slides.pictures(shapes).where("placement = 'inline'").select(F.concat(F.lit(output) if output else T.output_folder(F.col("document_id")), F.lit("/assets/"), "stem", F.lit("/"), "filename").alias("path"), F.col("image").alias("content"))
    wrote = sink.write_files(texts, "md_path").select(F.col("path").alias("md_path"), F.col("error").alias("write_error"))
    assets = sink.write_files(images).where("error is not null").groupBy().agg(F.collect_list("error").alias("w"))  # failures of writing
    unread = shapes.where("error is not null").select("source", F.col("error").alias("read_error"))
    charts = slides.chart_warnings(shapes, False, False, False).groupBy("source").agg(F.collect_list(F.concat(F.lit("slide "), F.col("slide").cast("string"), F.lit(": "), F.col("warning"))).alias("warnings"))
    out = found.select("arg", "ord", "source", "error").join(decks.select("source", "md_path"), "source", "left").join(wrote, "md_path", "left").join(unread, "source", "left").join(charts, "source", "left").join(F.broadcast(assets), F.lit(True), "left")  # one row
    pdf = F.when(F.lower("source").endswith(".pdf") & F.lit(".pdf" not in inputs.READERS), "no reader is registered for .pdf")
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce("w", F.array().cast("array<string>")))
    return out.orderBy("arg", "ord").select("source", "md_path", F.coalesce("error", "read_error", "write_error", pdf).alias("error"), warnings.alias("warnings"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    asked = config(args)
    wanted = [p for p in PASSES if getattr(asked, p)]
    if wanted:  # rather than leave them out without a word
        print(f"[ERR] passes with a model aren't run by this command: {', '.join(wanted)}", file=sys.stderr)
        return 2
    own = spark or SparkSession.builder.appName("leafmill").getOrCreate()
    results = convert(own, args.paths, args.output, not args.no_recursive)
    # written once: what is reported is what was done
    rows = results.toLocalIterator()
    failed = total = 0
    for r in rows:
        total, failed = total + 1, failed + (r.error is not None)
        if not args.quiet or r.error:
            print(f"[ERR] {r.source}: {r.error}" if r.error else f"[OK] {r.source} -> {r.md_path}")
        for w in r.warnings:
            print(f"[WARN] {w}")
    print(f"Done: {total - failed} of {total} converted")
    return 2 if not total else int(failed > 0)


def transcribe(spark: SparkSession, documents: DataFrame, replies: DataFrame, turns: DataFrame | None, model: str) -> DataFrame:
    """Documents (path, stem, md) with the transcripts of recognition replies (stem, json), and speakers of turn replies (stem, json); written where they changed."""
    from leafmill.operators import retrieval

    segments = media.segments_of(replies, "stem")
    spoken = segments.select(F.col("stem").alias("conv_id"), F.col("ord").alias("turn"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "text")
    if turns is not None:
        named = retrieval.assign_speakers(spoken, media.turns_of(turns, "stem").withColumnRenamed("stem", "conv_id"))
        spoken = spoken.join(named, ["conv_id", "turn"], "left")
    else:
        spoken = spoken.withColumn("speaker", F.lit(None).cast("string"))
    new = sink.attached(documents, spoken.withColumnsRenamed({"conv_id": "stem", "turn": "ord"}), model)
    return sink.write_files(new.join(documents.select("path", F.col("md").alias("old")), "path").where("md <> old").select("path", F.col("md").alias("content")))


if __name__ == "__main__":
    sys.exit(main())
