"""Rules over documents, pages, images and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T


#: Fixed values of the quality gate: most lines, deepest item, most equal lines, lines from which variety counts and its least share, words and least share.
LINES, DEPTH, EQUAL, MANY, VARIETY, WORDS, RICHNESS = 300, 12, 8, 20, 0.5, 50, 0.05
#: Fixed value: what a model leaves where it had nothing to say.
PLACEHOLDER = r"\.\.\.|\[(?:specific|your|insert|placeholder)[^\]]*\]"


def _longest_run(sorted_: Column) -> Column:
    """Most equal neighbours in a sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["last"].eqNullSafe(x), s["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(sorted_, start, step, lambda s: s["most"])


def quality_reason(markdown: Column) -> Column:
    """Why a transcription is refused, or null; the first rule that holds names the reason. The text is made and its lines are cut once; only what is short
    enough has its lines normalised, once, and a run of equal ones is found in their order."""
    lines = lambda md: F.filter(T.lines(md), lambda x: x.rlike(f"[^{T.WHITE}]"))
    return T.let(markdown, lambda md: T.let(lines(md), lambda own: _reason(md, own)))


def _reason(markdown: Column, lines: Column) -> Column:
    depth = F.coalesce(F.array_max(F.transform(F.filter(lines, T.is_bullet), lambda x: F.floor((F.length(x) - F.length(T.lstrip(x))) / 2))), F.lit(0))
    share = lambda part, whole: F.size(part).cast("double") / F.size(whole)
    repeats = lambda normal: (_longest_run(normal) > EQUAL) | ((F.size(lines) >= MANY) & (share(F.array_distinct(normal), lines) < VARIETY))
    return (
        F.when(~F.coalesce(markdown, F.lit("")).rlike(f"[^{T.WHITE}]"), "empty")
        .when(F.size(lines) > LINES, "runaway length")
        .when(markdown.rlike(PLACEHOLDER), "placeholder")
        .when(depth > DEPTH, "excessive nesting")
        .when(T.let(F.sort_array(F.transform(lines, T.normalize_line)), repeats), "repetitive")
        .when(T.let(F.regexp_extract_all(F.lower(markdown), F.lit("([a-z0-9]+)"), F.lit(1)), lambda words: (F.size(words) >= WORDS) & (share(F.array_distinct(words), words) < RICHNESS)), "low information")
    )


def recurring_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Digests on at least max(2, 80 %) of their document's pages, with or without images. Columns: document_id, page, digest; pages: document_id, page."""
    n = pages.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    seen = images.select("document_id", "digest", "page").distinct().groupBy("document_id", "digest").agg(F.count("*").alias("on_pages"))
    least = F.greatest(F.lit(2), F.ceil(F.col("pages") * F.lit(0.8).cast("double")))
    return seen.join(n, "document_id").where(F.col("on_pages") >= least).select("document_id", "digest", "on_pages")


def repeated_footers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Footer keys of small lines in the bottom band, where at least max(2, half of the pages) lines have them; the empty key counts, too.
    Columns: document_id, page, y0, size, text; pages: document_id, page, height."""
    n = pages.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    low = lines.join(pages, ["document_id", "page"]).where((F.col("y0") >= F.col("height") - 70) & (F.col("size") <= 16))
    keys = low.groupBy("document_id", T.footer_key(F.col("text")).alias("footer")).agg(F.count("*").alias("n"))
    return keys.join(n, "document_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(0.5).cast("double")))).select("document_id", "footer", "n")


def looks_like_content(width: Column, height: Column) -> Column:
    """Large and wide or tall: an image that is content whatever a model says."""
    return F.coalesce((width * height >= 150000) & (F.try_divide(F.greatest(width, height), F.least(width, height)) >= 2.0), F.lit(False))


def image_placement(images: DataFrame) -> DataFrame:
    """inline at an image's first place in its document, else link; assets are numbered by first appearance. Columns: document_id, page, n, digest."""
    first = F.min(F.struct("page", "n")).over(Window.partitionBy("document_id", "digest"))
    placed = images.select("document_id", "page", "n", "digest").withColumn("first", first)
    placed = placed.withColumn("asset", F.dense_rank().over(Window.partitionBy("document_id").orderBy("first")))
    return placed.withColumn("placement", F.when(F.col("first") == F.struct("page", "n"), "inline").otherwise("link")).drop("first")


def slides(markdown: DataFrame) -> DataFrame:
    """Slides at level-one headings outside fences. Columns in: document_id, md; out: document_id, slide (from 1), content, n_lines."""
    lines = markdown.select("document_id", F.posexplode(F.split("md", "\n")).alias("n", "line"))
    upto = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(T.lstrip(F.col("line")).startswith("```").cast("int")).over(upto)
    lines = lines.withColumn("fence", fence % 2)
    starts = ((F.col("n") > 0) & (F.col("fence") == 0) & F.col("line").startswith("# ")).cast("int")
    lines = lines.withColumn("slide", (F.sum(starts).over(upto) + 1).cast("int"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("document_id", "slide").agg(content.alias("content"), F.count("*").alias("n_lines"))


def split_slides(markdown: DataFrame) -> DataFrame:
    """document_id, slide, title, n_lines, content_hash of each slide."""
    return slides(markdown).select("document_id", "slide", T.slide_title(F.col("content")).alias("title"), "n_lines", F.md5(T.strip(F.col("content")).cast("binary")).alias("content_hash"))
