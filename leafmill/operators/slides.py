"""Slides from shapes: paragraphs, tables and pictures to Markdown, headings, footers and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import documents as D

#: Placeholders by what becomes of them (fixed values).
SKIPPED, FOOTERS, BODIES = ("slide_number", "date"), ("footer", "header"), ("body", "object")
PICTURES = ("picture", "object", "org_chart", "bitmap")
_NONE = "array<string>"


def run_text(paragraph: Column) -> Column:
    return F.array_join(F.transform(paragraph["runs"], lambda r: T.emphasis(r["text"], r["bold"], r["italic"])), "")


def plain_text(paragraphs: Column) -> Column:
    return T.strip(F.array_join(F.transform(paragraphs, lambda p: F.array_join(F.transform(p["runs"], lambda r: r["text"]), "")), "\n"))


def text_lines(paragraphs: Column, in_body: Column) -> Column:
    """Lines of a text shape. One blank line stands where blank paragraphs are, before the next line that isn't."""
    lines = F.transform(paragraphs, lambda p: T.paragraph(run_text(p), p["level"], p["kind"], in_body))
    kept = F.filter(F.transform(lines, lambda x, i: F.when((x != "") & (i > 0) & (F.get(lines, i - 1) == ""), F.array(F.lit(""), x)).when(x != "", F.array(x)).otherwise(F.array().cast(_NONE))), lambda a: F.size(a) > 0)
    return F.flatten(kept)


def table_lines(cells: Column) -> Column:
    """A pipe table; the first row is its header."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, T.cell_text), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(cells, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    return F.when(F.size(cells) > 0, F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30))).otherwise(F.array().cast(_NONE))


def pictures(shapes: DataFrame) -> DataFrame:
    """Pictures with digest, place, asset number, file name and whether they recur: on two slides at least and four fifths of the deck."""
    own = shapes.where("kind = 'picture' and image is not null").withColumn("digest", T.image_digest(F.col("image")))
    stem = F.regexp_extract("source", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = own.select(F.col("source").alias("document_id"), F.col("slide").alias("page"), F.col("ord").alias("n"), "digest", "ext", "name", "image", stem.alias("stem"))
    from leafmill.operators import images as I

    decks = shapes.select(F.col("source").alias("document_id"), F.col("slide").alias("page")).distinct()
    often = D.recurring_images(named, decks).select("document_id", "digest", F.lit(True).alias("recurs"))
    return I.asset_names(named).join(named.select("document_id", "page", "n", "name", "image"), ["document_id", "page", "n"]).join(often, ["document_id", "digest"], "left")


def slide_markdown(shapes: DataFrame) -> DataFrame:
    """source, slide, lines: heading, shapes in order, footers in italics, notes as a quote."""
    found = pictures(shapes)
    link = T.link_destination(F.concat_ws("/", F.lit("assets"), "stem", "filename"))
    again = F.coalesce("recurs", F.lit(False)) & (F.col("placement") == "link")
    shown = F.concat(F.when(again, "[").otherwise("!["), F.col("name"), F.lit("]("), link, F.lit(")"))
    found = found.select(F.col("document_id").alias("source"), F.col("page").alias("slide"), F.col("n").alias("ord"), F.array(shown).alias("shown"))
    rows = shapes.where("error is null").join(found, ["source", "slide", "ord"], "left")
    kind, holder = F.col("kind"), F.col("placeholder")
    lines = F.when(kind == "table", table_lines(F.col("cells"))).when(kind == "picture", F.col("shown")).when(kind == "text", text_lines(F.col("paragraphs"), F.coalesce(holder.isin(*BODIES), F.lit(False))))
    italic = F.transform(F.filter(lines, lambda x: T.strip(x) != ""), lambda x: F.concat(F.lit("*"), T.escape_markdown(T.strip(x)), F.lit("*")))
    notes = F.concat(F.array(F.lit("> **Notes:**")), F.transform(T.lines(plain_text(F.col("paragraphs"))), lambda x: F.concat(F.lit("> "), x)))
    body = F.when(holder.isin(*SKIPPED, "title"), F.array().cast(_NONE)).when(holder.isin(*FOOTERS), italic).when((kind == "notes") & (plain_text(F.col("paragraphs")) != ""), notes).when(kind == "notes", F.array().cast(_NONE)).otherwise(lines)
    title = F.when((holder == "title") & (plain_text(F.col("paragraphs")) != ""), T.escape_markdown(plain_text(F.col("paragraphs"))))
    rows = rows.select("source", "slide", "ord", F.coalesce(body, F.array().cast(_NONE)).alias("body"), title.alias("title"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("body") > 0, F.struct("ord", F.concat("body", F.array(F.lit(""))).alias("body"))))), lambda x: x["body"]))
    out = rows.groupBy("source", "slide").agg(parts.alias("parts"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("title"))
    number = F.concat(F.lit("Slide "), F.col("slide").cast("string"))
    heading = F.concat(F.lit("# "), F.coalesce(F.concat("title", F.lit(" — ")), F.lit("")), number)
    return out.select("source", "slide", F.concat(F.array(heading, F.lit("")), "parts").alias("lines"))


def deck_markdown(shapes: DataFrame) -> DataFrame:
    """source, stem, lines of whole decks: a page break behind each slide, the last one, too."""
    from leafmill.operators.grounding import PAGE_BREAK

    broken = slide_markdown(shapes).withColumn("lines", F.concat("lines", F.array(*map(F.lit, ("", PAGE_BREAK, "", "---", "")))))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slide", "lines"))), lambda x: x["lines"]))
    return broken.groupBy("source").agg(joined.alias("lines")).withColumn("stem", F.regexp_extract("source", r"([^/]*?)(?:\.[^./]*)?$", 1))


def chart_warnings(shapes: DataFrame, vision: bool, classify: bool, renderer: bool) -> DataFrame:
    """Charts need both passes and a renderer; each slide that has one without them gets a warning."""
    able = vision and classify and renderer
    why = "no renderer for charts" if vision and classify else "charts need the passes vision and classify"
    return shapes.where(F.lit(not able) & (F.col("kind") == "chart")).select("source", "slide", F.lit(why).alias("warning")).distinct()


def chart_regions(shapes: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """Where charts lie on the rendered page, in points."""
    sx, sy = (lambda c: T.points(c, F.col("slide_w"), page_w)), (lambda c: T.points(c, F.col("slide_h"), page_h))
    return shapes.where("kind = 'chart'").select("source", "slide", "ord", sx(F.col("left")).alias("x0"), sy(F.col("top")).alias("y0"), sx(F.col("left") + F.col("width")).alias("x1"), sy(F.col("top") + F.col("height")).alias("y1"))
