"""Line rules of Markdown: what polishing inserts and drops, kinds of lines, sections, omissions, changed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

#: Most topics, takeaways and terms of a summary, and the fewest (fixed values).
TARGETS = {"n_topics": ("concepts", 3, 16), "n_takeaways": ("concepts", 3, 12), "n_terms": ("terms", 0, 8)}
#: Fixed values (P7, A10 of the survey): how a line begins that a rewrite must keep, and a bold term with its colon.
STRUCTURAL = r"^(#|!\[|\[Page\s+\d+\]\(|\[image\]\(|>|<div|<details|</details>|```|\||---)"
TERM = r"^\*\*[^*]+(:\*\*|\*\*\s*:)"


def fenced_lines(markdown: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of ``md`` with their number n and whether a fence is open behind each (the line of a fence counts)."""
    lines = markdown.select(key, F.posexplode(F.split("md", "\n")).alias("n", "raw")).withColumn("line", F.regexp_replace("raw", f"[{T.WHITE}]+$", ""))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_fence = T.lstrip(F.col("line")).startswith("```")
    return lines.withColumn("is_fence", is_fence).withColumn("fence", F.sum(is_fence.cast("int")).over(upto) % 2 == 1)


def polish(markdown: DataFrame, key: str = "doc_id") -> DataFrame:
    """Closing white space goes, of blank lines in a row two stay, headings stand between blank lines. A rule of the line and the two before it."""
    at = Window.partitionBy(key).orderBy("n")
    lines = fenced_lines(markdown, key).withColumn("heading", ~F.col("fence") & F.col("line").startswith("#"))
    before, two, headed = F.lag("line").over(at), F.lag("line", 2).over(at), F.lag("heading").over(at)
    lines = lines.withColumns({"before": before, "two": two, "headed": headed})
    lines = lines.where(~((F.col("line") == "") & F.coalesce((F.col("before") == "") & (F.col("two") == ""), F.lit(False))))
    apart = F.coalesce((F.col("before") != "") & (F.col("line") != "") & (F.col("heading") | F.col("headed")), F.lit(False))
    piece = F.struct("n", F.when(apart, F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(F.regexp_replace(joined, r"\n+$", "").alias("md"))


def is_structural(line: Column) -> Column:
    """Headings, images, links to pages, quotes, blocks, fences, tables and rules."""
    return T.lstrip(line).rlike(STRUCTURAL)


def line_kinds(markdown: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many lines are structural, editable, begin in bold, or are list items."""
    lines = markdown.select(key, F.explode(F.split("md", "\n")).alias("line"))
    kinds = {"structural": is_structural(F.col("line")), "editable": (T.strip(F.col("line")) != "") & ~is_structural(F.col("line")), "leads": T.lstrip(F.col("line")).startswith("**"), "bullets": T.is_bullet(F.col("line"))}
    return lines.groupBy(key).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def summary_targets(markdown: DataFrame, key: str = "doc_id") -> DataFrame:
    """List items without indent, and bold lead-ins with a colon, outside fences, tables, quotes and headings; and how many points a summary gets."""
    open_ = ~F.col("fence") & ~F.col("is_fence")
    item = open_ & F.col("line").rlike(r"^(?:[-*]\s+|[0-9]+\.\s+)\S")
    term = open_ & T.strip(F.col("line")).rlike(TERM)
    counted = fenced_lines(markdown, key).groupBy(key).agg(F.count_if(item).alias("concepts"), F.count_if(term).alias("terms"))
    return counted.withColumns({name: F.greatest(F.lit(low), F.least(F.lit(high), F.col(of))) for name, (of, low, high) in TARGETS.items()})


def sections(markdown: DataFrame, key: str) -> DataFrame:
    """Lines of each level-two section; those before the first heading are dropped, sections of one name are joined."""
    lines = markdown.select(key, F.posexplode(F.split("md", "\n")).alias("n", "line"))
    name = F.when(F.col("line").rlike(r"^##\s*\S"), F.lower(F.regexp_extract("line", r"^##\s*(.+?)\s*$", 1)))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("name", name).withColumn("section", F.last("name", ignorenulls=True).over(upto))
    return lines.where("section is not null").groupBy(key, "section").agg(F.count_if(F.col("name").isNull()).alias("n_lines"))


def strip_transcript(markdown: Column) -> Column:
    """What stands before the first transcript heading; all of it where there is none."""
    head = F.split(markdown, r"(?m)^[ \t]*# Transcript[ \t]*$", 2)
    cut = F.when(head[0] == "", "").otherwise(F.concat(F.regexp_replace(head[0], r"\n+$", ""), F.lit("\n")))
    return F.when(F.size(head) > 1, cut).otherwise(markdown)


def omissions(rows: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """Content words of the old text that the new one lacks, and added ones."""
    before, after = T.content_words(F.col(old)), T.content_words(F.col(new))
    both = rows.select(key, before.alias("b"), after.alias("a"))
    return both.select(key, F.size(F.array_except("b", "a")).alias("omitted"), F.size(F.array_except("a", "b")).alias("added"))


def changed_chunks(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose hash isn't the stored one, or that aren't stored. One equi join."""
    return new.join(stored.withColumnRenamed("content_hash", "old"), keys, "left").where(~F.col("old").eqNullSafe(F.col("content_hash"))).select(*keys)


def pipe_table(rows: DataFrame, key: str, order: str, cells: list[str]) -> DataFrame:
    """One Markdown table for each key; the row of lowest order is the header."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[T.cell_text(F.col(c).cast("string")) for c in cells]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"])
    rule = F.lit("|" + " --- |" * len(cells))
    return rows.groupBy(key).agg(lines.alias("l")).select(key, F.concat_ws("\n", F.col("l")[0], rule, F.slice("l", 2, 1 << 30)).alias("md"))
