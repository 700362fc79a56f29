"""Views that give the driver's tables the shape of slides, layout lines, images, segments and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.sources.readers import table

#: Rows of a large table that one task takes at a time.
TASK = 500_000


def candidates(spark: SparkSession, d: str) -> DataFrame:
    first = "split(text, '\\n')[0]"
    return table(spark, d, "documents").selectExpr("doc_id", f"""case cast(doc_id % 8 as int) when 0 then text when 1 then array_join(array_repeat(concat('- **', substring({first}, 1, 12), '**'), 12), '\\n')
        when 2 then concat(text, ' ...') when 3 then concat(repeat(' ', 50), '- ', {first}) when 4 then '' when 5 then repeat('process ', 60)
        when 6 then array_join(transform(sequence(0, 399), k -> concat('- item ', k)), '\\n') else concat('- ', replace(text, '\\n', '\\n- ')) end as md""")  # fmt: skip


def images(spark: SparkSession, d: str) -> DataFrame:
    """Lines as images of their order's page. They are dealt by page, ``TASK`` at a time, so that what sorts or groups them by page holds so many, however large the table is."""
    lines, orders, parts = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK))
    named = lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", "p_partkey", "p_size")
    both = named.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.expr("if(l_linenumber <= 3 and o_custkey % 2 = 0, concat('logo', o_custkey % 100), concat('img', p_partkey % 50))")
    return both.select((F.col("o_custkey") % 100).alias("document_id"), F.col("o_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.substring(F.md5(name.cast("binary")), 1, 8).alias("digest"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 10 + 60 * F.col("l_linenumber")).alias("height"))


def layout(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    rows = rows.withColumn("last", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    return rows.selectExpr("l_orderkey as page", "l_orderkey % 40 as document_id", "l_linenumber as n", "(p % 9) * 12.5D as x0", "if(l_linenumber = last, 500.0D, 30.0D + 4 * l_linenumber) as y0", "cast(8 + s % 14 as double) as size", "if(l_linenumber = last, concat('Footer ', l_orderkey), concat('line ', p)) as text")


def page_sizes(spark: SparkSession, d: str, documents: int = 40) -> DataFrame:
    """All pages, with or without lines."""
    return table(spark, d, "orders").selectExpr(f"o_orderkey % {documents} as document_id", "o_orderkey as page", "540.0D as height")


def image_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey % 100 as document_id", "o_orderkey as page")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line of an order, dealt by page, so that what groups by page needs no further shuffle."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("document_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("document_id", "l_orderkey")
    return rows.groupBy("document_id", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that share rows, bullets (some alone on their line), bold lead-ins, numbers and titles of several sizes."""
    rows = _rows(spark, d)
    rows = rows.selectExpr("l_orderkey as page", "document_id", "l_linenumber as n", "p", "(p % 9) * 12.5D as x0", "20.0D + l_linenumber * (4 + s % 6) as y0", "cast(8 + s % 14 as double) as size")
    md = "case cast(p % 5 as int) when 0 then concat('\u2022 item ', p) when 1 then '\u2022' when 2 then concat('**Term ', p, '** is') when 3 then concat(' ', p % 1200, ' ') else concat('12 line ', p) end"
    return rows.selectExpr("document_id", "page", "n", "x0", "y0", "x0 + 20 + p % 50 as x1", "y0 + size as y1", "size", f"{md} as md", f"{md} as text")


def grid_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in up to three columns, a few of them as wide as all."""
    rows = _rows(spark, d)
    rows = rows.selectExpr("document_id", "l_orderkey as page", "l_linenumber as n", "p", "(l_linenumber % 3) * 120.0D + p % 5 as x0", "20.0D + (l_linenumber div 3) * 14 + s % 3 as y0")
    return rows.selectExpr("document_id", "page", "n", "x0", "y0", "x0 + if(p % 37 = 0, 300, 40 + p % 50) as x1", "y0 + 8 as y1", "concat(' cell|', p) as md", "concat(' cell|', p) as text")


def decks(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat('# ', role, ' — Slide ', turn + 1, '\\n\\n', text) as md")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "md"))), lambda x: x["md"]), "\n\n---\n\n")
    return one.groupBy(F.col("conv_id").alias("document_id")).agg(joined.alias("md"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", "10 * turn as seg_start", "10 * turn + 5 + length(text) % 20 as seg_end")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id", "turn as turn_ord", "12 * turn as t_start", "12 * turn + 11 as t_end", "role as speaker")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_nationkey as dir", "concat('lec', c_custkey % 200) as stem", "element_at(array('md', 'mp3', 'wav', 'm4a', 'flac', 'wma'), cast(c_custkey % 6 as int) + 1) as ext")


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with headings, fences, runs of blank lines, list items and bold lead-ins."""
    return table(spark, d, "documents").selectExpr("doc_id", r"""case cast(doc_id % 4 as int) when 0 then concat('# ', replace(text, '. ', '.  \n# ')) when 1 then concat('\n\n\n', replace(text, ' ', '\n'), '\n\n\n\n- end\n\n')
        when 2 then concat('# a\n```\n# b\n- c\n', replace(text, '. ', '\n\n\n\n'), '\n```\n## d\n> e') else concat('intro\n# T\n- **Term:** x\n  - **Other** : y\n1. one\n| c |\n\n', replace(text, '. ', '\n- ')) end as md""")  # fmt: skip


def spoken(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", "10 * turn + 0.5D as seg_start", "10 * turn + 5 + length(text) % 20 + 0.25D as seg_end", "if(turn % 3 = 0, null, role) as speaker", "text")


def attached(spark: SparkSession, d: str) -> DataFrame:
    """Decks of which every other has a transcript behind it."""
    return decks(spark, d).withColumn("md", F.expr("if(document_id % 2 = 0, concat(md, '\\n\\n # Transcript \\nspoken\\n# Transcript\\nagain'), md)"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat(if(turn = 0, 'before', concat('## ', role)), '\\n', text) as md")
    return one.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "md"))), lambda x: x["md"]), "\n").alias("md"))
