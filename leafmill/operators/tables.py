"""Tables of pages from positioned lines alone: bands of columns, and runs of rows that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import layout, slides
from leafmill.operators import pages as P

#: Bands that neighbouring rows of a table share at least, and rows and columns of a table at least.
SHARED, ROWS, COLUMNS = 2, 2, 2
PAGE = list(P.PAGE)


def bands(lines: DataFrame) -> DataFrame:
    """Lines with band: the union of the intervals [x0, x1] of a page that touch or overlap, counted from the left.

    Gaps and islands in order of x0: a band begins where x0 lies behind all ends before it.
    """
    order = Window.partitionBy(*PAGE).orderBy("x0", "x1", "n")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = lines.withColumn("opens", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(1)))
    return opened.withColumn("band", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("opens")


def cells(lines: DataFrame) -> DataFrame:
    """document_id, page, row, band, md, x0, y0, x1, y1: what stands in one band of one row, in reading order.

    Rows of one line alone have no part, so a paragraph as wide as the page doesn't join all columns.
    """
    rows = P.rows_of(lines.select(*PAGE, "n", "x0", "y0", "x1", "y1", "md"))
    several = rows.withColumn("held", F.count("*").over(Window.partitionBy(*PAGE, "row"))).where("held > 1").drop("held")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "md"))), lambda x: T.strip(x["md"])), " ")
    return bands(several).groupBy(*PAGE, "row", "band").agg(joined.alias("md"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def detect(lines: DataFrame) -> DataFrame:
    """document_id, page, nth, x0, y0, x1, y1, n_rows, n_cols, cells (rows of texts, '' where a row has nothing in a band) and md (lines of a pipe table) of each table.

    Rows that follow each other on a page, each with two bands or more of the one before, are a run; a run of two rows and two columns or more is a table. All is windows and
    groups by page, so one task holds a page at most. Pages without rows of several lines have none; lines with a null side are in no band of their own.
    """
    found = cells(lines)
    held = found.groupBy(*PAGE, "row").agg(F.sort_array(F.collect_set("band")).alias("own"))
    order = Window.partitionBy(*PAGE).orderBy("row")
    follows = (F.col("row") == F.lag("row").over(order) + 1) & (F.size(F.array_intersect("own", F.lag("own").over(order))) >= SHARED)
    runs = held.withColumn("opens", F.coalesce((~follows).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*PAGE, "run").agg(F.count("*").alias("n_rows"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("all"))
    whole = whole.where((F.col("n_rows") >= ROWS) & (F.size("all") >= COLUMNS))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    placed = found.join(runs.select(*PAGE, "row", "run"), [*PAGE, "row"]).join(whole, [*PAGE, "run"])
    rows = placed.groupBy(*PAGE, "run", "row", "n_rows", "all").agg(F.map_from_entries(F.collect_list(F.struct("band", "md"))).alias("texts"), *box)
    rows = rows.withColumn("line", F.transform("all", lambda b: F.coalesce(F.try_element_at("texts", b), F.lit(""))))
    own = F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    out = rows.groupBy(*PAGE, "run", "n_rows", F.size("all").alias("n_cols")).agg(own.alias("cells"), *box)
    nth = F.row_number().over(order.orderBy("run"))
    return out.select(*PAGE, nth.alias("nth"), "x0", "y0", "x1", "y1", "n_rows", "n_cols", "cells", slides.table_lines(F.col("cells")).alias("md"))


def flow(lines: DataFrame) -> DataFrame:
    """document_id, page, out: the Markdown of pages whose tables are found in the lines themselves; what lies in a table isn't text as well."""
    found = detect(lines)
    return P.page_markdown(layout.outside_tables(lines, found, P.PAGE), found)
