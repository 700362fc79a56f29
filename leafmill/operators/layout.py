"""Rules over the lines and images of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T


def is_page_number(text: Column, size: Column, y0: Column) -> Column:
    return T.strip(text).rlike(r"^\d{1,3}$") & (size <= 16) & (y0 < 40)


def backgrounds(images: DataFrame) -> DataFrame:
    """Images on more than one page of which some rectangle fills each page they are on. Columns: document_id, page, digest, is_full."""
    page = images.groupBy("document_id", "digest", "page").agg(F.bool_or("is_full").alias("full"))
    own = page.groupBy("document_id", "digest").agg(F.count("*").alias("pages"), F.bool_and("full").alias("full"))
    return own.where("pages > 1 and full").drop("full")


def fills(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, slack: float = 2.0) -> Column:
    return (x0 <= slack) & (y0 <= slack) & (x1 >= width - slack) & (y1 >= height - slack)


def readability(width: Column, height: Column) -> Column:
    """Why an image can't be read by its size, or null; unknown sizes pass."""
    return F.when(F.coalesce(F.least(width, height) < 250, F.lit(False)) & width.isNotNull() & height.isNotNull(), "low resolution")


def outside_tables(lines: DataFrame, tables: DataFrame, key: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lines of which less than half lies in any table of their page: an equi join on the page, then rectangle arithmetic."""
    side = lambda a, b, c, d: F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    held = F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("tables")
    both = lines.join(tables.groupBy(*key).agg(held), list(key), "left")
    met = lambda t: side(F.col("x0"), F.col("x1"), t["x0"], t["x1"]) * side(F.col("y0"), F.col("y1"), t["y0"], t["y1"])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = F.exists("tables", lambda t: (area > 0) & (met(t) >= area * 0.5))
    return both.where(~F.coalesce(inside, F.lit(False))).drop("tables")
