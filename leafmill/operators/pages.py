"""Pages from positioned lines: rows, titles, bullets, columns, and the Markdown flow.

A line is a row (document_id, page, n, text, md, x0, y0, x1, y1, size). A page is small (some hundred lines), a document isn't: what
depends on the order of a page's lines is a fold over the page's sorted array inside the JVM; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

#: Vertical tolerance of a row, gap between columns, rows that show them, left edges of a complex page, least size of a title, most lines of one.
ROW, GAP, COLUMN_ROWS, EDGES, TITLE_SIZE, TITLE_LINES = 6.0, 30.0, 3, 8, 16.0, 4
PAGE = ("document_id", "page")


def _numbered(sorted_: Column) -> Column:
    """Lines of a page (structs with y0, x0, n and line), sorted by y0 first, as structs of row, x0, y0, n and line in reading order."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(state: Column, x: Column) -> Column:
        within = F.coalesce(x["y0"] - state["anchor"] <= ROW, F.lit(False))
        row = F.when(within, state["row"]).otherwise(state["row"] + 1)
        return F.struct(F.when(within, state["anchor"]).otherwise(x["y0"]).alias("anchor"), row.alias("row"), F.concat(state["rows"], F.array(row)).alias("rows"))

    rows = F.aggregate(sorted_, start, step, lambda s: s["rows"])
    place = lambda x, row: F.struct(row.alias("row"), x["line"]["x0"].alias("x0"), x["line"]["y0"].alias("y0"), x["line"]["n"].alias("n"), x["line"].alias("line"))
    return F.sort_array(F.zip_with(sorted_, rows, place))


def rows_of(lines: DataFrame, key: tuple[str, ...] = PAGE, order: tuple[str, ...] = ("y0", "x0", "n")) -> DataFrame:
    """``lines`` with row (from 1): a line belongs to the row of a first line at most ``ROW`` above it; and at, its place in reading order (from 1)."""
    own = [c for c in lines.columns if c not in key]
    page = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*own).alias("line")))).alias("a"))
    numbered = page.select(*key, F.posexplode(_numbered(F.col("a"))).alias("at", "z"))
    return numbered.select(*key, "z.line.*", "z.row", (F.col("at") + 1).alias("at"))


def parallel_columns(lines: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """Per page the rows in which two neighbours stand ``GAP`` apart."""
    rows = rows_of(lines, key, ("y0", "n")).withColumn("next", F.lead("x0").over(Window.partitionBy(*key, "row").orderBy("x0", "n")))
    return rows.groupBy(*key).agg(F.count_distinct(F.when(F.col("next") - F.col("x1") >= GAP, F.col("row"))).alias("gap_rows"))


def complexity(lines: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """Pages with many left edges, or with parallel columns."""
    edges = lines.groupBy(*key).agg(F.count_distinct(T.round_to_five(F.col("x0"))).alias("edges"))
    both = edges.join(parallel_columns(lines, key), list(key))
    return both.withColumn("is_complex", (F.col("edges") >= EDGES) | (F.col("gap_rows") >= COLUMN_ROWS))


def titled(lines: DataFrame, height: float = 540.0, key: tuple[str, ...] = PAGE) -> DataFrame:
    """``lines`` with is_title: lines of the page's largest size, and smaller ones right below them."""
    page = Window.partitionBy(*key)
    can = (F.col("size") >= TITLE_SIZE) & ~T.strip(F.col("text")).rlike(r"^\d{1,3}$")
    marked = lines.withColumn("can", can).withColumn("most", F.max(F.when(F.col("can"), F.col("size"))).over(page))
    marked = marked.withColumn("top", F.coalesce(F.col("can") & (F.col("most") - F.col("size") < 0.5), F.lit(False)))
    marked = marked.withColumn("tops", F.sum(F.col("top").cast("int")).over(page)).withColumn("low", F.max(F.when(F.col("top"), F.col("y0"))).over(page))
    below = F.col("can") & ~F.col("top") & (F.col("y0") >= F.col("low") - ROW)
    fits = (F.col("size") >= 0.7 * F.col("most")) & (F.col("y1") <= height * 0.45)
    order = Window.partitionBy(*key, "below").orderBy("y0", "n").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("below", below).withColumn("all_fit", F.min(fits.cast("int")).over(order) == 1).withColumn("nth", F.count("*").over(order))
    title = (F.col("tops") <= TITLE_LINES) & (F.col("top") | (F.col("below") & F.col("all_fit") & (F.col("tops") + F.col("nth") <= TITLE_LINES)))
    return marked.withColumn("is_title", F.coalesce(title, F.lit(False))).drop("can", "most", "top", "tops", "low", "below", "all_fit", "nth")


def titles(lines: DataFrame, height: float = 540.0, key: tuple[str, ...] = PAGE) -> DataFrame:
    """title of each page that has one, without a leading number."""
    piece = F.when(F.col("is_title"), F.struct("y0", "n", T.strip(F.col("text")).alias("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), " ")
    title = T.strip(F.regexp_replace(joined, r"^\s*\d{1,3}\s+", ""))
    return titled(lines, height, key).groupBy(*key).agg(title.alias("title")).where("title <> ''")


def content_lines(lines: DataFrame, footers: DataFrame, tables: DataFrame, height: float = 540.0) -> DataFrame:
    """Lines that are no title, page number or repeated footer, and not in a table. ``footers``: document_id, footer; ``tables``: document_id, page, x0, y0, x1, y1."""
    from leafmill.operators import layout

    own = titled(lines, height).where("not is_title").drop("is_title").where(~layout.is_page_number(F.col("text"), F.col("size"), F.col("y0")))
    own = own.withColumn("footer", T.footer_key(F.col("text"))).join(footers.select("document_id", "footer"), ["document_id", "footer"], "left_anti").drop("footer")
    return layout.outside_tables(own, tables, PAGE)


def bullet_levels(lines: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """edge and level: the left edges of a page's bullets, in order."""
    edges = lines.where(T.bullet_glyph(F.col("md")).isNotNull()).select(*key, T.round_to_five(F.col("x0")).cast("long").alias("edge")).distinct()
    return edges.withColumn("level", F.dense_rank().over(Window.partitionBy(*key).orderBy("edge")) - 1)


#: A line as the flow needs it: bare of white space, its glyph and what stands behind it, the left edge, the sides and the height.
_ITEM = "struct<bare:string,glyph:string,rest:string,edge:bigint,y0:double,y1:double,h:double>"


def _item(lines: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, n, x0 and the fields of ``_ITEM``: each line is taken apart once."""
    rows = lines.select(*key, "n", "x0", "y0", "y1", T.strip(F.col("md")).alias("bare"))
    return rows.select(*rows.columns, T.bullet_glyph(F.col("bare")).alias("glyph"), T.after_bullet(F.col("bare")).alias("rest"), T.round_to_five(F.col("x0")).cast("long").alias("edge"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)).alias("h"))


def _lone(x: Column) -> Column:
    return F.coalesce(x["glyph"].isNotNull() & (x["rest"] == ""), F.lit(False))


def merge_lone_bullets(items: Column) -> Column:
    """An item that is a glyph alone joins the next item of its row and keeps its own place; the next is then used up."""
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), F.lit(False).alias("used"))

    def step(state: Column, i: Column) -> Column:
        x, y = F.get(items, i), F.get(items, i + 1)
        joins = F.coalesce(_lone(x) & y["bare"].isNotNull() & (F.abs(y["y0"] - x["y0"]) <= ROW), F.lit(False))
        bare = F.when(y["bare"] == "", x["glyph"]).otherwise(F.concat(x["glyph"], F.lit(" "), y["bare"]))
        joined = F.struct(bare.alias("bare"), x["glyph"].alias("glyph"), y["bare"].alias("rest"), x["edge"].alias("edge"), x["y0"].alias("y0"), y["y1"].alias("y1"), y["h"].alias("h"))
        taken = T.let(joins, lambda j: F.struct(F.concat(state["out"], F.array(F.when(j, joined).otherwise(x))).alias("out"), j.alias("used")))
        return F.when(state["used"], F.struct(state["out"].alias("out"), F.lit(False).alias("used"))).otherwise(taken)

    merged = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), start, step, lambda s: s["out"])
    return F.when(F.exists(items, _lone), merged).otherwise(items)


def emit(items: Column, edges: Column) -> Column:
    """Markdown lines of items in order: list items, their wrapped lines, and paragraphs. ``edges``: the left edges of the page's bullets, in order."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("mode"), F.lit(0).alias("level"), F.lit(None).cast("double").alias("y1"))

    def step(s: Column, x: Column) -> Column:
        md, rest, is_item = x["bare"], x["rest"], x["glyph"].isNotNull()
        near = F.coalesce(x["y0"] - s["y1"], F.lit(0.0)) <= x["h"] * 1.6
        level = F.greatest(F.coalesce(F.array_position(edges, x["edge"]), F.lit(0)).cast("int") - 1, F.lit(0))
        wrapped = (s["mode"] == "list") & near & ~md.startswith("**")
        apart = F.when(is_item, s["mode"] == "para").when(wrapped, False).when(s["mode"] == "list", True).otherwise((s["mode"] == "para") & ~near)
        line = F.when(is_item, F.concat(F.repeat(F.lit("  "), level), F.lit("-"), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))).when(wrapped, F.concat(F.repeat(F.lit("  "), s["level"] + 1), md)).otherwise(md)
        out = F.concat(s["out"], F.when(apart, F.array(F.lit(""), line)).otherwise(F.array(line)))
        made = F.struct(out.alias("out"), F.when(is_item | wrapped, "list").otherwise("para").alias("mode"), F.when(is_item, level).otherwise(s["level"]).alias("level"), x["y1"].alias("y1"))
        return F.when(md == "", s).otherwise(made)

    return F.aggregate(items, start, step, lambda s: s["out"])


def page_markdown(lines: DataFrame, tables: DataFrame | None = None, key: tuple[str, ...] = PAGE) -> DataFrame:
    """out: the Markdown lines of each page. Text and tables (key, y0, md lines) interleave by y, text first; a table ends the text before it.
    A page's lines and tables are gathered once, all else is a fold over its arrays."""
    rows = _item(lines, key).select(*key, F.struct("y0", "x0", "n", F.struct("x0", "y0", "n", F.struct("bare", "glyph", "rest", "edge", "y0", "y1", "h").cast(_ITEM).alias("item")).alias("line")).alias("line"))
    cut = "struct<y:double,table:array<string>>"
    if tables is None:
        both = rows.withColumn("cut", F.lit(None).cast(cut))
    else:
        cuts = tables.select(*key, F.struct(F.col("y0").cast("double").alias("y"), F.col("md").alias("table")).cast(cut).alias("cut"))
        both = rows.unionByName(cuts, allowMissingColumns=True)
    pages = both.groupBy(*key).agg(F.sort_array(F.collect_list("line")).alias("a"), F.sort_array(F.collect_list("cut")).alias("cuts"))
    pages = pages.select(*key, "cuts", F.transform(_numbered(F.col("a")), lambda z: z["line"]["item"]).alias("items"))
    edges = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x["glyph"].isNotNull() & x["edge"].isNotNull()), lambda x: x["edge"])))
    pages = pages.select(*key, "cuts", edges.alias("edges"), merge_lone_bullets(F.col("items")).alias("items"))
    text = F.transform("items", lambda x, i: F.struct(x["y0"].alias("y"), F.lit(0).alias("kind"), i.alias("nth"), x.alias("item"), F.lit(None).cast("array<string>").alias("table")))
    ends = F.transform("cuts", lambda c: F.struct(c["y"].alias("y"), F.lit(1).alias("kind"), F.lit(0).alias("nth"), F.lit(None).cast(_ITEM).alias("item"), c["table"].alias("table")))
    pages = pages.select(*key, "edges", F.sort_array(F.concat(text, ends)).alias("nodes"))
    begins = F.filter(F.transform("nodes", lambda x, i: F.when(x["kind"] == 1, i + 1)), lambda i: i.isNotNull())
    pages = pages.select(*key, "edges", "nodes", F.concat(F.array(F.lit(0)), begins).alias("begins"))

    def part(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("nodes") + 1)
        own = F.transform(F.slice("nodes", begin + 1, end - begin - 1), lambda x: x["item"])
        table = F.get("nodes", end - 1)["table"]
        return F.concat(T.let(own, lambda o: emit(merge_lone_bullets(o), F.col("edges"))), F.coalesce(F.concat(table, F.array(F.lit(""))), F.array().cast("array<string>")))

    return pages.select(*key, F.flatten(F.transform("begins", part)).alias("out"))


def raw_text(lines: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """The text of each page, a line each."""
    piece = F.struct("n", T.strip(F.col("text")).alias("text"))
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n").alias("raw"))


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Lines from spans (document_id, page, line_ord, span_ord, text, flags, size, x0, y0, x1, y1): neighbours of one style are joined, white space stays outside the marks. Blank lines go."""
    key = ["document_id", "page", "line_ord"]
    order = Window.partitionBy(*key).orderBy("span_ord")
    style = F.struct((F.col("flags").bitwiseAND(16) > 0).alias("bold"), (F.col("flags").bitwiseAND(2) > 0).alias("italic"))
    marked = spans.withColumn("style", style).withColumn("new", F.coalesce((F.lag("style").over(order) != F.col("style")).cast("int"), F.lit(0)))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "text"))), lambda x: x["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size")]
    runs = marked.groupBy(*key, "run", "style").agg(text.alias("text"), *box)
    runs = runs.withColumn("md", T.mark_run(F.col("text"), F.col("style.bold"), F.col("style.italic")))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", c))), lambda x: x[c]), "").alias(c)
    out = runs.groupBy(*key).agg(join("text"), join("md"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.max, "size"))])
    return out.where(T.strip(F.col("text")) != "").withColumnRenamed("line_ord", "n")
