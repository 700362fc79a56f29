"""Summaries of decks: a bounded sample of chunks, sections of a reply, and the header that goes before a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

#: Fixed value: most characters of the sampled chunks.
CONTEXT = 12_000
#: Sections of a reply by what their name holds.
SECTIONS = {"abstract": "abstract", "topics": "topic", "takeaways": "takeaway", "terms": "term"}


def bounded_sample(chunks: DataFrame, key: str = "document_id", budget: int = CONTEXT) -> DataFrame:
    """Chunks (chunk_index, content) of each document within ``budget`` characters: all, or the first, the last and every stride-th
    that still fits when its turn comes. A chunk that doesn't fit takes nothing from the budget, hence a fold and no running sum."""
    sizes = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.length("content").alias("size")))).alias("a"))
    n = F.size("a")
    stride = F.when(n > 6, F.greatest(F.lit(1), F.floor(n / 6))).otherwise(F.lit(1))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + x["size"])
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, i: Column) -> Column:
        size = F.get("a", i)["size"]
        take = ((i == 0) | (i == n - 1) | (i % F.col("stride") == 0)) & (s["used"] + size <= budget)
        return F.when(take, F.struct((s["used"] + size).alias("used"), F.concat(s["kept"], F.array(i)).alias("kept"))).otherwise(s)

    every = F.sequence(F.lit(0), n - 1)
    kept = F.when(F.col("total") <= budget, every).otherwise(F.aggregate(every, start, step, lambda s: s["kept"]))
    picked = sizes.withColumns({"stride": stride, "total": total}).select(key, F.explode(F.transform(kept, lambda i: F.get("a", i)["chunk_index"])).alias("chunk_index"))
    return chunks.join(picked, [key, "chunk_index"], "left_semi")


def reply_sections(replies: DataFrame, key: str = "document_id") -> DataFrame:
    """abstract, topics, takeaways, terms and valid of each reply (md). A section is the first whose name holds its word; equal names are one."""
    rows = replies.select(key, F.posexplode_outer(T.lines(F.col("md"))).alias("n", "line"))
    name = F.when(F.col("line").rlike(rf"^##\s*\S"), F.lower(T.strip(F.regexp_replace("line", r"^##\s*", ""))))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("name", name).withColumn("section", F.last("name", ignorenulls=True).over(upto))
    rows = rows.withColumn("begun", F.min("n").over(Window.partitionBy(key, "section"))).withColumn("line", T.strip(F.col("line")))
    body = F.col("name").isNull() & F.col("section").isNotNull()
    cols = []
    for out, word in SECTIONS.items():
        # per line: where its section began, so that the lowest begin can be chosen behind the aggregation
        line = F.when(body & F.col("section").contains(word), F.struct("begun", "n", "line"))
        cols.append(F.array_sort(F.collect_list(line)).alias(out))
        cols.append(F.min(F.when(F.col("section").contains(word), F.col("begun"))).alias(f"{out}_first"))
    found = replies.select(key).join(rows.groupBy(key).agg(*cols), key, "left")
    own = lambda out: F.transform(F.filter(out, lambda x: x["begun"] == F.col(f"{out}_first")), lambda x: x["line"])
    items = lambda lines: F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: T.strip(F.regexp_replace(x, "^- ", "")))
    text = F.array_join(F.filter(own("abstract"), lambda x: x != ""), "\n")
    out = found.select(key, F.coalesce(text, F.lit("")).alias("abstract"), items(own("topics")).alias("topics"), items(own("takeaways")).alias("takeaways"), F.filter(own("terms"), lambda x: x != "").alias("terms"))
    return out.withColumn("valid", (F.col("abstract") != "") & (F.size("topics") > 0) & (F.size("takeaways") > 0))


def fallback(titles: Column) -> tuple[Column, Column]:
    """Abstract and topics where no reply serves: the first title, and the titles there are."""
    named = F.filter(titles, lambda t: t != "")
    return F.coalesce(F.get(named, F.lit(0)), F.lit("")), named


def metadata(source: Column, slides: Column, as_of: Column) -> Column:
    """Lines on a document's name, its slides and the day (UTC) of conversion, which is given."""
    name = F.regexp_extract(source, r"([^/]*)$", 1)
    return F.array(F.concat(F.lit("Source: "), name), F.concat(F.lit("Slides: "), slides.cast("string")), F.concat(F.lit("Converted: "), F.date_format(as_of, "yyyy-MM-dd")))


def header(abstract: Column, topics: Column, takeaways: Column, terms: Column, meta: Column, n_topics: Column, n_takeaways: Column, n_terms: Column) -> Column:
    """The Markdown header: each list cut to its count, empty ones left out."""
    dash = lambda a: F.transform(a, lambda x: F.concat(F.lit("- "), x))
    none = F.array().cast("array<string>")

    def part(name: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {name}")), lines, F.array(F.lit("")))).otherwise(none)

    cut = lambda a, n: F.slice(F.coalesce(a, none), F.lit(1), n.cast("int"))
    lines = F.concat(
        F.array(F.lit("# Summary"), F.lit(""), F.lit("## Abstract"), T.strip(abstract), F.lit("")), part("Key Topics", dash(cut(topics, n_topics))),
        part("Key Takeaways", dash(cut(takeaways, n_takeaways))), part("Key Terms", cut(terms, n_terms)), F.array(F.lit("## Metadata")), dash(meta),
    )
    return F.array_join(lines, "\n")


def with_header(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(body, r"\n+$", ""), F.lit("\n"))


def request(n_topics: Column, n_takeaways: Column, n_terms: Column, context: Column) -> Column:
    """What a model is asked for: the sections and how many points each may have, then the chunks."""
    ask = F.concat(
        F.lit("Summarise the slides below as Markdown with these sections and nothing else.\n## Abstract: one sentence.\n## Key Topics: at most "), n_topics.cast("string"),
        F.lit(" list items, each important topic.\n## Key Takeaways: at most "), n_takeaways.cast("string"), F.lit(" list items.\n"),
        F.when(n_terms > 0, F.concat(F.lit("## Key Terms: at most "), n_terms.cast("string"), F.lit(" list items, a bold term and its meaning.\n"))).otherwise(""),
    )
    return F.concat(ask, F.lit("\nSlides:\n\n"), context)


def first_hits(hits: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks that any query of a document has found (key, query, rank, chunk_id), each once, in order of the chunks."""
    nth = F.row_number().over(Window.partitionBy(key, "chunk_id").orderBy("query", "rank"))
    one = hits.withColumn("nth", nth).where("nth = 1").select(key, "chunk_id", F.col("query").alias("first_query"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("chunk_index"))
    return one.join(chunks.select("chunk_id", "chunk_index"), "chunk_id").withColumn("place", place)
