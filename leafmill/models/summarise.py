"""Decks to summary headers: index, retrieval, request, reply, check, and a header from the titles where no reply serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import documents as D
from leafmill.operators import markdown as M
from leafmill.operators import retrieval as R
from leafmill.operators import summary as U


#: What the slides of a deck are looked up by.
QUERIES = ("subject and aims of the presentation", "conclusions and main points", "terms and what they mean")
#: As many hits as a deck has slides.
EVERY = 1 << 30


def retrieved(slides: DataFrame, embed, k: int = EVERY) -> DataFrame:
    """The slides (document_id, slide, content, ...) that are among the ``k`` nearest of their own document to any of the queries.

    Queries are embedded in one batch (their vectors, three, are all that the driver sees), slides once each; nearest slides, the union of first hits and the slides
    again are joins by document and slide.
    """
    spark = slides.sparkSession
    chunks = slides.select("document_id", "slide", F.xxhash64("document_id", "slide").alias("chunk_id"), embed(F.col("content")).alias("embedding"))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string").coalesce(1).select("query", embed(F.col("text")).alias("vector")).collect()
    each = F.array(*[F.struct(F.lit(r.query).alias("query"), F.lit([float(x) for x in r.vector]).alias("vector")) for r in asked])
    queries = slides.select("document_id").distinct().select("document_id", F.explode(each).alias("q")).select(F.xxhash64("document_id", "q.query").alias("query_id"), "document_id", "q.query", "q.vector")
    near = R.nearest_chunks(chunks, queries, k).join(queries.select("query_id", "document_id", "query"), "query_id")
    hits = U.first_hits(near, slides.select(F.xxhash64("document_id", "slide").alias("chunk_id"), F.col("slide").alias("chunk_index")))
    return slides.join(hits.select("document_id", F.col("chunk_index").alias("slide")), ["document_id", "slide"], "left_semi")


def headers(decks: DataFrame, as_of, ask, embed=None, k: int = EVERY) -> DataFrame:
    """document_id, md with its header, used (reply or titles) for each deck (document_id, source, md). ``ask`` is a function of a text column, asked once for each deck.

    With ``embed`` (a vector column for a text column) the context is what the queries find in the deck, else a bounded sample of it.
    """
    slides = D.slides(decks.select("document_id", "md")).withColumn("title", T.slide_title(F.col("content")))
    sample = (retrieved(slides, embed, k) if embed else U.bounded_sample(slides.withColumnRenamed("slide", "chunk_index"))).withColumnRenamed("slide", "chunk_index")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n")
    context = sample.groupBy("document_id").agg(text.alias("context"))
    titles = slides.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide", "title"))), lambda x: x["title"]).alias("titles"), F.count("*").cast("int").alias("n_slides"))
    targets = M.summary_targets(decks.select("document_id", "md"), "document_id").drop("concepts", "terms")
    rows = decks.join(titles, "document_id").join(targets, "document_id").join(context, "document_id", "left")
    request = U.request(F.col("n_topics"), F.col("n_takeaways"), F.col("n_terms"), F.coalesce("context", F.lit("")))
    rows = rows.withColumn("reply", ask(request))
    found = U.reply_sections(rows.select("document_id", F.col("reply").alias("md")))
    rows = rows.join(found, "document_id", "left")
    first, named = U.fallback(F.col("titles"))
    none, good = F.array().cast("array<string>"), F.coalesce("valid", F.lit(False))
    pick = lambda a, b: F.when(good, a).otherwise(b)
    head = U.header(pick(F.col("abstract"), first), pick(F.col("topics"), named), pick(F.col("takeaways"), none), pick(F.col("terms"), none), U.metadata(F.col("source"), F.col("n_slides"), as_of), F.col("n_topics"), F.col("n_takeaways"), F.col("n_terms"))
    return rows.select("document_id", U.with_header(head, F.col("md")).alias("md"), F.when(good, "reply").otherwise("titles").alias("used"))
