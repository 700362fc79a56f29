"""Keyed tables in Parquet: settings, recent files, documents, chunks and vectors, and logs of events, transcripts and model answers.

Logs are appended, in partitions of day and bucket of their source, sorted by source and time within files: reading one source or day reads its partitions alone.
Documents, chunks and vectors lie in partitions by bucket of their document; a batch replaces the buckets of its documents (Spark's dynamic partition
overwrite: written beside, renamed when the job commits) and leaves the others as they are. Settings and recent files are small: they are merged as a whole and written
to a new version folder, made current by one rename of the file that names it. One writer at a time for a table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import log as L
from leafmill.sinks.files import write_atomic

SCHEMA_VERSION = "1"
#: Tables and their columns.
TABLES = {
    "meta": "key string, value string, at timestamp",
    "recent_files": "path string, last_used timestamp",
    "deck_documents": "document_id long, source string, source_hash string, stem string, slide_count int, created_at timestamp, updated_at timestamp",
    "deck_chunks": "chunk_id long, document_id long, chunk_index int, title string, content string, content_hash string",
    "deck_vectors": "chunk_id long, document_id long, embedding array<float>",
    "vision_events": "ts timestamp, source string, page int, image_ref string, image_digest string, stage string, model string, decision string, raw_answer string, latency_ms int, prompt_tokens int, completion_tokens int, markdown string, omitted_words string, error string, base_url string",
    "transcript_segments": "ts timestamp, source string, start double, end double, speaker string, text string, model string, error string",
    "changed_chunks": "chunk_id long, document_id long, chunk_index int, title string, content string, content_hash string",
    "model_answers": "ts timestamp, kind string, digest string, answer string",
}
#: What the buckets of a table are made of; logs have the day as well.
LOGS = {"vision_events": "source", "transcript_segments": "source", "model_answers": "digest"}
KEYED = {"deck_documents": "document_id", "deck_chunks": "document_id", "deck_vectors": "document_id"}
#: Buckets of a table, and files that a bucket's rows are dealt over at most.
BUCKETS, FILES = 64, 4


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables under one shared folder (a mounted path)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        os.makedirs(self.path, exist_ok=True)

    def _current(self, name: str) -> str | None:
        mark = f"{self.path}/{name}.current"
        return f"{self.path}/{name}/{open(mark).read()}" if os.path.exists(mark) else None

    def read(self, name: str) -> DataFrame:
        """A table as it is now; one that was never written is empty. Partition columns (day, bucket) stand behind the others."""
        parts = ", day date, bucket int" if name in LOGS else ", bucket int" if name in KEYED else ""
        at = f"{self.path}/{name}" if parts else self._current(name)
        known = at and os.path.exists(at)
        return self.spark.read.schema(TABLES[name] + parts).parquet(at) if known else self.spark.createDataFrame([], TABLES[name] + parts)

    def of(self, name: str, value: str | int) -> DataFrame:
        """The rows of one source, digest or document: its bucket alone is read, and within files the groups of rows that can hold it."""
        key = (LOGS | KEYED)[name]
        own = F.lit(value).cast(self.read(name).schema[key].dataType)
        number = self.spark.range(1).select(F.pmod(F.xxhash64(own), F.lit(BUCKETS)).cast("int")).first()[0]  # one row
        return self.read(name).where((F.col("bucket") == number) & (F.col(key) == own)).drop("bucket", "day")

    def _columns(self, name: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[name])
        return empty.unionByName(rows.drop("bucket", "day"), allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])

    def replace(self, name: str, rows: DataFrame) -> None:
        """A small table as a whole."""
        version = uuid.uuid4().hex
        self._columns(name, rows).write.parquet(f"{self.path}/{name}/{version}")
        write_atomic(f"{self.path}/{name}.current", version)

    def put(self, name: str, rows: DataFrame, every: bool = False) -> None:
        """Replace the buckets that ``rows`` fall into by them (``every``: all buckets)."""
        key = KEYED[name]
        dealt = self._columns(name, rows).withColumn("bucket", bucket(key))
        dealt = dealt.repartition("bucket", F.pmod(F.xxhash64(*dealt.columns[:2]), F.lit(FILES))).sortWithinPartitions("bucket", key)
        mode = "static" if every else "dynamic"
        dealt.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", mode).parquet(f"{self.path}/{name}")

    def touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys`` (a column of the table's key) fall into: at most all BUCKETS, named in the filter so that others aren't read."""
        numbers = [r[0] for r in keys.select(bucket(KEYED[name])).distinct().collect()]  # BUCKETS at most
        return self.read(name).where(F.col("bucket").isin(numbers)).drop("bucket")

    def append(self, name: str, rows: DataFrame) -> str | None:
        """Add to a log; missing columns are null. A failure is returned as text: logging never fails its caller."""
        key = LOGS[name]
        try:
            dealt = self._columns(name, rows).withColumn("day", F.to_date("ts")).withColumn("bucket", bucket(key))
            dealt.sortWithinPartitions("day", "bucket", key, "ts").write.partitionBy("day", "bucket").mode("append").parquet(f"{self.path}/{name}")
            return None
        except Exception as e:
            return str(e)

    def upsert(self, name: str, rows: DataFrame, key: str, order: str) -> None:
        self.replace(name, L.upsert(self.read(name), rows, key, order))

    def set_setting(self, key: str, value: str) -> None:
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.current_timestamp().alias("at"))
        self.upsert("meta", row, "key", "at")

    def setting(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).select("value").first()  # one row
        return row.value if row else None

    def open(self) -> Store:
        """Note the version of the tables' columns."""
        if self.setting("schema_version") != SCHEMA_VERSION:
            self.set_setting("schema_version", SCHEMA_VERSION)
        return self

    def record_recent(self, paths: DataFrame) -> None:
        """Paths with the time of use (path, last_used)."""
        self.upsert("recent_files", paths, "path", "last_used")

    def recent(self, n: int) -> DataFrame:
        return self.read("recent_files").orderBy(F.desc("last_used"), "path").limit(n)

    def upsert_documents(self, rows: DataFrame) -> DataFrame:
        """source, source_hash, stem, slide_count, updated_at: an id made of the source; the time of creation stays. Returns source and document_id."""
        new = rows.withColumn("document_id", F.xxhash64("source")).withColumn("created_at", F.col("updated_at"))
        self.put("deck_documents", merge_documents(self.touched("deck_documents", new), new))
        return new.select("source", "document_id")

    def index_chunks(self, chunks: DataFrame, embed) -> DataFrame:
        """Replace changed chunks (document_id, chunk_index, title, content, content_hash) and their vectors, drop those beyond a document's end; the changed ones.

        ``embed`` gives a vector column for a text column, and is asked for changed chunks alone. Only the buckets of the batch's documents are read and written; running it again changes
        nothing. A new width of vectors empties the index first. Vectors go first: a run that ends between the two writes leaves chunks of the old hash, so the next one embeds them again.
        """
        new = chunks.withColumn("chunk_id", F.xxhash64("document_id", "chunk_index"))
        width = new.limit(1).select(F.size(embed(F.col("content"))).alias("n")).first()  # one row
        if width is None:
            return self.read("deck_chunks").drop("bucket").limit(0)
        reset = self.setting("dimension") not in (None, str(width.n))
        old, vectors = self.touched("deck_chunks", new), self.touched("deck_vectors", new)
        if reset:
            old, vectors = old.limit(0), vectors.limit(0)
        self.replace("changed_chunks", changed_rows(new, old))
        changed = self.read("changed_chunks")
        kept = old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new.select(*old.columns))
        own = stale_dropped(vectors, kept, changed).unionByName(changed.select("chunk_id", "document_id", embed(F.col("content")).alias("embedding")))
        self.put("deck_vectors", own, every=reset)
        self.set_setting("dimension", str(width.n))
        self.put("deck_chunks", kept, every=reset)
        return changed

    def chunks(self, document_id: int) -> DataFrame:
        return self.of("deck_chunks", document_id).orderBy("chunk_index")


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each source with the earliest time of creation."""
    both = old.select(*old.columns, F.lit(0).alias("is_new")).unionByName(new.select(*old.columns, F.lit(1).alias("is_new")))
    by = Window.partitionBy("source")
    both = both.withColumn("created_at", F.min("created_at").over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.desc("updated_at"), F.desc("is_new"))))
    return both.where("nth = 1").drop("nth", "is_new")


def changed_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks that are new or whose hash differs from the stored one."""
    stored = old.select("document_id", "chunk_index", F.col("content_hash").alias("stored"))
    return new.join(stored, ["document_id", "chunk_index"], "left").where(~F.col("stored").eqNullSafe(F.col("content_hash"))).drop("stored")


def stale_dropped(vectors: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors of chunks that are still there and haven't changed."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(changed.select("chunk_id"), "chunk_id", "left_anti")
