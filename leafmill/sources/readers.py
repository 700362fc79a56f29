"""Sources: tables, whole Markdown files, documents by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".pptx", ".pdf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("md"))


def documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files with an error where the suffix isn't supported; contents are read by whoever needs them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select(F.col("path").alias("source"), suffix.alias("ext"), "content", F.when(~suffix.isin(*SUPPORTED), F.concat(F.lit("unsupported format: "), suffix)).alias("error"))
