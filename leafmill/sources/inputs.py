"""Input files: folders are expanded in order, named files stay as they are named, each file once."""

from __future__ import annotations

import wave
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leafmill.sources import pptx
from leafmill.sources.readers import SUPPORTED

Reader = Callable[[DataFrame], DataFrame]
#: Readers of formats by suffix: from (source, content) to shapes or spans. ``register`` adds one.
READERS: dict[str, Reader] = {".pptx": pptx.shapes}


def register(suffix: str, reader: Reader) -> None:
    READERS[suffix.lower()] = reader


def supported() -> tuple[str, ...]:
    return tuple(sorted({*SUPPORTED, *READERS}))


def suffix(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def expand(listed: DataFrame, named_too: bool = True) -> DataFrame:
    """Inputs in order, each path once, at its first place. ``listed``: arg (place of the argument), path, from_folder.
    Files of folders need a supported suffix and come sorted; named files pass as they are, or with ``named_too`` False need one as well."""
    known = suffix().isin(*supported())
    kept = listed.where(known if not named_too else (known | ~F.col("from_folder")))
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("arg"))).where("nth = 1").drop("nth")
    error = F.when(~known, F.concat(F.lit("unsupported format: "), suffix()))
    return first.withColumn("error", error).withColumn("ord", F.row_number().over(Window.partitionBy("arg").orderBy("path")))


def listing(spark: SparkSession, folder: str, recursive: bool = True, arg: int = 0) -> DataFrame:
    """The files of a folder, with contents where they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.select(F.lit(arg).alias("arg"), "path", F.lit(True).alias("from_folder"), "content", F.md5("content").alias("file_hash"))


@F.pandas_udf(DoubleType())
def wave_seconds(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Length of WAVE files; null for anything else."""

    def one(raw: bytes | None) -> float | None:
        try:
            with wave.open(BytesIO(raw)) as f:
                return f.getnframes() / f.getframerate()
        except Exception:
            return None

    for batch in contents:
        yield pd.Series([one(x) for x in batch], dtype="float64")
