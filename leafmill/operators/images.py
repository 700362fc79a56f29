"""Images as data: readability from pixels, the gate before a model, names of assets, and models called once for each content."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leafmill.functions import text as T
from leafmill.operators import documents as D

#: Sharpness under which an image is blurry; list items over which a gist only enumerates.
BLUR, GIST_ITEMS = 30.0, 6


def decode_png(blob: bytes) -> np.ndarray | None:
    """Gray values (mean of the colours) of an 8-bit PNG that isn't interlaced; None for others."""
    try:
        if blob[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, packed, palette = 8, b"", None
        while at < len(blob):
            size, kind = struct.unpack(">I4s", blob[at : at + 8])
            body = blob[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed += body
            at += 12 + size
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlace:
            return None
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
        out = np.zeros((height, width * channels), np.uint8)
        above = np.zeros(width * channels, np.uint8)
        for y in range(height):
            kind, row = int(rows[y, 0]), rows[y, 1:]
            if kind == 2:
                own = row + above
            elif kind == 1:
                own = np.cumsum(row.reshape(width, channels), axis=0, dtype=np.uint8).reshape(-1)
            elif kind == 0:
                own = row
            else:
                own = row.astype(np.int64).copy()
                for x in range(len(own)):
                    left, up = int(own[x - channels]) if x >= channels else 0, int(above[x])
                    corner = int(above[x - channels]) if x >= channels else 0
                    guess = left + up - corner
                    paeth = min((abs(guess - v), i, v) for i, v in enumerate((left, up, corner)))[2]
                    own[x] = (own[x] + ((left + up) // 2 if kind == 3 else paeth)) & 255
                own = own.astype(np.uint8)
            out[y] = above = own
        pixels = out.reshape(height, width, channels)
        if palette is not None and colour == 3:
            pixels = palette[pixels[:, :, 0]]
        return pixels[:, :, :3].astype(np.int64).sum(axis=2) // 3 if pixels.shape[2] >= 3 else pixels[:, :, 0].astype(np.int64)
    except Exception:
        return None


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of each inner pixel's four neighbours less four times itself; 0 without inner pixels."""
    if min(gray.shape) < 3:
        return 0.0
    inner = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    return float(inner.var())


@F.pandas_udf(DoubleType())
def sharpness(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Laplacian variance of each image; null where it can't be decoded."""
    for batch in blobs:
        grays = [None if b is None else decode_png(b) for b in batch]
        yield pd.Series([None if g is None else laplacian_variance(g) for g in grays], dtype="float64")


def readable(images: DataFrame) -> DataFrame:
    """``images`` (digest, blob, width, height) with unreadable: low resolution, blurry, or null. Only what the sizes leave is decoded, each content once."""
    from leafmill.operators import layout

    sized = images.withColumn("small", layout.readability(F.col("width"), F.col("height")))
    seen = sized.where("small is null").groupBy("digest").agg(F.first("blob").alias("blob")).select("digest", sharpness("blob").alias("sharpness"))
    blurry = F.when(F.col("sharpness") < BLUR, "blurry")
    return sized.join(seen, "digest", "left").withColumn("unreadable", F.coalesce("small", blurry)).drop("small", "sharpness")


def gated_category(answer: Column, failed: Column, width: Column, height: Column, enabled: bool = True) -> Column:
    """text where the gate is off; decorative where the model failed; a decorative image that looks like content is a diagram."""
    if not enabled:
        return F.lit("text")
    named = F.when(failed, "decorative").otherwise(T.category(answer))
    return F.when((named == "decorative") & D.looks_like_content(width, height), "diagram").otherwise(named)


def gist_reason(md: Column, category: Column) -> Column:
    """Why a transcription is refused; a diagram's that passes but lists too much is enumerated."""
    items = lambda text: F.size(F.filter(T.lines(text), T.is_bullet))
    return T.let(md, lambda text: F.coalesce(D.quality_reason(text), F.when((category == "diagram") & (items(text) > GIST_ITEMS), "enumerated")))


def once_per_digest(images: DataFrame, call, name: str) -> DataFrame:
    """``images`` with a column of what ``call`` (a function of a Column) gives, asked once for each content."""
    answers = images.groupBy("digest").agg(F.first("blob").alias("blob")).select("digest", call(F.col("blob")).alias(name))
    return images.join(answers, "digest", "left")


def transcribed(images: DataFrame, classify, transcribe, enabled: bool = True) -> DataFrame:
    """The image pipeline: readability, category, override, transcription, quality, quote. Columns category, skipped, md (null where skipped)."""
    rows = once_per_digest(readable(images), classify, "answer")
    rows = rows.withColumn("category", gated_category(F.col("answer"), F.col("answer").isNull(), F.col("width"), F.col("height"), enabled))
    rows = rows.withColumn("skipped", F.coalesce("unreadable", F.when(F.col("category") == "decorative", "decorative")))
    asked = once_per_digest(rows.where("skipped is null"), transcribe, "raw").select("digest", "raw").dropDuplicates(["digest"])
    rows = rows.join(asked, "digest", "left").withColumn("skipped", F.coalesce("skipped", gist_reason(F.col("raw"), F.col("category"))))
    quoted = F.when(F.col("category") == "diagram", T.blockquote(F.col("raw"))).otherwise(F.col("raw"))
    return rows.withColumn("md", F.when(F.col("skipped").isNull(), quoted)).drop("answer", "raw", "unreadable")


def page_text(interpreted: Column, transcription: Column, raw: Column) -> Column:
    """What a complex page shows: the interpretation, else the transcription without its heading, else its raw text in a details block."""
    return F.coalesce(interpreted, T.without_heading(transcription), T.details(F.lit("Raw extracted text"), raw))


def asset_names(images: DataFrame) -> DataFrame:
    """``images`` (document_id, page, n, digest, ext) with placement, asset and the file name ``<stem>_<NN>_<digest>.<ext>`` of the content's first place."""
    placed = D.image_placement(images)
    first = Window.partitionBy("document_id", "digest").orderBy("page", "n")
    ext = F.first(F.coalesce(F.nullif(F.regexp_replace("ext", r"^\.+", ""), F.lit("")), F.lit("bin"))).over(first)
    named = images.withColumn("ext", ext).select("document_id", "page", "n", "stem", "ext").join(placed, ["document_id", "page", "n"])
    return named.withColumn("filename", F.format_string("%s_%02d_%s.%s", "stem", "asset", "digest", "ext"))


def pages_of(images: DataFrame) -> DataFrame:
    """The set of pages of each content, and of each page the set of contents."""
    return images.groupBy("document_id", "digest").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def contents_of(images: DataFrame) -> DataFrame:
    return images.groupBy("document_id", "page").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
