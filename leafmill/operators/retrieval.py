"""Nearest chunks by distance, speakers by time, media files by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Audio suffixes in order of preference (fixed values).
AUDIO = ("wav", "m4a", "mp3", "aac", "flac", "ogg", "aiff", "aif", "m4b", "mp4", "mov", "webm", "wma")
#: Rows of a slice, vectors that meet a slice at once, and components whose squares a sum can hold.
SLICE, ROWS, PLAIN = 4096, 256, 1e140


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and the components of the vectors that have no null."""
    lists = pc.if_else(pc.is_valid(column), column, None).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(lists), pa.float64())
    values, nulls = flat.to_numpy(zero_copy_only=False), pc.is_null(flat).to_numpy(zero_copy_only=False)
    begins, out = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        own = np.flatnonzero(sizes == n)
        inside = begins[own][:, None] + np.arange(n)
        whole = ~nulls[inside].any(axis=1)
        out[n] = own[whole], values[inside][whole]
    return out


def _near(vectors: np.ndarray, others: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of vectors, and of the k others nearest to each, by distance and name, with the distances.

    Products of matrices only sift: what may be among the nearest is measured in order of the components. Vectors that products can't measure are sifted by nothing.
    """
    plain = lambda a: (np.abs(a) < PLAIN).all(axis=1)
    easy, columns = plain(others), np.ascontiguousarray(others.T)
    bare = np.where(easy[:, None], others, 0.0)
    squares = (bare * bare).sum(axis=1)
    for begin in range(0, len(vectors), ROWS):
        some = vectors[begin : begin + ROWS]
        known = plain(some)
        used = np.where(known[:, None], some, 0.0)
        own = (used * used).sum(axis=1)
        rough = own[:, None] + squares - 2 * (used @ bare.T)
        rough[:, ~easy] = np.inf
        last = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(others) > k else np.full(len(some), np.inf)
        # more than the products are off by, and than squares of one root are apart
        last = np.where(known, last + 1e-9 * (own + squares.max(initial=0.0)) + 1e-290, np.inf)
        row, at = np.nonzero((rough <= last[:, None]) | ~easy)
        square = np.zeros(len(row))
        with np.errstate(invalid="ignore", over="ignore"):
            for x, y in zip(np.ascontiguousarray(some.T), columns, strict=True):
                off = x[row] - y[at]
                square += off * off
        distance = np.sqrt(square)
        by = np.lexsort((names[at], distance, row))
        row, at, distance = row[by], at[by], distance[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield begin + row[kept], at[kept], distance[kept]


def nearest_chunks(chunks: DataFrame, queries: DataFrame, k: int, most: int = SLICE) -> DataFrame:
    """The k chunks of a query's document nearest by Euclidean distance. Inputs: chunk_id, document_id, embedding; query_id, document_id, vector.
    A document's chunks and queries are dealt over slices of about ``most`` rows, however many it has. Each slice of chunks meets each of queries as matrices, and the k
    nearest of all meetings are merged. Equal distances go by chunk_id; NaN comes behind numbers, and a distance that a null or unlike lengths leave open last."""
    slices = lambda rows, name: rows.groupBy("document_id").agg(F.ceil(F.count("*") / most).alias(name))
    dealt = lambda id, n: F.pmod(F.xxhash64(id), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    parts = slices(chunks, "of").join(slices(queries, "asked"), "document_id")
    key, own = ["document_id", "slice", "block"], F.col("document_id").alias("document_id")
    held = chunks.join(parts, "document_id").select(own, dealt("chunk_id", "of").alias("slice"), every("asked").alias("block"), "chunk_id", "embedding")
    asked = queries.join(parts, "document_id").select(own, every("of").alias("slice"), dealt("query_id", "asked").alias("block"), "query_id", "vector")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, found = _matrices(left.column("vector")), _matrices(right.column("embedding"))
        names = np.empty(right.num_rows, np.int64)
        by_name = pc.sort_indices(right.column("chunk_id"), null_placement="at_start").to_numpy().astype(np.int64)
        names[by_name] = np.arange(right.num_rows)
        out = []
        for n, (places, vectors) in wanted.items():
            at, others = found.get(n, (np.empty(0, np.int64), np.empty((0, n))))
            if len(at):
                out += [(places[i], at[j], distance) for i, j, distance in _near(vectors, others, names[at], k)]
            out.append(_open(places, by_name[~np.isin(by_name, at)][:k]))
        out.append(_open(np.setdiff1d(np.arange(left.num_rows), np.concatenate([p for p, _ in wanted.values()] or [np.empty(0, np.int64)])), by_name[:k]))
        row, at, distance = (np.concatenate(c) for c in zip(*out, strict=True))
        columns = [left.column("query_id").take(pa.array(row)), right.column("chunk_id").take(pa.array(at)), pa.array(distance, mask=distance < 0)]
        return pa.table(columns, ["query_id", "chunk_id", "distance"])

    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for rows, c in ((queries, "query_id"), (chunks, "chunk_id"))]
    near = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, ", ".join([*types, "distance double"]))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")


def _open(queries: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of these, with -1 for a distance that isn't known."""
    return np.repeat(queries, len(chunks)), np.tile(chunks, len(queries)), np.full(len(queries) * len(chunks), -1.0)


def assign_speakers(segments: DataFrame, turns: DataFrame, bucket: float = 60.0) -> DataFrame:
    """The speaker of the first turn (in list order) that holds a segment's midpoint, or null. An equi-join on time buckets
    narrows the interval condition, so it scales with overlaps rather than with all pairs of a source."""
    mid = (F.col("seg_start") + F.col("seg_end")) / 2
    left = segments.withColumn("mid", mid).withColumn("at", F.floor(F.col("mid") / bucket))
    right = turns.where("t_end > t_start").select("conv_id", "turn_ord", "t_start", "t_end", "speaker", F.explode(F.sequence(F.floor(F.col("t_start") / bucket), F.floor(F.col("t_end") / bucket))).alias("at"))
    met = left.join(right, ["conv_id", "at"], "left")
    inside = (F.col("mid") >= F.col("t_start")) & (F.col("mid") < F.col("t_end"))
    return met.groupBy("conv_id", "turn").agg(F.min_by(F.when(inside, F.col("speaker")), F.when(inside, F.col("turn_ord"))).alias("speaker"))


def audio_beside(files: DataFrame) -> DataFrame:
    """For each Markdown file the best audio file of the same folder and stem, if any. Columns: dir, stem, ext."""
    rank = F.array_position(F.array(*map(F.lit, AUDIO)), F.col("ext"))
    audio = files.where(F.col("ext").isin(*AUDIO)).groupBy("dir", "stem").agg(F.min_by("ext", rank).alias("audio"))
    return files.where("ext = 'md'").select("dir", "stem").distinct().join(audio, ["dir", "stem"], "left")
