"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens is taken to cost ``linear * n + quadratic * n * n`` (attention is quadratic in a piece). Documents
are cut into full sequences and a rest. Rests go, longest first, to the sequence of lowest cost so far that
still has room; one that fits nowhere is cut to fill the roomiest sequences. This happens in blocks of consecutive
documents of a partition, each with as many sequences as its tokens need, so that at most one sequence of a block isn't
full: no shuffle, memory for one block and one text, and nothing depends on other partitions. A retried task gives the same rows.

Null and empty texts consist of the closing id alone. Repeated rows are packed each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


def balance(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset there) of items shorter than ``capacity``."""
    total = sum(lengths)
    n = -(-total // capacity)
    # the last sequence has only what is left, so that the others fill up
    room = np.full(n, capacity, np.int64)
    if n:
        room[-1] = total - capacity * (n - 1)
    at, cost, pieces = np.zeros(n, np.int64), np.zeros(n), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            j = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            take = min(left, int(room[j]))
            pieces.append((item, start, take, j, int(at[j])))
            at[j] += take
            room[j] -= take
            cost[j] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return pieces


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, block: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",), linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row for each piece: ``keep`` columns, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"])
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def pieces(keys: list[pa.RecordBatch], ids: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        out, count = [], 0
        for row, own in enumerate(ids):
            for i in range(len(own) // width):
                out.append((row, i * capacity, capacity, base + count, 0))
                count += 1
        rest = [len(own) % width // 4 for own in ids]
        for row, start, length, sequence, offset in balance(rest, capacity, linear, quadratic):
            out.append((row, len(ids[row]) // 4 - rest[row] + start, length, base + count + sequence, offset))
        made = base + count + -(-sum(rest) // capacity)
        cols = list(zip(*out, strict=True))
        take = pa.array(cols[0], pa.int64())
        table = pa.Table.from_batches(keys).combine_chunks().take(take)
        arrays = [*(c.combine_chunks() for c in table.columns), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([ids[r][4 * s : 4 * (s + n)] for r, s, n, *_ in out], pa.binary()), pa.array([len(ids[r]) // 4 for r in cols[0]], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
        return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], [*names, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokens.tokenizer(vocabulary).encode, TaskContext.get().partitionId() << 40
        keys, ids, size = [], [], 0
        for batch in batches:
            texts = batch.column(len(names))
            for begin, stop in common.groups_of([n or 0 for n in pc.binary_length(texts).to_pylist()], 4_000_000):
                keys.append(batch.slice(begin, stop - begin).select(names))
                flat, counts = encode(texts.slice(begin, stop - begin))
                ends = np.cumsum(counts)
                ids += [flat[e - n : e].tobytes() + end for e, n in zip(ends, counts, strict=True)]
                size += 4 * len(flat)
                if len(ids) >= block or size >= 8_000_000:
                    out, base = pieces(keys, ids, base)
                    yield out
                    keys, ids, size = [], [], 0
        if ids:
            yield pieces(keys, ids, base)[0]
        common.release()

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def padding(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Tokens and padding of each sequence: filled up to ``capacity`` unless its length is a power of two."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return own.withColumn("padding", F.when(F.expr("tokens & (tokens - 1)") == 0, F.lit(0)).otherwise(capacity - F.col("tokens")).cast("long"))


def digest(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    return pack(docs, vocabulary, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
