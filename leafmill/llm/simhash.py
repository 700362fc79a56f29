"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in at most 2 bits differ in at most 1 bit in one of their halves. The anchors of a half are
the words of the perfect Hamming code of 31 bits (covering radius 1; a half's highest bit is left out of it). Every
fingerprint is replicated to all anchors within radius 1 + 1 of its halves: one anchor if it is a code word itself, else the
nearest and 15 others. Two halves that differ in at most one bit share the nearest anchor of either, so comparing all
fingerprints of an anchor with those for which it is the nearest finds every pair.

Equal fingerprints are one, so groups of copies don't multiply. Links are joined to components by rounds of large-star and
small-star steps over staged tables; nothing is gathered on the driver.

Null text counts as empty, whose fingerprint is zero. A component's name is its smallest doc_id; null doc_ids name none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED, WIDTH, THRESHOLD = 42, 3, 2


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``width`` words in a row, repeats included; of the whole sequence if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH) -> DataFrame:
    """``keep`` columns and fingerprint (long, the 64 bits). Map-only."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], common.text_bytes(text).alias("text"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "fingerprint long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py() or b"", width)) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*names, "fingerprint"])

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def _syndrome(half: Column) -> Column:
    """The five parity checks of a 31-bit word: the exclusive or of the places (from 1) of its set bits."""
    total = F.lit(0).cast("long")
    for check in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> check & 1)
        total = total + (F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2).cast("long") * (1 << check)
    return total


def anchors(prints: DataFrame, column: str = "fingerprint", keep: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """A row for each half and anchor within radius 2: ``keep`` columns, half, anchor, nearest (within the covering radius)."""
    halves = prints.select(*keep, F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col(column).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("word")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("word")),
    )).alias("h")).select(*keep, "h.*").withColumn("s", _syndrome(F.col("word")))
    # flipping places i and j clears the syndrome s if i xor j = s
    near = F.expr("transform(filter(sequence(1, 31), i -> s > 0 and (i ^ s) > i and (i ^ s) < 32), i -> struct(word ^ shiftleft(1L, i - 1) ^ shiftleft(1L, cast((i ^ s) - 1 as int)) as anchor, false as nearest))")
    first = F.expr("array(struct(if(s = 0, word, word ^ shiftleft(1L, cast(s - 1 as int))) as anchor, true as nearest))")
    return halves.select(*keep, "half", F.explode(F.concat(first, near)).alias("a")).select(*keep, "half", "a.anchor", "a.nearest")


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs a < b of different fingerprints (column fingerprint, distinct) that differ in at most ``threshold`` (2 at most) bits."""
    at = anchors(prints)
    home = at.where("nearest").select("half", "anchor", F.col("fingerprint").alias("x"))
    other = at.select("half", "anchor", F.col("fingerprint").alias("y"))
    close = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold)
    found = home.join(other, ["half", "anchor"]).where(close)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one batch reduced to stars: each node with the smallest node that the batch ties it to."""
    for batch in batches:
        nodes, place = np.unique(np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        u, v = place[: batch.num_rows], place[batch.num_rows :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            after = root.copy()
            for side in (root[u], root[v], u, v):
                np.minimum.at(after, side, low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        tied = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[tied]]), pa.array(nodes[tied])], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60, part: int = 200_000, few: int = 20_000_000) -> DataFrame:
    """node, root (its component's smallest node) for all nodes of edges (a, b), by alternating star steps.

    Up to ``few`` edges are dealt to a task for each ``part`` of them, whatever the session's number of shuffle partitions;
    more are left to the session and its splitting of skewed joins. The result is the same."""
    edges = common.stage(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long"), "edges")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    before = sign(edges)
    parts = -(-before[0] // part) or 1
    deal = (lambda df, key: df.repartition(parts, key)) if before[0] <= few else (lambda df, key: df)
    for _ in range(rounds):
        both = deal(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: a node and its smaller neighbours are tied to the smallest of them
        small = deal(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "u").distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        after = small.join(low, "u").select(F.col("m").alias("a"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"))
        after = common.stage(deal(after, "b").distinct(), "edges")
        common.drop_stage(edges)
        edges, now = after, sign(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, fingerprint (long) and component_id (smallest doc_id that links reach)."""
    prints = common.stage(fingerprints(docs, text, keep), "prints")
    classes = common.stage(prints.groupBy("fingerprint").agg(F.min(keep[0]).alias("least")), "classes")
    roots = components(links(classes.select("fingerprint")))
    named = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(names, "root").select(F.col("fingerprint").alias("f"), "component_id")
    return prints.join(of, F.col("fingerprint") == F.col("f")).drop("f")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
