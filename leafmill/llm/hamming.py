"""Exact top-k search over binary codes by incremental multi-index hashing.

The distinct codes are dealt by hash into slices of at most about ``SLICE``, the distinct queries into blocks, and a task searches one
slice for one block. Codes of 64 bits are cut into m segments of about log2(n) bits for the n of a slice, each an index: codes in order of
the segment's value, with the place where each value begins. Step (r, s) probes, for every query not yet settled, all values of segment s
at distance exactly r from its own. After it every code within m * r + s bits has met the query in some segment, so a query is settled
once its k-th verified distance is within that. Steps go on until all queries are settled, at the latest when all values have been
probed. Where a ring has more values than the segment, only the values that there are get probed. Of each slice the k + 1 nearest codes
of a query go on; the nearest of all slices are the result.

Equal codes are one entry of an index, equal queries one query; a code keeps its k + 1 smallest ids, which is all that k
nearest rows other than the query itself can need. Ties go to the smaller id. Null or empty vectors have no code and are
left out. With fewer than k other rows all of them are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Codes of a slice, queries of a block (128 at least where tasks would be idle otherwise), probes or codes that are looked at at once.
SLICE, BLOCK, LEAST, WORK = 1 << 21, 1 << 15, 128, 1 << 19


def sign_code(vector: str) -> Column:
    """Bit i is set if component i is above 0, over the first 64 components."""
    return F.expr(f"aggregate(sequence(0, least(size({vector}), {BITS}) - 1), 0L, (x, i) -> if({vector}[i] > 0, x | shiftleft(1L, i), x))")


def _segments(n: int) -> list[tuple[int, int]]:
    m = max(1, round(BITS / max(4, min(32, math.log2(max(n, 2))))))
    edges = [i * BITS // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@cache
def _ring(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits of which ``radius`` are set."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << bits, dtype=np.uint32)) == radius).astype(np.uint32)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first, first + 1, ... of each range, and the range each belongs to."""
    own = np.repeat(np.arange(len(count)), count)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(own)), own


class Index:
    """Multi-index of a slice's codes, which stand in order of their smallest id; ``held`` is the number of ids of each."""

    def __init__(self, codes: np.ndarray, held: np.ndarray):
        self.codes, self.held, self.segments = codes, held, []
        for at, n in _segments(len(codes)):
            value = self.value(codes, at, n)
            order = np.argsort(value, kind="stable").astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << n))]).astype(np.int32)
            self.segments.append((at, n, order, codes[order], starts, np.flatnonzero(np.diff(starts)).astype(np.uint32)))
        self.masks = [np.uint64(((1 << n) - 1) << at) for at, n, *_ in self.segments]

    @staticmethod
    def value(codes: np.ndarray, at: int, n: int) -> np.ndarray:
        return (codes >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query (its place), code (its place), distance: of each query the k + 1 nearest codes, or as many as hold the k + 1 nearest ids; ties by place."""
        own = np.zeros((len(queries), BITS + 1), np.int64)  # ids held by distance
        bound = np.full(len(queries), BITS)  # the distance within which more than k ids are known
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        fresh: list[tuple[np.ndarray, ...]] = []

        def cut() -> tuple[np.ndarray, ...]:
            q, code, d = (np.concatenate(x) for x in zip(best, *fresh, strict=True))
            near = d <= bound[q]
            q, code, d = q[near], code[near], d[near]
            by = np.lexsort((code, d, q))
            q, code, d = q[by], code[by], d[by]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            return q[nth <= k], code[nth <= k], d[nth <= k]

        open_ = np.arange(len(queries))
        for r in range(max(n for _, n, *_ in self.segments) + 1):
            for s, (at, n, order, codes, starts, values) in enumerate(self.segments):
                ring = math.comb(n, r)
                wide = min(ring, len(values))  # probes of a query at most
                for begin in range(0, len(open_) if wide else 0, step := max(1, WORK // max(1, wide))):
                    some = open_[begin : begin + step]
                    value = self.value(queries[some], at, n)
                    if ring <= len(values):
                        probes = value[:, None] ^ _ring(n, r)[None, :]
                        first = starts[probes]
                        count = starts[probes + np.uint32(1)] - first
                        row, column = np.nonzero(count)
                        first, count = first[row, column], count[row, column]
                    else:
                        row, column = np.nonzero(np.bitwise_count(value[:, None] ^ values[None, :]) == r)
                        first = starts[values[column]]
                        count = starts[values[column] + np.uint32(1)] - first
                    for a, b in common.groups_of(count.tolist(), WORK) if count.sum() > WORK else [(0, len(count))]:
                        place, probe = _spread(first[a:b].astype(np.int64), count[a:b])
                        q = some[row[a:b]][probe]
                        x = codes[place] ^ queries[q]
                        d = np.bitwise_count(x).astype(np.int64)
                        near = np.flatnonzero(d <= bound[q])
                        x = x[near]
                        new = np.ones(len(x), bool)  # not met in an earlier step
                        for other, mask in enumerate(self.masks):
                            if other != s:
                                new &= np.bitwise_count(x & mask) >= r + (other < s)
                        near = near[new]
                        if not len(near):
                            continue
                        q, code, d = q[near], order[place[near]].astype(np.int64), d[near]
                        np.add.at(own, (q, d), self.held[code])
                        met = np.unique(q)
                        enough = np.cumsum(own[met], axis=1) > k
                        bound[met] = np.where(enough.any(axis=1), enough.argmax(axis=1), BITS)
                        fresh.append((q, code, d))
                        if sum(len(f[0]) for f in fresh) > 4 * WORK:
                            best, fresh = cut(), []
                open_ = open_[bound[open_] > len(self.segments) * r + s]
                if not len(open_):
                    return cut()
        return cut()


def _packed(rows: DataFrame, by: str, columns: dict[str, str], n: int, first: str | None = None) -> DataFrame:
    """One row for each value of ``by``: its rows' columns as binary, in order of ``first``."""
    names = [by, *columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([b"".join(p)], pa.binary()) for p in zip(*parts, strict=True))], names)

        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                if at is not None and at != key[a]:
                    yield out()
                    parts = []
                at = int(key[a])
                parts.append([c.to_numpy()[a:b].astype(t).tobytes() for c, t in zip(batch.columns[1:], columns.values(), strict=True)])
        if at is not None:
            yield out()

    dealt = rows.repartition(n, by).sortWithinPartitions(by, *[first] * bool(first)).select(*names)
    return common.stage(dealt.mapInArrow(pack, ", ".join([f"{by} int", *(f"{c} binary" for c in columns)])), by)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, neighbor_id, distance, rank (from 1): the k nearest rows other than the query. Inputs: id, code."""
    rows, queries = rows.where("code is not null"), queries.where("code is not null")
    by_code = Window.partitionBy("code").orderBy("id")
    few = common.stage(rows.withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= k + 1).select("code", "id"), "ids")
    codes = common.stage(few.groupBy("code").agg(F.count("*").alias("held"), F.min("id").alias("first")), "codes")
    asked = common.stage(queries.select(F.col("code").alias("q")).distinct(), "asked")
    slices, n = max(1, math.ceil(codes.count() / SLICE)), asked.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / BLOCK), min(math.ceil(2 * cores / slices), math.ceil(n / LEAST)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    index = _packed(codes.withColumn("slice", dealt("code", slices)), "slice", {"code": "<i8", "held": "<i4"}, slices, "first")
    asking = _packed(asked.withColumn("block", dealt("q", blocks)), "block", {"q": "<i8"}, blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, held, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, wanted = np.frombuffer(code, "<u8"), np.frombuffer(q, "<u8")
                slice_ = Index(own, np.frombuffer(held, "<i4"))
                for a in range(0, len(wanted), 1024):
                    at, found, d = slice_.nearest(wanted[a : a + 1024], k)
                    yield pa.RecordBatch.from_arrays([pa.array(wanted[a + at].view(np.int64)), pa.array(own[found].view(np.int64)), pa.array(d, pa.int32())], ["q", "code", "distance"])
        common.release()

    # a task for each pair of a slice and a block
    tasks = index.crossJoin(asking).repartitionById(slices * blocks, F.col("slice") * blocks + F.col("block"))
    best = common.stage(tasks.select("code", "held", "q").mapInArrow(meet, "q long, code long, distance int"), "best")
    common.drop_stage(index)
    near = best.join(few.select("code", F.col("id").alias("neighbor_id")), "code")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    found = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(near, "q").where(F.col("query_id") != F.col("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


def digest(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Every row whose id is divisible by 20 asks all rows."""
    rows = embeddings.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return search(rows, rows.where("id % 20 = 0"), k)


SQL = """
with codes as (
  select vec_id as id, list_sum(list_transform(range(0, 64), lambda i: case when embedding[i + 1] > 0 then (1::hugeint << i) else 0::hugeint end))::hugeint as code
  from embeddings
), pairs as (
  select q.id as query_id, r.id as neighbor_id, bit_count(xor(q.code, r.code))::int as distance
  from codes q join codes r on q.id <> r.id where q.id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by distance, neighbor_id)::int as rank from pairs
)
select query_id, neighbor_id, distance, rank from ranked where rank <= 10
"""
