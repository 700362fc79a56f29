"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; the hash's high bits choose one of ``BINS`` bins, which keeps its smallest
hash. An empty bin takes the value of a filled one, found by a sequence of universal hashes of bin and attempt that is
the same for all texts (optimal densification). Of each bin ``BITS`` low-order bits of the mixed value are packed.
Likeness is the share of equal bins, corrected for values that agree by chance.

Words are lower-cased (ASCII) and end at ASCII white space; a text of fewer than five words is one shingle. Null and empty
texts, and texts of white space only, have the empty fingerprint; two of them are alike (1), one and another text aren't (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import hashed, shingles

BINS, BITS, WORDS = 512, 4, 5
#: Bytes of texts that are taken apart at once.
GROUP = 500_000


def _donors(attempts: int = 64) -> np.ndarray:
    """For each attempt and bin the bin that is asked for its value."""
    i = np.arange(attempts * BINS, dtype=np.uint64)
    return (common.mix64(i + np.uint64(0x5DEECE66D)) % np.uint64(BINS)).astype(np.int64).reshape(attempts, BINS)


_DONORS = _donors()


def fingerprint(hashes: np.ndarray) -> bytes:
    """Packed bins of the shingle hashes; empty for none."""
    if not len(hashes):
        return b""
    h = np.sort(common.mix64(hashes))
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    value, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], filled[bins[first]] = h[first], True
    empty, was = np.flatnonzero(~filled), filled.copy()
    for donors in _DONORS:
        if not len(empty):
            break
        found = was[donors[empty]]
        value[empty[found]] = value[donors[empty[found]]]
        empty = empty[~found]
    for b in empty:  # after all attempts: the next filled bin
        value[b] = value[np.flatnonzero(was)[np.searchsorted(np.flatnonzero(was), b) % was.sum()]]
    low = (common.mix64(value) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(-1, 8 // BITS)
    return (low << (np.arange(8 // BITS, dtype=np.uint8) * BITS)).sum(axis=1).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two texts' shingles, from equal bins less the chance of 2**-BITS."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = sum(int(((x >> np.uint8(BITS * k)) & np.uint8((1 << BITS) - 1) == 0).sum()) for k in range(8 // BITS)) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def of_texts(texts: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    for begin, stop in common.groups_of([len(t) for t in texts], GROUP):
        h, offsets = hashed(texts[begin:stop], signs=True)
        out += [fingerprint(shingles(h[a:b], WORDS)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the fingerprint (binary) of each row. Map-only."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], common.text_bytes(text).alias("text"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "fingerprint binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(of_texts(common.values(batch.column(len(names)))), pa.binary())], [*names, "fingerprint"])
            common.release()

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ids: list, texts: list[str], following: list[str]) -> list[list]:
    changed = [edited(t, n).encode() for t, n in zip(texts, following, strict=True)]
    prints = of_texts([t.encode() for t in [*texts, following[-1]]]) if texts else []
    after = of_texts(changed)
    return [ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], prints[:-1], after, [likeness(a, b) for a, b in zip(prints, after, strict=False)], [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, in descending order of doc_id (null last; equal
    ids by the hash of the text). One shuffle by ranges: only the last text of each range waits for the next range's first."""
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "edge", "text", *_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_id, held = TaskContext.get().partitionId(), None, None
        plain = lambda cols, n: pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        edge = lambda kind, i, t: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind]), pa.array([t]), pa.array([i], pa.int64()), *(pa.nulls(1, t) for t in types[1:])], names)
        for batch in batches:
            for begin, stop in common.groups_of(pc.binary_length(batch.column(1)).to_pylist(), GROUP):
                ids, texts = batch.column(0).slice(begin, stop - begin).to_pylist(), batch.column(1).slice(begin, stop - begin).to_pylist()
                if held is None:
                    yield edge("first", ids[0], texts[0])
                else:
                    ids, texts = [held_id, *ids], [held, *texts]
                if len(ids) > 1:
                    yield plain(_compared(ids[:-1], texts[:-1], texts[1:]), len(ids) - 1)
                held_id, held = ids[-1], texts[-1]
            common.release()
        if held is not None:
            yield edge("last", held_id, held)

    staged = common.stage(rows.mapInArrow(run, f"part int, edge string, text string, {_ROW}"), "fingerprints")
    # two rows for each range
    ends = staged.where("edge is not null").groupBy("part").agg(*[F.max(F.when(F.col("edge") == e, F.col(c))).alias(f"{e}_{c}") for e in ("first", "last") for c in ("text", "doc_id")])
    around = Window.orderBy("part")
    ends = ends.select("last_doc_id", "last_text", F.coalesce(F.lead("first_text").over(around), F.first("first_text").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cols = _compared([i], [t], [n])
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()], strict=True)], _NAMES)

    return staged.where("edge is null").select(*_NAMES).unionByName(ends.mapInArrow(close, _ROW))


def digest(docs: DataFrame) -> DataFrame:
    found = compare_with_next(docs)
    return found.select("doc_id", "n_chars", "edited_sha256", *[F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")
