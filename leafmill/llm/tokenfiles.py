"""Token-id files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

Texts are dealt by ranges of doc_id and sorted (one shuffle), encoded to ids, and staged with each task's counts of
ids. The counts of all tasks give one code. Each range becomes one file of blocks. A block holds whole documents:

    magic "LMTK" | n documents u32 | n ids u32 | n checkpoints u32 | payload bytes u32
    doc_ids i64 each (null: the smallest) | lengths u32 each | bit offset of every ``STEP``-th id u32 each | payload

Words of a code stand with their highest bit first. The code itself is the file ``code``: one length byte for
each id, 0 for ids that never occur; canonical words follow from the lengths. File names, in order of part and first
row, hold ascending doc_ids. A block is decoded by
table look-ups of ``MAX_BITS`` bits, all its checkpoints side by side.

Files are written by tasks to a name of the attempt and renamed, so a retried task replaces its own file. Null texts
count as empty; null doc_ids come last; rows with equal doc_id are ordered by the hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAX_BITS, STEP, BLOCK_IDS = 20, 64, 1 << 18
MAGIC = b"LMTK"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits (package-merge); 0 where the count is 0."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    assert len(symbols) <= 1 << most
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # rows: for each level the sorted list of coins (>= 0) and packages (-1)
    packages, kinds = np.empty(0), []
    for _ in range(most):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        kinds.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (n - 1)
    out = np.zeros(n, np.int64)
    for coins in reversed(kinds):  # of the cheapest entries of a level, its coins lengthen their symbols
        used = int(coins[:take].sum())
        out[:used] += 1
        take = 2 * (take - used)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, id)."""
    words, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == bits)
        code <<= bits - before
        words[own] = code + np.arange(len(own))
        code, before = code + len(own), bits
    return words


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> bytes:
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begin = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    # each word is shifted to its place in a 64-bit window that begins at its first byte; bytes of words don't overlap in bits
    first = begin >> 3
    window = words[ids].astype(np.uint64) << (64 - bits - (begin & 7)).astype(np.uint64)
    out = np.zeros((total + 7) // 8 + 8, np.uint8)
    for k in range((MAX_BITS + 14) // 8):
        part = (window >> np.uint64(56 - 8 * k)).astype(np.uint8)
        if len(ids):
            at = first + k
            edges = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[edges]] |= np.bitwise_or.reduceat(part, edges)
    payload = out[: (total + 7) // 8].tobytes()
    checkpoints = begin[::STEP].astype("<u4")
    head = np.array([len(doc_lengths), len(ids), len(checkpoints), len(payload)], "<u4")
    return MAGIC + head.tobytes() + doc_ids.astype("<i8").tobytes() + doc_lengths.astype("<u4").tobytes() + checkpoints.tobytes() + payload


class Decoder:
    def __init__(self, lengths: np.ndarray):
        words = canonical(lengths)
        self.bits = int(lengths.max(initial=1))
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (self.bits - lengths[used].astype(np.int64))).astype(np.int64)
        total = int(spans.sum())
        self.symbol[:total], self.length[:total] = np.repeat(used, spans), np.repeat(lengths[used], spans)
        assert not len(used) or int(words[used[0]]) == 0

    def block(self, raw: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids, doc_ids, document lengths, and where the next block begins."""
        if raw[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, n, marks, size = (int(x) for x in np.frombuffer(raw, "<u4", 4, at + 4))
        at += 20
        doc_ids = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        doc_lengths = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        place = np.frombuffer(raw, "<u4", marks, at + 4 * docs).astype(np.int64)
        at += 4 * docs + 4 * marks
        data = np.zeros(size + 8, np.uint8)
        data[:size] = np.frombuffer(raw, np.uint8, size, at)
        # four bytes from each byte on, so that a look-up needs one gather
        wide = np.zeros(size + 4, np.uint32)
        for k in range(4):
            wide |= data[k : k + size + 4].astype(np.uint32) << np.uint32(24 - 8 * k)
        out = np.empty((STEP, marks), np.uint32)
        mask, shift = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for k in range(STEP):
            look = (wide[np.minimum(place >> 3, size)] >> (shift - (place & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[look]
            place = place + self.length[look]
        return out.T.reshape(-1)[:n], doc_ids, doc_lengths, at + size


def _filesystem(path: str):
    """Where the shared folder is a mounted path, tasks write to it; other stores go through pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


NULL_ID = -(1 << 63)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the files into ``path``; one row for each file: part, first_row, name, n_docs, n_ids, n_bytes."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "row", "doc_id", "ids", "tally"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, row = TaskContext.get().partitionId(), tokens.tokenizer(vocabulary), 0
        seen = np.zeros(own.vocab, np.int64)
        for batch in batches:
            for begin, stop in common.groups_of(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                ids, counts = own.encode(batch.column(1).slice(begin, stop - begin))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                seen = np.add(seen, np.bincount(ids, minlength=len(seen))) if int(ids.max()) < len(seen) else np.bincount(ids, minlength=len(seen)) + np.pad(seen, (0, int(ids.max()) + 1 - len(seen)))
                ids = ids.astype("<u2" if own.vocab <= 1 << 16 else "<u4")
                cells = [ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                m = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(range(row, row + m), pa.int64()), batch.column(0).slice(begin, m), pa.array(cells, pa.binary()), pa.nulls(m, pa.binary())], names)
                row += m
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)
        common.release()

    staged = common.stage(ordered.mapInArrow(encode, "part int, row long, doc_id long, ids binary, tally binary"), "ids", "zstd")

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                one = np.frombuffer(cell, "<i8")
                long, short = (one, total) if len(one) > len(total) else (total, one)
                total = long + np.pad(short, (0, len(long) - len(short)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # as many rows as the vocabulary has ids
    rows = staged.where("row = -1").select("tally").mapInArrow(tallies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    counts[[r.id for r in rows]] = [r.n for r in rows]
    lengths = code_lengths(counts)
    words = canonical(lengths)
    narrow = "<u2" if tokens.tokenizer(vocabulary).vocab <= 1 << 16 else "<u4"
    files, base = _filesystem(path)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/code") as out:
        out.write(lengths.tobytes())
    made = ["part", "first_row", "name", "n_docs", "n_ids", "n_bytes"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each run of consecutive rows of a part: scans may split what one task has staged."""
        tokens.release()
        files, base = _filesystem(path)
        stream, part, first, row, at = None, -1, 0, 0, ""
        docs = n_ids = n_bytes = size = 0
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            nonlocal held, size, n_bytes
            if held:
                raw = encode_block(np.concatenate([x for _, x in held]), np.array([d for d, _ in held]), np.array([len(x) for _, x in held]), lengths, words)
                stream.write(raw)
                n_bytes += len(raw)
                held, size = [], 0

        def close() -> pa.RecordBatch:
            flush()
            stream.close()
            files.move(at, f"{base}/{(name := f'part-{part:06d}-{first:012d}.lmtk')}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([n_bytes], pa.int64())], made)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 500):
                    yield from zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns), strict=True)

        for p, r, d, cell in rows():
            if stream is None or p != part or r != row:
                if stream is not None:
                    yield close()
                part, first, docs, n_ids, n_bytes = p, r, 0, 0, 0
                at = f"{base}/_{p}-{r}.{TaskContext.get().taskAttemptId()}"
                stream = files.open_output_stream(at)
            one = np.frombuffer(cell, narrow)
            held.append((NULL_ID if d is None else d, one))
            row, docs, n_ids, size = r + 1, docs + 1, n_ids + len(one), size + len(one)
            if size >= BLOCK_IDS:
                flush()
        if stream is not None:
            yield close()
        common.release()

    blocks = staged.where("row >= 0").select("part", "row", "doc_id", "ids")
    out = common.stage(blocks.mapInArrow(put, "part int, first_row long, name string, n_docs long, n_ids long, n_bytes long"), "files")
    common.drop_stage(staged)
    return out


def read(files: DataFrame, path: str) -> DataFrame:
    """Decode the files that ``write`` listed: doc_id, start (ids before it in all files), n_tokens, ids (little-endian 32-bit)."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # a row for each range: as many as the first step had tasks
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("first_row")) - F.col("n_ids")
    listed = files.withColumn("own", own).join(before, "part").select("name", (F.col("own") + F.col("before")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        files, base = _filesystem(path)
        decoder = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if decoder is None:
                    with files.open_input_stream(f"{base}/code") as source:
                        decoder = Decoder(np.frombuffer(source.read(), np.uint8))
                with files.open_input_stream(f"{base}/{name}") as source:
                    while head := source.read(20):
                        docs, _, marks, size = (int(x) for x in np.frombuffer(head, "<u4", 4, 4))
                        ids, doc_ids, counts, _ = decoder.block(head + source.read(12 * docs + 4 * marks + size))
                        ends = np.cumsum(counts)
                        raw = ids.astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + ends - counts), pa.array(counts), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        start += len(ids)

    spread = max(1, files.sparkSession.sparkContext.defaultParallelism * 2)
    return listed.repartition(spread, "name").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    path = common.new_path(docs.sparkSession, "tokens")
    return read(write(docs, path, vocabulary, end_id), path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
