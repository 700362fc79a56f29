"""Removal of repeated strings by suffix order with threshold-bounded interval expansion.

Every string of ``length`` bytes (a window) that starts at more than one place of all texts is found; matches never
cross texts. Windows are first dealt so that equal windows meet: each has as key the smallest hash of the short strings
in it, and consecutive windows with one key form a run. Runs whose key is met by no other can't repeat and go. The others are compared
as distinct strings, so copies of a run count but don't multiply: they repeat whole. Of the strings of a bucket of keys only stretches
of windows whose rolling hash occurs again stay (equal windows have equal hashes, so none is lost). The distinct stretches
are joined, each with an end mark of its own; from their suffix order comes the
Burrows-Wheeler transform, and common-prefix values are derived by increasing value, extending interval bounds backwards
breadth-first and stopping at ``length``: bounds not reached by then separate suffixes that share a window.

A key met by more than ``HOT`` distinct strings would be too much for one task. Of such strings, too, only stretches of windows whose rolling hash occurs again stay, but that is
found out by a shuffle on the hash: windows are counted where they are, and one of each distinct hash of a slice travels. What stays is mostly the same stretch
again and again (a passage that many texts share); the distinct ones are few and go through the suffix order like all others, so hashes alone decide nothing. One task holds the
distinct stretches of a key. Texts are identified by doc_id and hash of the text; repeated rows are occurrences of
each other and get equal results. Null texts count as empty, and texts shorter than ``length`` have no window. Texts may be of any
length: arrays are held for slices of a few megabytes, or one text. An empty table gives an empty one.
Columns of the input with names that are used here are no harm: names of inner columns are chosen anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the short strings whose hashes are keys; most distinct strings of a key that one task compares; windows of a run.
GRAM, HOT, RUN = 32, 1000, 1024
#: Bytes of strings that are sifted at once; of distinct stretches in one suffix order; of strings dealt to a task.
SIFT, BUCKET, TASK = 500_000, 300_000, 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _powers, _inverse


def _gram_hashes(data: np.ndarray, gram: int, seed: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    powers, inverse = _tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    n = len(data) - gram + 1
    return common.mix64((sums[gram:] - sums[:n]) * inverse[:n] + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - step :]) if step < width else out


def _twice(h: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, wide: int) -> np.ndarray:
    """Whether the smallest hash of a run of windows stands at two places of it."""
    # the smallest hash of a window is the smallest of its own near neighbours on one side at least
    near = min(32, (wide + 1) // 2)
    least = _sliding_min(h, near)
    place = np.ones(len(h), bool)
    place[: len(least)] = h[: len(least)] == least
    place[near - 1 :] |= h[near - 1 :] == least
    place = np.flatnonzero(place)
    value, group = np.unique(h[place], return_inverse=True)
    if len(value) == len(place):
        return np.zeros(len(first), bool)
    # places by (value, place) as one sorted list
    at = np.sort(group.astype(np.int64) * len(h) + place)
    own = np.searchsorted(value, key).astype(np.int64) * len(h) + first
    return np.searchsorted(at, own + count - 1 + wide) - np.searchsorted(at, own) > 1


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows: text, first window, windows, key, hash of the run's bytes, whether its key occurs twice in it."""
    gram = min(GRAM, length)
    wide = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    fit = [i for i, t in enumerate(texts) if len(t) >= length]
    for begin, stop in common.groups_of([len(texts[i]) for i in fit], 250_000):
        own = fit[begin:stop]
        raw = b"".join([texts[i] for i in own])
        sizes = np.array([len(texts[i]) for i in own])
        h = _gram_hashes(np.frombuffer(raw, np.uint8), gram, 0)
        key = _sliding_min(h, wide)
        starts = np.cumsum(sizes) - sizes
        # windows that cross the end of a text are none
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes - length + 1, -1)
        valid = np.cumsum(edge)[: len(key)] > 0
        bound = np.concatenate([[True], (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])])
        bound[starts] = True
        bounds = np.flatnonzero(bound)
        inner = valid[bounds]
        first, count = bounds[inner], np.diff(np.append(bounds, len(key)))[inner]
        if (count > RUN).any():  # long runs in parts
            parts = -(-count // RUN)
            step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            first, count = np.repeat(first, parts) + step * RUN, np.minimum(np.repeat(count, parts) - step * RUN, RUN)
        text = np.searchsorted(starts, first, side="right") - 1
        digest = xxhash.xxh3_64_intdigest
        digests = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)], np.uint64)
        out.append((np.array(own, np.int64)[text], first - starts[text], count, key[first], digests, _twice(h, first, count, key[first], wide)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Order of all suffixes by their first ``length`` signs at least, by doubling; ``text`` ends with a value that occurs once."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    top = int(rank.max())
    while step < 8 and (top + 2) ** 2 < 1 << 62:  # the first signs joined in one number, without a sort
        wide = top + 2
        joined = rank * wide
        joined[: n - step] += rank[step:] + 1
        rank, top, step = joined, wide * wide, step * 2
    order = np.argsort(rank)
    # the rank of a group of equals is the place where it begins
    slots = np.arange(n)
    ranked = rank[order]
    while True:
        begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = slots[np.maximum.accumulate(np.where(begins, np.arange(len(slots)), 0))]
        if step == 1 or len(slots) == n:
            rank = np.empty(n, np.int64)
        rank[order[slots]] = group
        alone = begins & np.append(begins[1:], True)
        slots, group = slots[~alone], group[~alone]
        if not len(slots) or step >= length:
            return order
        own = order[slots]
        follow = own + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        ranked = group * (n + 1) + second
        by = np.argsort(ranked)
        order[slots], ranked = own[by], ranked[by]
        step *= 2


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string a mask of its windows of ``length`` bytes that start elsewhere in the strings, too."""
    marks = len(strings)
    if not marks:
        return []
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(int(ends[-1]) + 1, np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner], text[ends] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + marks, np.arange(marks)
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the Burrows-Wheeler transform
    # a place of the transform and the place of the suffix that is longer by its letter; neighbours of one letter in the transform
    back = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    same = before[back[1:]] == before[back[:-1]]
    following, previous = np.full(n, n), np.full(n, -1)
    following[back[:-1][same]], previous[back[1:][same]] = back[1:][same], back[:-1][same]
    letter = before >= marks
    # unset[i]: suffix i and the one before it are not known to differ yet
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for depth in range(length):
        # intervals of suffixes that share a prefix of ``depth`` signs, extended backwards by each letter that stands before one
        size = high - low + 1
        place = np.repeat(high + 1 - np.cumsum(size), size) + np.arange(int(size.sum()))
        keep = letter[place] if depth else np.ones(n, bool)
        place, own = place[keep], np.repeat(np.arange(len(low)), size)[keep]
        low = np.sort(forward[place[previous[place] < low[own]]])
        high = np.sort(forward[place[following[place] > high[own]]])
        # where the extended prefix ends, suffixes agree in ``depth`` signs; values come in increasing order, so the first one stays
        new = unset[high + 1]
        low, high = low[new], high[new]
        if not len(low):
            break
        unset[high + 1] = False
    shared = np.zeros(n, bool)
    same = np.flatnonzero(unset[:n])  # suffix i and the one before it agree in ``length`` signs
    shared[order[same]] = shared[order[same - 1]] = True
    return [shared[a : a + max(0, s - length + 1)] for a, s in zip(ends - sizes, sizes, strict=True)]


def _valid(sizes: np.ndarray, length: int) -> np.ndarray:
    """Places of windows in texts that stand one behind the other."""
    starts = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes - length + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _again(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Stretches (string, first window, window after the last) of windows whose hash occurs again among the strings; equal windows have equal hashes."""
    raw = b"".join(strings)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    h = _gram_hashes(np.frombuffer(raw, np.uint8), length, 0)
    place = _valid(sizes, length)
    order = np.argsort(h[place], kind="stable")
    ranked = h[place][order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(raw) + 1, bool)
    again[place[order[1:][same]]] = again[place[order[:-1][same]]] = True
    edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0))
    begins, ends = edges[::2], edges[1::2]
    own = np.searchsorted(starts, begins, side="right") - 1
    # stretches end with their string: the windows that cross an end are none
    return list(zip(own.tolist(), (begins - starts[own]).tolist(), (ends - starts[own]).tolist(), strict=True))


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_RUNS = "first int, windows int, key long, run long, twice boolean"
_SPANS = "array<struct<begin:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _as_spans(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"begin": a, "end": b} for a, b in x] for x in lists], _ARROW_SPANS)


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id_"), F.xxhash64(text).alias("th_"), common.text_bytes(text).alias("text_"))


def _strings(docs: DataFrame, wanted: DataFrame, length: int, text: str, doc_id: str) -> DataFrame:
    """The bytes of runs (key, run, id_, th_, first, windows), one text read for all its runs."""
    by = wanted.groupBy("id_", "th_").agg(F.collect_list(F.struct("key", "run", "first", "windows")).alias("runs"))
    named = _named(docs, text, doc_id).where(F.octet_length("text_") >= length).select(F.col("id_").alias("d"), F.col("th_").alias("t"), "text_")
    joined = by.join(named, F.col("id_").eqNullSafe(F.col("d")) & (F.col("th_") == F.col("t"))).select(F.explode("runs").alias("r"), "text_")
    piece = F.expr(f"substring(text_, r.first + 1, r.windows + {length - 1})")
    return joined.select("r.key", "r.run", piece.alias("bytes")).dropDuplicates(["key", "run"])


def _compared(strings: DataFrame, length: int) -> DataFrame:
    """key, run, windows_: the repeated windows of the strings (key, run, n, bytes) of keys of bounded size, by their suffix order."""
    total = strings.agg(F.sum(F.length("bytes"))).first()[0] or 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # strings of whole keys
        # distinct stretches, and the strings (key, run, first window) that hold each
        stretches: dict[bytes, list[tuple[int, int, int]]] = {}
        width = 0

        def sift() -> None:
            nonlocal held, size, width
            raw = [r[3] for r in held]
            for i, begin, end in _again(raw, length):
                piece = raw[i][begin : end + length - 1]
                holders = stretches.setdefault(piece, [])
                width += 0 if holders else len(piece)
                holders.append((held[i][0], held[i][1], begin))
            held, size = [], 0

        def settle() -> pa.RecordBatch:
            nonlocal stretches, width
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for mask, holders in zip(repeated_windows(list(stretches), length), stretches.values(), strict=True):
                if len(holders) > 1:
                    mask[:] = True
                own = _spans(mask)
                for key, run, at in holders:
                    found.setdefault((key, run), []).extend((a + at, b + at) for a, b in own)
            stretches, width = {}, 0
            keys = [k for k, v in found.items() if v]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([r for _, r in keys], pa.int64()), _as_spans([found[k] for k in keys])], ["key", "run", "windows_"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= SIFT and row[0] != held[-1][0]:
                    sift()
                    if width >= BUCKET:
                        yield settle()
                held.append(row)
                size += len(row[3])
        if held:
            sift()
        if stretches:
            yield settle()
        common.release()

    # copies of a run repeat whole; their string still tells which other strings repeat within it
    dealt = strings.select("key", "run", "n", "bytes").repartition(max(1, min(-(-total // TASK), 50_000)), "key").sortWithinPartitions("key", "run")
    return dealt.mapInArrow(compare, f"key long, run long, windows_ {_SPANS}")


#: Bits of the rolling hash that sift windows of hot keys; fewer let more through, with the same result.
MASK = (1 << 64) - 1
#: A window of a hot key on its way: its hash, the string and place it is at, and whether the hash is known to occur again.
_WINDOW = np.dtype([("h", "<u8"), ("key", "<i8"), ("run", "<i8"), ("at", "<i4"), ("known", "?")])


def _met_again(strings: DataFrame, length: int) -> DataFrame:
    """key, run, windows_ of strings of keys that too many distinct strings share: windows whose hash occurs again, in several rows for a string.
    What is met twice within a slice of strings is known there; one window of each hash of a slice goes, packed, to the bucket of its hash,
    so a window that all strings hold meets itself once a slice."""
    mask = np.uint64(MASK)
    total = strings.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total * _WINDOW.itemsize // 8_000_000))
    names = ["bucket", "packed", "key", "run", "windows_"]

    def found(rows: np.ndarray) -> list[pa.Array]:
        """Arrays key, run, windows_ of packed windows."""
        own: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for key, run, at in zip(rows["key"].tolist(), rows["run"].tolist(), rows["at"].tolist(), strict=True):
            spans = own.setdefault((key, run), [])
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((at, at + 1))
        return [pa.array([k for k, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64()), _as_spans(list(own.values()))]

    def same(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of their hash, which of them begin a group, and which are not alone in theirs."""
        rows = rows[np.lexsort((rows["at"], rows["run"], rows["h"]))]
        first = np.ones(len(rows), bool)
        first[1:] = rows["h"][1:] != rows["h"][:-1]
        return rows, first, ~(first & np.append(first[1:], True))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in common.groups_of(pc.binary_length(batch.column(2)).to_pylist(), 1_000_000):
                part = batch.slice(begin, stop - begin)
                raw = part.column(2).to_pylist()
                sizes = np.array([len(x) for x in raw])
                data, place, starts = np.frombuffer(b"".join(raw), np.uint8), _valid(sizes, length), np.cumsum(sizes) - sizes
                own = np.searchsorted(starts, place, side="right") - 1
                rows = np.zeros(len(place), _WINDOW)
                rows["h"] = _gram_hashes(data, length, 0)[place] & mask
                rows["key"], rows["run"], rows["at"] = part.column(0).to_numpy()[own], part.column(1).to_numpy()[own], place - starts[own]
                rows, first, several = same(rows)
                here = rows[several]
                here = found(here[np.lexsort((here["at"], here["run"], here["key"]))])
                n = len(here[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1), pa.int64()), pa.nulls(n, pa.binary()), *here], names)
                rows["known"] = several
                one = rows[first]
                to = (one["h"] % np.uint64(buckets)).astype(np.int64)
                one, to = one[by := np.argsort(to, kind="stable")], to[by]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                sent = [one[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(one)), strict=True)]
                m = len(sent)
                yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int64()), pa.array(sent, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, _ARROW_SPANS)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, several = same(np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), _WINDOW))
        here = rows[several & ~rows["known"]]
        yield pa.RecordBatch.from_arrays(found(here[np.lexsort((here["at"], here["run"], here["key"]))]), names[2:])

    staged = common.stage(strings.select("key", "run", "bytes").mapInArrow(split, f"bucket long, packed binary, key long, run long, windows_ {_SPANS}"), "windows")
    met = staged.where("bucket >= 0").select("bucket", "packed").repartition(min(buckets, 50_000), "bucket").mapInArrow(meet, f"key long, run long, windows_ {_SPANS}")
    return staged.where("bucket < 0").select("key", "run", "windows_").unionByName(met)


def _hot(strings: DataFrame, length: int) -> DataFrame:
    """key, run, windows_ of strings of keys that too many distinct strings share: stretches whose hashes occur again, each distinct one compared once, by suffix order."""
    met = _met_again(strings, length).groupBy(F.col("key").alias("id_"), F.col("run").alias("th_")).agg(F.flatten(F.collect_list("windows_")).alias("s"))
    spans = _merged(met).select(F.col("id_").alias("k"), F.col("th_").alias("r"), F.explode("spans").alias("w"))
    bytes_ = F.expr(f"substring(bytes, w.begin + 1, w.end - w.begin + {length - 1})")
    cut = strings.join(spans, (F.col("key") == F.col("k")) & (F.col("run") == F.col("r"))).select("key", F.col("run").alias("whole"), F.col("w.begin").alias("begin"), (F.col("w.end") - F.col("w.begin")).alias("windows"), bytes_.alias("bytes"))
    cut = common.stage(cut.withColumn("run", F.xxhash64("bytes")), "stretches", "zstd")
    # counted as bytes; a stretch that several strings hold is repeated in all its windows
    distinct = common.stage(cut.groupBy("key", "run", "bytes").agg(F.count("*").alias("n")), "distinct-stretches", "zstd")
    found = distinct.where("n > 1").select("key", "run", F.lit(None).cast(_SPANS).alias("windows_")).unionByName(_compared(distinct, length))
    found = common.stage(found, "compared-stretches", "lz4").withColumnsRenamed({"key": "k", "run": "r"})
    hit = cut.drop("bytes").join(found, (F.col("key") == F.col("k")) & (F.col("run") == F.col("r")))
    moved = F.transform("windows_", lambda w: F.struct((w["begin"] + F.col("begin")).alias("begin"), (w["end"] + F.col("begin")).alias("end")))
    whole = F.array(F.struct(F.col("begin").alias("begin"), (F.col("begin") + F.col("windows")).alias("end")))
    return hit.select("key", F.col("whole").alias("run"), F.coalesce(moved, whole).alias("windows_"))


def _merged(found: DataFrame) -> DataFrame:
    """id_, th_ and spans in order, overlapping and adjacent ones joined."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, out = batch.column(2), []
            begins, ends = (flat.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets = flat.offsets.to_numpy() - flat.offsets[0].as_py()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                by = np.lexsort((ends[a:b], begins[a:b]))
                low, high = begins[a:b][by], np.maximum.accumulate(ends[a:b][by])
                cut = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                out.append(list(zip(low[cut].tolist(), high[np.append(cut[1:], len(low)) - 1].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _as_spans(out)], ["id_", "th_", "spans"])

    return found.mapInArrow(merge, f"id_ {found.schema['id_'].dataType.simpleString()}, th_ long, spans {_SPANS}")


def repeats(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id", hot: int | None = None) -> DataFrame:
    """id_, th_ (hash of the text) and spans (array of begin, end, in order, disjoint): bytes covered by repeated windows. Texts without any have no row."""
    hot = HOT if hot is None else hot
    named = _named(docs, text, doc_id).where(F.octet_length("text_") >= length)
    kind = named.schema["id_"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in common.groups_of(pc.binary_length(batch.column(2)).to_pylist(), 8_000_000):
                part = batch.slice(begin, stop - begin)
                own, first, count, key, run, twice = runs(part.column(2).to_pylist(), length)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(twice)], ["id_", "th_", "first", "windows", "key", "run", "twice"])
        common.release()

    every = common.stage(named.mapInArrow(find, f"id_ {kind}, th_ long, {_RUNS}"), "runs", "lz4")
    again = every.groupBy("key").agg(F.count("*").alias("met"), F.max("twice").alias("any")).where("met > 1 or any").select("key")
    met = common.stage(every.join(again, "key", "left_semi"), "met-runs", "lz4")
    common.drop_stage(every)
    distinct = common.stage(met.groupBy("key", "run").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("id_", "th_", "first", "windows")).alias("at")), "distinct", "lz4")
    keys = distinct.groupBy("key").agg(F.count("*").alias("strings"))
    both = distinct.join(keys, "key")
    # a key whose runs are all one string
    whole = both.where("(strings = 1 or n > 1) and not twice").select("key", "run")
    several = common.stage(both.where("strings > 1 or twice").select("key", "run", "n", "twice", "strings", "at.*"), "several", "lz4")
    strings = _strings(docs, several, length, text, doc_id).join(several.select("key", "run", "n", "strings"), ["key", "run"])
    strings = common.stage(strings, "strings", "zstd")
    found = _compared(strings.where(F.col("strings") <= hot), length)
    many = strings.where(F.col("strings") > hot)
    if not many.isEmpty():
        found = found.unionByName(_hot(many, length))
    # windows of a run that copies share are all repeated
    whole = whole.unionByName(several.where("n > 1 and twice").select("key", "run")).withColumn("windows_", F.lit(None).cast(_SPANS))
    covered = common.stage(whole.unionByName(found), "repeated", "lz4")
    common.drop_stage(strings)
    hit = met.select("id_", "th_", "first", "windows", "key", "run").join(covered, ["key", "run"])
    spans = F.coalesce(
        F.transform("windows_", lambda w: F.struct((F.col("first") + w["begin"]).alias("begin"), (F.col("first") + w["end"] + (length - 1)).alias("end"))),
        F.array(F.struct(F.col("first").alias("begin"), (F.col("first") + F.col("windows") + (length - 1)).alias("end"))),
    )
    out = common.stage(_merged(hit.select("id_", "th_", spans.alias("s")).groupBy("id_", "th_").agg(F.flatten(F.collect_list("s")).alias("spans"))), "spans")
    for one in (met, distinct, several, covered):
        common.drop_stage(one)
    return out


def repeats_within(docs: DataFrame, found: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``repeats``, where ``found`` holds the spans of a smaller length: a longer repeated string lies within one of those."""
    wide = found.select(F.col("id_").alias("i"), F.col("th_").alias("t"), F.filter("spans", lambda s: s["end"] - s["begin"] >= length).alias("wide")).where(F.size("wide") > 0)
    named = _named(docs, text, doc_id).where(F.octet_length("text_") >= length)
    joined = named.join(wide, F.col("id_").eqNullSafe(F.col("i")) & (F.col("th_") == F.col("t"))).select("id_", "th_", "text_", F.explode("wide").alias("s"))
    piece = F.struct("id_", "th_", F.col("s.begin").alias("begin"))
    pieces = common.stage(joined.select(piece.alias("piece"), F.expr("substring(text_, s.begin + 1, s.end - s.begin)").alias("bytes")), "pieces", "zstd")
    own = repeats(pieces, length, "bytes", "piece")
    moved = own.select(F.col("id_").alias("piece"), "spans").select("piece.id_", "piece.th_", F.transform("spans", lambda s: F.struct((s["begin"] + F.col("piece.begin")).alias("begin"), (s["end"] + F.col("piece.begin")).alias("end"))).alias("s"))
    out = common.stage(moved.groupBy("id_", "th_").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")), "spans")
    common.drop_stage(pieces)
    common.drop_stage(own)
    return out


def _cut(docs: DataFrame, found: DataFrame, text: str, doc_id: str, names: tuple[str, ...], whole: bool) -> DataFrame:
    """``docs`` with four more columns of the given names: remaining bytes, bytes, removed bytes, removed runs; and the other columns of ``found``."""
    th, raw, spans, i, t = common.fresh([*docs.columns, *found.columns, *names], "th", "raw", "spans", "i", "t")
    kept, n_bytes, n_removed, n_spans = names
    rows = docs.withColumns({th: F.xxhash64(text), raw: F.coalesce(common.text_bytes(text), F.lit(b""))})
    found = found.withColumnsRenamed({"id_": i, "th_": t, "spans": spans})
    joined = rows.join(found, rows[doc_id].eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)), "left").drop(i, t, th)
    joined = joined.withColumn(spans, F.coalesce(spans, F.array().cast(_SPANS)))
    if whole:
        inner = lambda place: f"hex(substring({raw}, {place}, 1)) between '80' and 'BF'"
        more = lambda places: "case " + " ".join(f"when not ({inner(p)}) then {i}" for i, p in enumerate(places)) + " else 3 end"
        begin, end = more(["s.begin + 1", "s.begin", "s.begin - 1"]), more(["s.end + 1", "s.end + 2", "s.end + 3"])
        joined = joined.withColumn(spans, F.expr(f"transform({spans}, s -> named_struct('begin', cast(greatest(s.begin - {begin}, 0) as int), 'end', cast(s.end + {end} as int)))"))
        # spans are in order and disjoint, so two that meet after widening meet in one character
        joined = joined.withColumn(spans, F.expr(f"transform({spans}, (s, i) -> named_struct('begin', if(i > 0, greatest(s.begin, {spans}[i - 1].end), s.begin), 'end', s.end))"))
    pieces = F.expr(f"transform(sequence(0, size({spans})), i -> hex(substring({raw}, if(i = 0, 0, {spans}[i - 1].end) + 1, greatest(0, if(i = size({spans}), octet_length({raw}), {spans}[i].begin) - if(i = 0, 0, {spans}[i - 1].end)))))")
    cut = F.when(F.size(spans) == 0, F.col(raw)).otherwise(F.unhex(F.array_join(pieces, "")))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    runs_ = F.size(F.filter(spans, lambda s, i: (i == 0) | (s["begin"] > F.element_at(spans, F.when(i == 0, 1).otherwise(i))["end"]))).cast("long")
    return joined.withColumns({kept: cut, n_bytes: F.octet_length(raw).cast("long"), n_removed: removed, n_spans: runs_}).drop(raw, spans)


def remove(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id", whole: bool = False, names: tuple[str, ...] = ("kept_", "n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """``docs`` with the remaining bytes, the bytes, the removed bytes and the maximal removed runs of each text in columns ``names``,
    which take the place of columns of the same names. ``whole``: runs are widened to whole UTF-8 characters."""
    return _cut(docs.drop(*names), repeats(docs, length, text, doc_id), text, doc_id, names, whole)


def digest(docs: DataFrame, length: int = 400, passage: int = 200) -> DataFrame:
    """Beside what ``length`` removes, the bytes that repeated strings of ``passage`` bytes (about fifty short words) cover."""
    docs = docs.select("doc_id", "text")
    covered = repeats(docs, min(passage, length))
    found = covered.join(repeats_within(docs, covered, length).withColumnsRenamed({"id_": "i", "th_": "t", "spans": "own"}), F.col("id_").eqNullSafe(F.col("i")) & (F.col("th_") == F.col("t")), "left")
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    found = found.select("id_", "th_", n.alias("passage_bytes"), F.size("spans").cast("long").alias("n_passages"), F.col("own").alias("spans"))
    out = _cut(docs, found, "text", "doc_id", ("kept", "n_bytes", "n_removed", "n_spans"), False)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), zero("passage_bytes"), zero("n_passages"))
