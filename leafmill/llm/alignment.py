"""Alignment of two tokenizers over the same texts, and how often their ids go together.

Both tokenizers cut the UTF-8 bytes of a space and the text (A is given the space, B adds it). The tokens of a text are the nodes of
a bipartite graph, with an edge where the byte ranges of an A and a B token overlap; every stretch between two neighbouring ends is
such an edge. Union-find (hooking to the smaller root, then pointer jumping, over many texts at once) gives its connected
components, which are exactly the minimal groups: the shortest runs of A and B tokens with the same bytes. Within a component every A and
B token that end together are linked.

Links are counted in Spark: a text's distinct pairs of ids with their number are written to the shared folder, summed over the
corpus with map-side sums, and joined back: by broadcast where there are at most ``MOST`` pairs (about 100 bytes each), beyond that by a shuffle that is
salted by row, as a few pairs are in nearly all texts.

Null and empty texts, and texts that the tokens of A or B don't give back byte for byte, have no tokens: counts 0, groups ''. Texts are
aligned to their end, however long; strings of special tokens are plain text. Repeated rows and equal or null ids count as rows of their own;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import _ODD, ragged

#: Distinct pairs that are broadcast at most, parts of a pair's rows beyond, and bytes of text that are aligned at once.
MOST, SALTS, GROUP = 1 << 20, 16, 1_000_000


#: Ids of texts, joined, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]


def flat(ids: list[list[int]]) -> Ids:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``counts`` values, which may be none."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Vocabulary:
    """Bytes of every id of a tokenizer, joined, with the place and length of each, and ``encode`` for lists of texts."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.begin[ids], self.length[ids])


@cache
def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others count on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file; a space goes before texts that are to have one."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    signs, names = byte_signs(), tokenizer.get_vocab()
    tokens = [b""] * (max(names.values(), default=0) + 1)
    for name, i in names.items():
        tokens[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()

    def encode(texts: list[str], spaced: list[bool]) -> Ids:
        led = [" " + t if s else t for t, s in zip(texts, spaced, strict=True)]
        return flat([e.ids for e in tokenizer.encode_batch_fast(led, add_special_tokens=False)])

    return Vocabulary(tokens, encode)


@cache
def pieces(path: str) -> Vocabulary:
    """A model of pieces, which puts a space before each text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    tokens = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return Vocabulary(tokens, lambda texts: flat(model.encode(texts, num_threads=1)))


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's connected component, for edges u[i] - v[i] among n nodes."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the minimal group of each A and of each B token, from 0 in order of the text, for the ends of tokens that cover the same bytes."""
    # each stretch between neighbouring ends lies in one token of A and one of B
    stretches = np.sort(np.concatenate([end_a, end_b]))
    stretches = stretches[np.diff(stretches, append=-1) != 0]
    a, b = np.searchsorted(end_a, stretches), np.searchsorted(end_b, stretches)
    # nodes are numbered in order of their ends
    place_a = np.arange(len(end_a)) + np.searchsorted(end_b, end_a, "left")
    place_b = np.arange(len(end_b)) + np.searchsorted(end_a, end_b, "right")
    root = components(place_a[a], place_b[b], len(end_a) + len(end_b))
    number = np.cumsum(root == np.arange(len(root))) - 1
    return number[root[place_a]], number[root[place_b]]


_DIGITS = 10 ** np.arange(1, 10)


def listed(group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``ends`` has the number of groups up to each text's end."""
    side = np.concatenate([np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8)])
    group, ids = np.concatenate([group_a, group_b]), np.concatenate([ids_a, ids_b])
    order = np.lexsort((side, group))  # stable: tokens of a side stay in order
    side, group, ids = side[order], group[order], ids[order]
    width = 1 + np.searchsorted(_DIGITS, ids, "right")
    # one sign behind each id: , within a side, | between sides, ; between groups
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[:-1][(side[1:] != side[:-1])] = ord("|")
    sign[:-1][group[1:] != group[:-1]] = ord(";")
    stop = np.cumsum(width + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[stop - 1] = sign
    left = ids.copy()
    for i in range(int(width.max(initial=0))):
        has = width > i
        out[stop[has] - 2 - i] = 48 + left[has] % 10
        left //= 10
    data = out.tobytes()
    at = [0, *stop[np.searchsorted(group, ends - 1, "right") - 1].tolist()]
    return [data[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *parts])


class Aligned:
    """What is known of a list of texts: n_a, n_b, n_groups of each, its groups as text, and its links (codes a << 32 | b, held of each text). ``good``: whether the tokens of both give it back."""

    def __init__(self, raw: list[bytes], a: Ids, b: Ids, first: Vocabulary, second: Vocabulary):
        n = len(raw)
        size = np.fromiter(map(len, raw), np.int64, n)
        self.n_a, self.n_b, self.n_groups, self.held = (np.zeros(n, np.int64) for _ in range(4))
        self.groups, self.codes = [b""] * n, np.empty(0, np.int64)
        good = (size > 0) & (sums(first.length[a[0]], a[1]) == size) & (sums(second.length[b[0]], b[1]) == size)
        if good.any():
            want = np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist(), strict=True) if ok), np.uint8)
            match = (first.bytes_of(a[0][np.repeat(good, a[1])]) == want) & (second.bytes_of(b[0][np.repeat(good, b[1])]) == want)
            good[good] = sums(match, size[good]) == size[good]
        self.good = good
        if not good.any():
            return
        at = np.flatnonzero(good)
        ids_a, ids_b = a[0][np.repeat(good, a[1])], b[0][np.repeat(good, b[1])]
        self.n_a[at], self.n_b[at] = a[1][at], b[1][at]
        end_a, end_b, ends = np.cumsum(first.length[ids_a]), np.cumsum(second.length[ids_b]), np.cumsum(size[at])
        group_a, group_b = groups(end_a, end_b)
        # members of a component that end together; all of them, where a token is empty
        low, high = np.searchsorted(end_b, end_a, "left"), np.searchsorted(end_b, end_a, "right")
        mine = np.repeat(np.arange(len(ids_a)), high - low)
        self.codes = ids_a[mine] << 32 | ids_b[ragged(np.arange(len(ids_b)), low, high - low)]
        self.held[at] = np.bincount(np.searchsorted(ends, end_a[mine], "left"), minlength=len(at))
        last = group_a[np.searchsorted(end_a, ends, "right") - 1] + 1
        self.n_groups[at] = np.diff(last, prepend=0)
        for i, text in zip(at.tolist(), listed(group_a, group_b, ids_a, ids_b, last), strict=True):
            self.groups[i] = text


#: What a text can't be cut at (a run of white space that either tokenizer may take as one, white space that isn't a space or line feed, and the sign of the cut).
_WHOLE = "  | \\n|\\n\\n\\n|\\n\\n |^[ \\n]| $|\\n\\n$|\x01|" + _ODD


class Aligner:
    """Aligns texts. Both tokenizers always cut before a single space and around a line feed, so a text there falls into parts (a word with the space before it, a line feed, a word behind one)
    that are aligned once each and kept, up to ``cache`` bytes; groups and links never cross a cut. Texts with other arrangements of white space are aligned whole."""

    def __init__(self, first: Vocabulary, second: Vocabulary, cache: int = 40_000_000):
        self.first, self.second, self.most = first, second, cache
        self.feed = int(second.encode(["\n"])[1][0])  # tokens of a space and a line feed
        self.clear()

    def clear(self) -> None:
        self.keys, self.texts, self.size = pa.array([], pa.large_string()), [], 0
        self.codes, self.columns = np.empty(0, np.int64), np.empty((0, 5), np.int64)

    def parts(self, new: pa.Array) -> None:
        """Align parts that are met for the first time."""
        words = new.to_pylist()
        led = [w[0] == " " for w in words]
        a = self.first.encode([w[1:] if s else w for w, s in zip(words, led, strict=True)], led)
        ids, counts = self.second.encode([w[1:] if s else "\n" + w for w, s in zip(words, led, strict=True)])
        # what isn't led by a space goes behind a line feed, whose tokens are taken off
        off = np.where(led, 0, self.feed)
        b = ids[np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts) >= np.repeat(off, counts)], counts - off
        got = Aligned([w.encode("utf-8", "surrogatepass") for w in words], a, b, self.first, self.second)
        begin = len(self.codes) + np.cumsum(got.held) - got.held
        self.columns = np.concatenate([self.columns, np.stack([got.n_a, got.n_b, got.n_groups, np.where(got.good, got.held, -1), begin], 1)])
        self.codes = np.concatenate([self.codes, got.codes])
        self.texts += [t.decode() for t in got.groups]
        self.keys = pa.concat_arrays([self.keys, new])
        self.size = self.keys.nbytes + self.columns.nbytes + self.codes.nbytes + sum(map(len, self.texts)) + 60 * len(self.texts)

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray | list[str]]:
        """n_a, n_b, n_groups, n_links and groups of each text, and its distinct links: how many (held) of ids (a, b), each n times. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "held")} | {"groups": [""] * n}
        codes, docs = [], []
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        full = pc.binary_length(texts).to_numpy() > 0
        at = np.flatnonzero(full & ~whole)
        if len(at):
            self.cut(texts.take(pa.array(at)), at, out, codes, docs)
        at = np.flatnonzero(full & whole)
        if len(at):
            plain = texts.take(pa.array(at)).to_pylist()
            got = Aligned([b" " + t.encode("utf-8", "surrogatepass") for t in plain], self.first.encode(plain, [True] * len(plain)), self.second.encode(plain), self.first, self.second)
            for c in ("n_a", "n_b", "n_groups"):
                out[c][at] = getattr(got, c)
            for i, t in zip(at.tolist(), got.groups, strict=True):
                out["groups"][i] = t.decode()
            codes.append(got.codes)
            docs.append(np.repeat(at, got.held))
        code, doc = _join(codes), _join(docs)
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        begins = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        out["n_links"] = np.bincount(doc, minlength=n)
        out["n"] = np.diff(np.append(begins, len(code))).astype(np.int32)
        out["a"], out["b"] = (code[begins] >> 32).astype(np.int32), (code[begins] & 0xFFFFFFFF).astype(np.int32)
        out["held"] = np.bincount(doc[begins], minlength=n)
        return out

    def cut(self, texts: pa.Array, at: np.ndarray, out: dict, codes: list[np.ndarray], docs: list[np.ndarray]) -> None:
        if self.size > self.most:
            self.clear()
        marked = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), " ", "\x01 "), "\n", "\x01\n\x01")
        split = pc.split_pattern(marked, "\x01")
        values = split.flatten()
        some = pc.binary_length(values).to_numpy() > 0
        ends = np.concatenate([[0], np.cumsum(some)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        coded = values.filter(pa.array(some)).dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.keys)
        lacking = coded.dictionary.filter(pc.is_null(place))
        if len(lacking):
            known = len(self.keys)
            self.parts(lacking)
            place = pc.fill_null(place, -1).to_numpy().copy()
            place[place < 0] = known + np.arange(len(lacking))
        else:
            place = place.to_numpy()
        part = place[coded.indices.to_numpy()].astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        own = self.columns[part]
        good = np.minimum.reduceat(own[:, 3], starts) >= 0
        for i, c in enumerate(("n_a", "n_b", "n_groups")):
            out[c][at[good]] = np.add.reduceat(own[:, i], starts)[good]
        texts_of, listed_parts = self.texts, part.tolist()
        for i in np.flatnonzero(good).tolist():
            out["groups"][at[i]] = ";".join([texts_of[p] for p in listed_parts[starts[i] : ends[i]]])
        held = np.where(np.repeat(good, ends - starts), own[:, 3], 0)
        codes.append(ragged(self.codes, own[:, 4], held))
        docs.append(np.repeat(np.repeat(at, ends - starts), held))


@cache
def aligner(first: str, second: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(byte_level(first), pieces(second))


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a: int, b: int, n: int>>"


def align(docs: DataFrame, first: str, second: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups (as text) and links (distinct pairs of ids, each n times)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(first, second)
        for batch in batches:
            column = batch.column(len(names))
            for begin, stop in common.groups_of([n or 0 for n in pc.binary_length(column).to_pylist()], GROUP):
                found = align(column.slice(begin, stop - begin))
                pairs = pa.StructArray.from_arrays([pa.array(found[c]) for c in "abn"], ["a", "b", "n"])
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found["held"])]).astype(np.int32)), pairs)
                counts = [pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]
                own = [batch.column(i).slice(begin, stop - begin) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array(found["groups"], pa.string()), links], [*names, "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
            common.release()

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold the two ids), best (the highest count of this b), from a column ``links``."""
    pairs = links.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("count"))
    pairs = common.stage(pairs, "pairs")
    top = pairs.groupBy(F.col("b").alias("top_b")).agg(F.max("count").alias("top"))
    return common.stage(pairs.join(top, F.col("b") == F.col("top_b")).select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")), "pair-counts")


def rated(links: DataFrame, counts: DataFrame, row: str, most: int = MOST) -> DataFrame:
    """row, n_best, count_sum of the rows with links. ``most``: pairs up to which the counts are broadcast."""
    each = links.select(row, F.explode("links").alias("l")).select(row, F.col("l.a").alias("la"), F.col("l.b").alias("lb"), F.col("l.n").alias("ln"))
    met = (F.col("la") == F.col("a")) & (F.col("lb") == F.col("b"))
    if counts.count() <= most:
        each = each.join(F.broadcast(counts), met)
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.join(salted.hint("shuffle_hash"), met & (F.pmod(F.col(row), F.lit(SALTS)).cast("int") == F.col("salt")))
    return each.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("ln")).otherwise(0)).alias("n_best"), F.sum(F.col("ln") * F.col("count")).alias("count_sum"))


def digest(docs: DataFrame, first: str, second: str, most: int = MOST) -> DataFrame:
    found = align(docs, first, second).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    rows = common.stage(found.withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = pair_counts(rows)
    own = rated(rows, counts, "row", most).withColumnRenamed("row", "row_")
    out = rows.drop("links").join(own, F.col("row") == F.col("row_"), "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
