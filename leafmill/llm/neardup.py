"""One document of each group of near-duplicate texts: five-word shingles with a Jaccard similarity of 0.8 or more.

First come SimHash fingerprints of the shingles, whose links by anchors (``simhash.links``) name the likeliest pairs: texts of one fingerprint
with the smallest of them, and fingerprints that differ in 2 bits at most. Texts of a similarity of 0.8 may differ in more bits, so an exact
prefix filter names the rest. Shingles have one order for all texts, those that are frequent in a sample last (the sample
decides how long the work takes, not what is found). Two sets of a similarity of 0.8 share a shingle among the first ones of either,
a fifth of the set and one more. Pairs that meet there are dropped only where their sizes, the places of the shingle or the parities
of 256, 1,024 or 4,096 classes of shingles rule out 0.8; all other pairs are compared in full. First each text is compared with those its fingerprint names and with two
texts at each shingle, drawn anew for each: texts that meet at many shingles are compared with many of their group, whose links then tie most of it. Then come all pairs at a shingle that these
links have not put into one group yet, in salted blocks. Components of the links are the groups; the smallest doc_id stays. A text of fewer than five words is one shingle, so that short texts join only their copies.

Equal texts (ASCII case and white space apart) are one class. Null counts as empty; all empty texts are one group. Of repeated rows one stays.
An empty table gives an empty one. Texts may be of any length; a slice of a few megabytes or one text is held at a time. Names of inner columns are chosen anew,
so no column of the input is in the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .words import hashed, shingles

SIMILAR, WIDTH, PARITIES, SAMPLE, FREQUENT, BLOCK = 0.8, 5, 4, 5_000, 1 << 17, 1_000
#: Share of the texts that the sample holds at least, however many there are: a shingle of one text in a thousand would be rare in a sample
#: of fixed size, and its pairs grow with the square of the table.
SHARE = 0.1
#: Classes of shingles of a sketch, whose parities rule out pairs of sets up to some thousand shingles.
CLASSES = 4096
#: Texts from which a shingle is crowded, and 64-bit words of parities that rule out its pairs: they grow with the square of the texts, and 256 parities let many unlike ones pass.
CROWDED, MORE = 64, 16
_BITS = [f"b{i}" for i in range(PARITIES)]


def _class(text: str):
    """Names a text up to ASCII case and white space at its words' ends, by 64 bits."""
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """th_, size, parities and the sorted shingle hashes of one text of each class."""
    rows = docs.select(_class(text).alias("th_"), F.coalesce(common.text_bytes(text), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets, bits, prints = common.values(batch.column(1)), [], [], []
            for begin, stop in common.groups_of([len(t) for t in texts], 4_000_000):
                h, offsets = hashed(texts[begin:stop], signs=True)
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = np.unique(shingles(h[a:b], WIDTH))
                    prints.append(simhash.fingerprint(own))
                    odd = np.bincount((own % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) % 2
                    sets.append(own)
                    bits.append(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
            parities = np.array(bits, np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in parities.T), pa.array([s.tobytes() for s in sets], pa.binary())], ["th_", "fingerprint", "size", *_BITS, "set"]
            )
        common.release()

    return rows.dropDuplicates(["th_"]).mapInArrow(run, f"th_ long, fingerprint long, size long, {', '.join(f'{b} long' for b in _BITS)}, set binary")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold (sorted) and in how many: only their order depends on it."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, sets.count())))
    sample = sets.where(F.pmod(F.xxhash64("th_"), F.lit(1 << 20)) < int(share * (1 << 20))).select("set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(common.values(batch.column(0))), np.int64))], ["token"])

    found = sample.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow().to_pandas()
    tokens, n = found.token.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64)
    by = np.argsort(tokens)
    return tokens[by], n[by]


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """token, th_ and place: the first shingles of each set, as many as any similar set must share one of."""
    shared = sets.sparkSession.sparkContext.broadcast(_frequent(sets))  # at most FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = shared.value
        for batch in batches:
            ths, found, places = batch.column(0).to_numpy(), [], []
            for raw in common.values(batch.column(1)):
                own = np.frombuffer(raw, np.uint64)
                first = len(own) - int(np.ceil(similar * len(own) - 1e-9)) + 1 if len(own) else 0
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    own = own[np.argsort(np.where(tokens[at] == own, n[at], 0), kind="stable")]
                found.append(own[:first])
                places.append(np.arange(first))
            counts = [len(f) for f in found]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ths, counts)), pa.array(np.concatenate(places).astype(np.int32))], ["token", "th_", "place"])

    return sets.select("th_", "set").mapInArrow(run, "token long, th_ long, place int")


def _shared(firsts: DataFrame) -> DataFrame:
    """The rows of tokens that several texts hold. Most are in one text alone: all rows travel once, by their token, and those go before any is stored."""
    (n,) = common.fresh(firsts.columns, "n")
    return firsts.withColumn(n, F.count("*").over(Window.partitionBy("token"))).where(F.col(n) > 1).drop(n)


def _possible(similar: float, bits: list[str] = _BITS) -> Column:
    """Of two places x and y of a shingle: nothing rules out that it is the first shared one of similar sets."""
    x, y = F.col("x.size"), F.col("y.size")
    most = F.least(x - F.col("x.place"), y - F.col("y.place"))
    odd = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits))
    slack = F.lit(1e-6)
    return (F.least(x, y) >= F.greatest(x, y) * similar - slack) & (most >= (x + y) * (similar / (1 + similar)) - slack) & (odd <= (x + y) * ((1 - similar) / (1 + similar)) + slack)


def _sketches(sets: DataFrame) -> DataFrame:
    """th_, size and the parities of ``CLASSES`` classes of shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw, np.uint64) for raw in common.values(batch.column(2))]
            odd = [np.packbits((np.bincount((x % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) & 1).astype(bool)).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.binary())], ["th_", "size", "sketch"])

    return sets.select("th_", "size", "set").mapInArrow(run, "th_ long, size long, sketch binary")


def _parities(sets: DataFrame, names: list[str]) -> DataFrame:
    """th_ and the parities of 64 classes of shingles for each of ``names``."""
    classes = 64 * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw, np.uint64) for raw in common.values(batch.column(1))]
            odd = [np.packbits((np.bincount((x % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).astype(bool)).view(np.int64) for x in own]
            columns = np.array(odd, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["th_", *names])

    return sets.select("th_", "set").mapInArrow(run, f"th_ long, {', '.join(f'{n} long' for n in names)}")


def _named(sets: DataFrame, ths: DataFrame) -> DataFrame:
    """The sets of some texts (th_). Only the names travel: sets lie in buckets, and a hash join doesn't sort them."""
    return sets.join(ths.distinct().hint("shuffle_hash"), "th_", "left_semi")


def _of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that a pair names."""
    return _named(sets, pairs.select(F.explode(F.array("a", "b")).alias("th_")))


def _joined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b and the rows of both, as x and y."""
    x, y = (rows.select(F.col("th_").alias(c), F.struct(*[n for n in rows.columns if n != "th_"]).alias(of)) for c, of in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b), staged, whose sets, compared in full, are similar. Sketches travel first; sets do for pairs that no sketch rules out."""

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(common.values(batch.column(i))), np.uint8).reshape(-1, CLASSES // 8) for i in (3, 4))
            # each shingle that one set alone holds changes one parity
            odd = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            kept = pa.array(odd <= batch.column(2).to_numpy() * ((1 - similar) / (1 + similar)) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(common.values(batch.column(2)), common.values(batch.column(3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - common_
                keep.append(total == 0 or common_ >= similar * total)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    pairs = common.stage(pairs, "pairs")
    sketches = common.stage(_sketches(_of_pairs(pairs, sets)), "sketches")
    left = _joined(pairs, sketches).select("a", "b", (F.col("x.size") + F.col("y.size")).alias("sizes"), "x.sketch", F.col("y.sketch").alias("other"))
    left = common.stage(left.mapInArrow(unlike, "a long, b long"), "left-pairs")
    common.drop_stage(pairs)
    common.drop_stage(sketches)
    own = common.stage(_of_pairs(left, sets).select("th_", "set"), "own-sets")
    out = common.stage(_joined(left, own).select("a", "b", "x.set", F.col("y.set").alias("other")).mapInArrow(compare, "a long, b long"), "similar")
    common.drop_stage(left)
    common.drop_stage(own)
    return out


def _fingerprinted(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that their fingerprints name: each with the smallest of its fingerprint, and the smallest ones of linked fingerprints."""
    least = common.stage(sets.groupBy("fingerprint").agg(F.min("th_").alias("least")), "fingerprints")
    same = sets.select("fingerprint", "th_").join(least, "fingerprint").where("th_ <> least").select(F.col("least").alias("a"), F.col("th_").alias("b"))
    one, two = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    linked = simhash.links(least.select("fingerprint")).join(one, "a").join(two, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    both = same.unionByName(linked)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, text: str, similar: float = SIMILAR) -> DataFrame:
    """Pairs a < b of similar classes, enough of them that their components are those of all similar pairs."""
    sets = common.stage_by(_sets(docs, text), "sets", "th_")
    # the shuffle files of all prefixes go before the rows of the shared ones travel
    shared = common.stage(_shared(_prefixes(sets, similar)), "shared")
    at = common.stage(shared.join(sets.select("th_", "size", *_BITS), "th_"), "shared-shingles")
    common.drop_stage(shared)
    pair = [F.least("x.th_", "y.th_").alias("a"), F.greatest("x.th_", "y.th_").alias("b")]
    drawn = F.struct(F.xxhash64("token", "th_").alias("draw"), "th_", "size", "place", *_BITS)
    hubs = at.groupBy("token").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high"))
    met = at.select("token", drawn.alias("x")).join(hubs, "token").select("x", F.explode(F.array("low", "high")).alias("y"))
    first = _similar(met.where((F.col("x.th_") != F.col("y.th_")) & _possible(similar)).select(*pair).unionByName(_fingerprinted(sets)).distinct(), sets, similar)
    # texts in one group already need no further comparison
    roots = common.stage(simhash.components(first), "roots")
    rooted = at.join(roots.withColumnRenamed("node", "th_"), "th_", "left").withColumn("root", F.coalesce("root", "th_"))
    rooted = common.stage(rooted, "rooted")
    common.drop_stage(at)
    open_ = rooted.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    open_ = common.stage(open_, "open")
    crowded = common.stage(open_.where(F.col("n") >= CROWDED), "crowded")
    rows = common.stage(rooted.select("token", "th_", "size", "place", "root").join(crowded.select("token", "blocks"), "token"), "crowded-rows")
    wide = [f"w{i}" for i in range(MORE)]
    more_bits = _parities(_named(sets, rows.select("th_")), wide)

    def pairs_of(rows: DataFrame, bits: list[str]) -> DataFrame:
        """Pairs at one shingle whose groups differ and that these parities don't rule out."""
        whole = F.struct("th_", "size", "place", "root", *bits)
        left = rows.select("token", F.pmod(F.xxhash64("th_"), F.col("blocks")).alias("block"), whole.alias("x"))
        right = rows.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), whole.alias("y"))
        return left.join(right, ["token", "block"]).where((F.col("x.root") < F.col("y.root")) & _possible(similar, bits)).select(*pair)

    few = rooted.join(open_.where(F.col("n") < CROWDED).select("token", "blocks"), "token")
    more = pairs_of(few, _BITS).unionByName(pairs_of(rows.join(more_bits, "th_"), wide)).distinct()
    out = first.unionByName(_similar(more, sets, similar))
    for used in (rooted, open_, crowded, rows, sets):
        common.drop_stage(used)
    return out


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rows = docs.select(F.col(doc_id).alias("id_"), _class(text).alias("th_"))
    # of a class the smallest doc_id stands for it; null ids come last
    first = F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id")))
    classes = common.stage(rows.groupBy("th_").agg(first.alias("first")), "classes")
    roots = simhash.components(links(docs, text))
    named = classes.join(roots.withColumnRenamed("node", "th_"), "th_", "left").withColumn("root", F.coalesce("root", "th_"))
    th, k, i, t = common.fresh(docs.columns, "th", "k", "i", "t")
    stay = named.groupBy("root").agg(F.min(F.struct("first", "th_")).alias("s")).select(common.key_of("s.first.id").alias(i), F.col("s.th_").alias(t))
    # whole rows travel once, for the join and for repeated rows
    marked = docs.withColumn(k, common.key_of(doc_id)).withColumn(th, _class(text))
    kept = marked.join(stay, (F.col(k) == F.col(i)) & (F.col(th) == F.col(t))).drop(i, t)
    return kept.dropDuplicates([k, th]).drop(k, th)
