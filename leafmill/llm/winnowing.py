"""Benchmark decontamination by winnowing, with DataFrame operations only.

A span that a document and a benchmark item share counts from ``SPAN`` words on. Of every SPAN consecutive words the k-gram (``GRAM``
words) with the smallest hash is kept, the last one where several are smallest: both sides keep the same one wherever SPAN words
agree, so no shared span is missed. An item of fewer words is one window of its own; its fingerprint is the hash of all its words, and documents
give the n-grams of exactly the lengths that such items have.

Documents and items are joined on fingerprints. Each carries the words around it that a window with it can reach (five on either side), so that a hit is
extended in its own row, word by word, which also refutes equal hashes of different words. Every window that occurs holds a fingerprint, so the union of what
the hits cover is all of it. Items' fingerprints are broadcast where there are at most ``MOST`` (some 500 bytes each) and documents
then aren't shuffled at all. Beyond that, a bit set of fixed size (2^23 bits) sorts out fingerprints that no item has, and
the join shuffles the others, salted by row, so that a fingerprint which a third of all documents have is spread. Hits are summed by row.

Words are the runs of ASCII letters (A-Z as a-z), digits and all characters beyond ASCII. Null texts have none. Texts count whole,
however long; repeated rows and repeated ids count each; a null item_id is written as ''; items without words are never found; with no items
nothing is hit; an empty table gives an empty one. Inner columns have names of their own, ``keep`` columns come back under theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SPAN, GRAM = 10, 5
#: Fingerprints of items that are broadcast at most, and parts of a fingerprint's rows beyond.
MOST, SALTS = 100_000, 16
#: 64-bit words of the bit set.
SET = 1 << 17


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _places(n: Column, width: int) -> Column:
    """0, 1, ... for every run of ``width`` among n words."""
    return F.when(n >= width, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, n: str, width: int) -> Column:
    return F.transform(_places(F.col(n), width), lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(hashes), i + j) for j in range(width)]))


def fingerprints(rows: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """Adds prints, an array of (p: place, l: words of the span, f: hash), from columns words and n. ``lengths``: those of spans, SPAN or less.

    ``whole``: rows of fewer than SPAN words are one window each (items), else they give all windows of the lengths (documents).
    """
    def printed(places: Column, length: int, grams: str) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(length).alias("l"), F.get(F.col(grams), p).alias("f")))

    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    found = []
    if SPAN in lengths:
        rows = rows.withColumn("grams", _grams("hashes", "n", GRAM))
        step = SPAN - GRAM

        def last_smallest(i: Column) -> Column:
            own = [F.get(F.col("grams"), i + j) for j in range(step + 1)]
            least = F.least(*own)
            at = F.when(own[step] == least, i + step)
            for j in reversed(range(step)):
                at = at.when(own[j] == least, i + j)
            return at

        kept = F.array_distinct(F.transform(_places(F.col("n"), SPAN), last_smallest))
        found.append(printed(kept, SPAN, "grams"))
    for length in sorted(set(lengths) - {SPAN}):
        rows = rows.withColumn(f"grams{length}", _grams("hashes", "n", length))
        places = F.when((F.col("n") == length) | F.lit(not whole), _places(F.col("n"), length)).otherwise(F.array().cast("array<int>"))
        found.append(printed(places, length, f"grams{length}"))
    none = F.array().cast("array<struct<p: int, l: int, f: bigint>>")
    return rows.withColumn("prints", F.concat(none, *found)).drop("hashes", "grams", *[f"grams{n}" for n in lengths])


def _around(prints: DataFrame) -> DataFrame:
    """From words and x (a print): p, l, f, left (words before it that count) and near (those, its own and the ones behind it)."""
    p, span = F.col("x.p"), F.col("x.l")
    reach = F.when(span == SPAN, SPAN - GRAM).otherwise(0)
    left = F.least(p, reach)
    return prints.select(*[c for c in prints.columns if c not in ("x", "words")], p.alias("p"), span.alias("l"), F.col("x.f").alias("f"), left.alias("left"), F.slice("words", p - left + 1, left + span).alias("near"))


def bit_set(prints: DataFrame) -> DataFrame:
    """One row with the bits of all hashes f, as an array of SET words."""
    bits = prints.groupBy(F.shiftrightunsigned("f", 6).bitwiseAND(SET - 1).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(f & 63 as int))")).alias("w"))
    every = prints.sparkSession.range(SET).join(bits, "id", "left").select("id", F.coalesce("w", F.lit(0)).alias("w"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("all")).select(F.transform("all", lambda x: x["w"]).alias("bits"))


def hits(docs: DataFrame, items: DataFrame, carry: list[str], most: int = MOST) -> DataFrame:
    """``carry`` columns, item_id, s, e: the words s, ..., e - 1 of a document are windows of an item around a fingerprint of both.

    A document (words, prints) has one row more, where item_id, s and e are null; in those with hits the ``carry`` columns are null, but for row.
    """
    own = items.select("item_id", "words", F.explode("prints").alias("x"))
    own = _around(own).select("item_id", F.col("l").alias("l2"), F.col("f").alias("f2"), F.col("left").alias("left2"), F.col("near").alias("near2"))
    few = own.count() <= most
    first = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("l"), F.lit(0).cast("long").alias("f")))
    each = docs.select(*carry, "words", F.explode(F.concat(first, "prints")).alias("x"))
    each = each.select(*[F.when(F.col("x.l") == 0, F.col(c)).alias(c) if c != "row" else F.col(c) for c in carry], "words", "x")
    same = (F.col("f") == F.col("f2")) & (F.col("l") == F.col("l2"))
    head = F.col("l") == 0
    if few:
        met = _around(each).join(F.broadcast(own), same, "left").where(head | F.col("l2").isNotNull())
    else:
        bits = bit_set(own.select(F.col("f2").alias("f"))).scalar()
        f = F.col("x.f")
        maybe = F.getbit(F.get(bits, F.shiftrightunsigned(f, 6).bitwiseAND(SET - 1).cast("int")), f.bitwiseAND(63).cast("int")) == 1
        each = _around(each.where((F.col("x.l") == 0) | maybe))
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.where(~head).join(salted, same & (F.pmod(F.col("row"), F.lit(SALTS)).cast("int") == F.col("salt"))).drop("salt")
        met = each.where(head).unionByName(met, allowMissingColumns=True)
    left = F.least("left", "left2")
    met = met.withColumn("least", left).withColumn("equal", F.zip_with(F.slice("near", F.col("left") - left + 1, F.size("near")), F.slice("near2", F.col("left2") - left + 1, F.size("near2")), lambda a, b: a.eqNullSafe(b)))
    # windows that hold a hit are neighbours where they agree
    met = met.withColumn("starts", F.filter(_places(F.size("equal"), 1), lambda j: (j + F.col("l") <= F.size("equal")) & F.forall(F.slice(F.col("equal"), j + 1, F.col("l")), lambda x: x)))
    at = F.col("p") - F.col("least")
    met = met.where(head | (F.size("starts") > 0))
    return met.select(*carry, F.when(~head, F.col("item_id")).alias("item_id"), F.when(~head, at + F.array_min("starts")).alias("s"), F.when(~head, at + F.array_max("starts") + F.col("l")).alias("e"))


def _found(docs: DataFrame, benchmark: DataFrame, text: str, keep: tuple[str, ...], item_id: str, item_text: str, most: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words(F.col(item_text)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect())  # SPAN values at most
    items = common.stage(fingerprints(items, lengths, True), "items")
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words(F.col(text)).alias("words"), F.monotonically_increasing_id().alias("row")).withColumn("n", F.size("words"))
    return common.stage(hits(fingerprints(rows, lengths, False), items, ["row", "n", *[f"k{i}" for i in range(len(keep))]], most), "hits")


def _heads(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return found.where("s is null").select("row", "n", *[f"k{i}" for i in range(len(keep))])


def spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", most: int = MOST) -> DataFrame:
    """``keep`` columns, item_id, start, stop: the longest runs of a document's words that windows of one item cover."""
    found = _found(docs, benchmark, text, keep, item_id, item_text, most)
    by = Window.partitionBy("row", "item_id").orderBy("s", "e")
    each = found.where("s is not null").select(F.col("row").alias("row_"), "item_id", "s", "e", (F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int").alias("new"))
    each = each.withColumnRenamed("row_", "row").withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.groupBy(F.col("row").alias("row_"), "item_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    out = each.join(_heads(found, keep), F.col("row") == F.col("row_"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "item_id", F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("stop"))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", most: int = MOST) -> DataFrame:
    """``keep`` columns, n_words, n_hit, items (ids as sorted strings), for every document."""
    found = _found(docs, benchmark, text, keep, item_id, item_text, most)
    before = F.max("e").over(Window.partitionBy("row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))), F.lit(0))
    own = found.where("s is not null").withColumn("new", new).groupBy(F.col("row").alias("row_")).agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    out = _heads(found, keep).join(own, F.col("row") == F.col("row_"), "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    out = mark(docs, benchmark, most=most)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The definition, without fingerprints: every window of the items against every window of its length.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select coalesce(item_id::varchar, '') as item_id, {_WORDS} as w from benchmark),
l as (select distinct least(len(w), {SPAN}) as n from b where len(w) > 0),
i as (select distinct item_id, least(len(w), {SPAN}) as n, array_to_string(w[s:s + least(len(w), {SPAN}) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(w) - {SPAN}, 0) + 2)) as s from b where len(w) > 0)),
g as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, l where len(w) >= n)),
h as (select r, s, g.n, item_id from g join i on g.g = i.g and g.n = i.n),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from h) group by r),
t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join t using (r)"""
