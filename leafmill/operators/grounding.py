"""Gates on what a model has written: statements must name labels that are there, a rewrite must keep anchors and words."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import markdown as M

#: Fixed value: the line of a page break.
PAGE_BREAK = '<div style="page-break-after: always; break-after: page;"></div>'
#: Signs of a gram; entries of the index that are broadcast at most, and parts of a gram's candidates beyond.
GRAM, MOST, SALTS = 4, 200_000, 16
#: How a text and a label may meet: the label is inside the text, the text within the label, or both are short and equal.
INSIDE, WITHIN, WHOLE = range(3)


def grounded(candidate: Column, labels: Column) -> Column:
    """Whether any label matches: equal keys, or one within the other."""
    return F.exists(labels, lambda x: T.labels_match(candidate, x))


def statements(replies: DataFrame, key: str = "reply_id") -> DataFrame:
    """Lines ``A | relation | B`` of replies (key, reply, labels) whose three parts are all grounded, each once in first order: key, nth, a, relation, b.
    What stands behind the line that begins with the marker is prose: column meaning."""
    rows = replies.select(key, "labels", F.posexplode_outer(T.lines(F.col("reply"))).alias("n", "line")).withColumn("line", T.strip(F.col("line")))
    marker = rf"(?i)^meaning[{T.WHITE}]*[:\x{{ff1a}}]?[{T.WHITE}]*"
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_marker", F.col("line").rlike(marker)).withColumn("prose", F.max("is_marker").over(upto))
    parts = F.transform(F.split("line", r"\|"), T.strip)
    rows = rows.withColumn("parts", parts)
    whole = (F.size("parts") == 3) & F.forall("parts", lambda p: (p != "") & grounded(p, F.col("labels")))
    kept = rows.where(~F.col("prose") & whole).groupBy(key, "parts").agg(F.min("n").alias("n"))
    kept = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "parts"))), lambda x: x["parts"]).alias("triples"))
    line = F.when(F.col("is_marker"), T.strip(F.regexp_replace("line", marker, ""))).otherwise(F.col("line"))
    prose = F.array_sort(F.collect_list(F.when(F.col("prose") & (line != ""), F.struct("n", line.alias("line")))))
    meaning = rows.groupBy(key).agg(F.array_join(F.transform(prose, lambda x: x["line"]), " ").alias("meaning"))
    return meaning.join(kept, key, "left").withColumn("triples", F.coalesce("triples", F.array().cast("array<array<string>>")))


def rendered(triples: Column, meaning: Column) -> Column:
    lines = F.transform(triples, lambda t: F.concat(F.lit("- `"), t[0], F.lit("` —`"), t[1], F.lit("`→ `"), t[2], F.lit("`")))
    tail = F.when(meaning != "", F.array(F.lit(""), F.lit("**Meaning:**"), F.lit(""), meaning)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("**Relationships:**"), F.lit("")), lines, tail), "\n")


def peeled(md: Column) -> tuple[Column, Column]:
    """A slide's lines before its last page break, and from it on, both without blank lines at the end."""
    lines = F.split(md, "\n")
    bare = lambda a: F.slice(a, F.lit(1), F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.when(T.strip(F.get(a, i - 1)) != "", i).otherwise(0))), F.lit(0)))
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.when(T.strip(F.get(lines, i - 1)) == PAGE_BREAK, i).otherwise(0)))
    none = F.array().cast("array<string>")
    return F.when(last > 0, bare(F.slice(lines, F.lit(1), last - 1))).otherwise(lines), F.when(last > 0, bare(F.slice(lines, last, F.size(lines)))).otherwise(none)


def rewrite_gate(slides: DataFrame) -> DataFrame:
    """Slides (md, rewritten) with body, trailer, eligible, lost anchors, omitted and added words (at most five named), accepted, and the result."""
    body, trailer = peeled(F.col("md"))
    out = slides.withColumns({"body": body, "trailer": trailer})
    out = out.withColumn("eligible", F.exists("body", lambda x: (T.strip(x) != "") & ~M.is_structural(x)))
    anchors = F.transform(F.filter("body", M.is_structural), T.strip)
    out = out.withColumn("lost", F.size(F.array_except(anchors, F.transform(F.split("rewritten", "\n"), T.strip))))
    before, after = T.content_words(F.array_join("body", "\n")), T.content_words(F.col("rewritten"))
    five = lambda a: F.slice(F.array_sort(a), 1, 5)
    out = out.withColumns({"omitted": five(F.array_except(before, after)), "added": five(F.array_except(after, before))})
    out = out.withColumn("accepted", F.col("eligible") & (F.col("lost") == 0) & (F.size("omitted") == 0) & (F.size("added") == 0))
    new = F.concat(T.strip(F.col("rewritten")), F.when(F.size("trailer") > 0, F.concat(F.lit("\n\n"), F.array_join("trailer", "\n"))).otherwise(""))
    return out.withColumn("result", F.when(F.col("accepted"), new).otherwise(F.col("md")))


def _coded(text: np.ndarray, width: int) -> np.ndarray:
    """64-bit codes of the runs of ``width`` signs that begin at each place of a text of code points."""
    codes = np.full(max(len(text) - width + 1, 0), width, np.uint64)
    for i in range(width):
        codes = (codes ^ text[i : i + len(codes)]) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(29)
    return codes


def _coded_grams(rows: DataFrame, column: str, widths: tuple[int, ...], allowed: dict[int, np.ndarray] | None = None) -> DataFrame:
    """rows with kind and g, once for each: INSIDE for every gram of these widths, WITHIN for the gram of the smallest code, WHOLE for a text shorter than a gram.
    Only codes that ``allowed`` (sorted, by kind) holds are given where it is known. A text of any length is held by itself, others some millions of signs at a time."""
    held = rows.sparkSession.sparkContext.broadcast(allowed)
    names, at = rows.columns, rows.columns.index(column)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def kept(kind: int, row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are allowed, each once for each row."""
        if held.value is not None:
            known = np.append(held.value[kind], np.uint64(0))  # one more, so that every place is one of the array
            met = np.searchsorted(known[:-1], codes)
            hit = (known[met] == codes) & (met < len(known) - 1)
            row, codes = row[hit], codes[hit]
        by = np.lexsort((codes, row))
        row, codes = row[by], codes[by]
        first = np.append(True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1]))[: len(row)]
        return row[first], codes[first]

    def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        row, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(ends, sizes) - np.arange(len(signs))
        long = sizes >= GRAM
        for width in widths:
            codes = _coded(signs, width)
            whole = (left[: len(codes)] >= width) & long[row[: len(codes)]]
            yield INSIDE, row[: len(codes)][whole], codes[whole]
            if width == GRAM and long.any():
                least = np.minimum.reduceat(np.where(whole, codes, np.iinfo(np.uint64).max), (ends - sizes)[long])
                yield WITHIN, np.flatnonzero(long), least
        for width in range(1, GRAM):
            own = np.flatnonzero(sizes == width)
            yield WHOLE, own, _coded(signs, width)[(ends - sizes)[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            stops = np.cumsum([len(t) for t in texts]) // 1_000_000
            for begin, stop in itertools.pairwise([*np.flatnonzero(np.diff(stops, prepend=-1)).tolist(), len(texts)]):
                for kind, row, codes in grams(texts[begin:stop]):
                    row, codes = kept(kind, row, codes)
                    if len(row):
                        columns = [c.take(pa.array(row + begin)) for c in batch.columns]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), kind, np.int32)), pa.array(codes.view(np.int64))], [*names, "kind", "g"])

    return rows.mapInArrow(run, ", ".join([*fields, "kind int", "g long"]))


def _index(held: DataFrame, key: str) -> DataFrame:
    """Entries (key, kind, g, k) of labels: each under its gram that fewest labels have, under all its grams, and a short one under itself, for longer and for equal texts."""
    coded = _coded_grams(held, "k", (GRAM,))
    grams = coded.where(F.col("kind") == INSIDE)
    common = grams.groupBy(key, "g").agg(F.count("*").alias("n"))
    rarest = grams.join(common, [key, "g"]).groupBy(key, "k").agg(F.min_by("g", F.struct("n", "g")).alias("g")).select(key, F.lit(INSIDE).alias("kind"), "g", "k")
    short = coded.where(F.col("kind") == WHOLE)
    rest = grams.withColumn("kind", F.lit(WITHIN)).unionByName(short).unionByName(short.withColumn("kind", F.lit(INSIDE)))
    return rarest.unionByName(rest.select(key, "kind", "g", "k"))


def label_pairs(candidates: DataFrame, labels: DataFrame, key: str, id: str = "id", most: int = MOST) -> DataFrame:
    """The rows of candidates (id, key, text) that a label (key, label) of the same key grounds: key and id, once for each id.

    Both sides are normalised once, and an index of grams of the labels names the pairs that may match: a label within a candidate stands under the one of its
    grams of four signs that fewest labels have (shorter labels under themselves) and meets every gram of a candidate; a candidate within a label meets all grams
    of the labels by one gram of its own; texts of fewer signs meet their equals. Grams are named by codes, and what meets is compared as text. An index of up to ``most``
    entries is broadcast, and grams that it doesn't hold aren't given out; a larger one is joined by key and gram, salted. Null and blank texts match nothing.
    """
    # a condition on a key itself would make each key twice
    held = labels.where(T.bare_label(F.col("label")) != "").select(key, T.label_key(F.col("label")).alias("k")).distinct()
    asked = candidates.where(T.bare_label(F.col("text")) != "").select(F.col(id).alias("id"), key, T.label_key(F.col("text")).alias("c"))
    texts = asked.select(key, "c").distinct()
    index = _index(held, key).withColumnsRenamed({key: "key_", "kind": "kind_", "g": "g_"})
    small = index.count() <= most
    allowed = None
    if small:
        codes = index.select("kind_", "g_").distinct().toArrow()  # at most ``most``
        kinds, own = codes.column(0).to_numpy(), codes.column(1).to_numpy().view(np.uint64)
        allowed = {kind: np.sort(own[kinds == kind]) for kind in (INSIDE, WITHIN, WHOLE)}
    widths = sorted(r[0] for r in held.select(F.length("k").alias("n")).where(F.col("n") < GRAM).distinct().collect())  # three at most
    asks = _coded_grams(texts, "c", (GRAM, *widths), allowed)
    same = (F.col(key) == F.col("key_")) & (F.col("kind") == F.col("kind_")) & (F.col("g") == F.col("g_"))
    if small:
        met = asks.join(F.broadcast(index), same)
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asks.join(salted, same & (F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int") == F.col("salt")))
    matches = F.when(F.col("kind") == INSIDE, F.col("c").contains(F.col("k"))).when(F.col("kind") == WITHIN, F.col("k").contains(F.col("c"))).otherwise(F.col("c") == F.col("k"))
    return asked.join(met.where(matches).select(key, "c").distinct(), [key, "c"], "left_semi").select(key, "id").distinct()
