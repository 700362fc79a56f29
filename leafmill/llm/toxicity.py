"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are interpolated down to continuation counts of all documents, which
both share, so that a rare word of one class differs from the other only by what its class has shown. A word's evidence
is the difference of its two log-likelihoods, once after the word before it and once alone (the lower order: pairs are rarer and
vary more). Either evidence is normalised by length over the strongest word, the ``TOP`` strongest words, the strongest window of
``WINDOW`` words and the text; a logistic curve over these eight, fitted across two folds, gives the score.

Class counts are of texts: each text counts once for a word and once for each different pair of words. Labels come from at most ``max_docs`` labelled rows of each class (lowest hash of doc_id first), equal texts once.
The rates at which the classes were sampled are taken out of the logistic constant, so that a score means the same at every size.
Each model keeps every word and pair of at least ``LEAST`` texts of a class, with its counts in both classes; their number is bounded by the labelled rows alone. The shared counts cover every document: for each word of the model
and for all words together, the different pairs with the word before, estimated by HyperLogLog (9 % and 1 % of standard error at any size).

Null and empty texts have no evidence and get the score of none. Rows are scored by their text alone; repeated rows alike.
A label table without one of the classes gives every text the share of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import hashed

DISCOUNT, WINDOW, TOP, FEATURES, LEAST = 0.75, 8, 4, 8, 4
#: Registers of a word and of all words; words of a message; registers a task holds before it sends them.
REGISTERS, ALL, CHUNK, HELD = 1 << 7, 1 << 14, 512, 2_000_000
#: Bytes of texts that are taken apart at once.
GROUP = 1_000_000


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 3


def distinct_of(registers: np.ndarray) -> np.ndarray:
    """HyperLogLog estimates, one for each row of registers."""
    m = registers.shape[1]
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(np.float64)).sum(axis=1)
    empty = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def shared_continuations(docs: DataFrame, keys: np.ndarray, text: str = "text") -> tuple[np.ndarray, float]:
    """For each of the sorted hashes of words an estimate of the different words before it, over all documents; the sum of these over all words there are."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)  # 8 bytes a word of the model
    size = CHUNK * REGISTERS

    def joined(places: np.ndarray) -> np.ndarray:
        """The highest rank of each register, from sorted or unsorted register * 64 + rank."""
        places = np.sort(places)
        return places[np.append(places[1:] >> 6 != places[:-1] >> 6, True)] if len(places) else places

    def messages(places: np.ndarray, keys_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        chunk = (places >> 6) // size
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))  # none where no word of the model was met
        for cut, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = np.zeros(min(size, len(keys_of) * REGISTERS - int(chunk[cut]) * size), np.uint8)
            part[(places[cut:end] >> 6) % size] = places[cut:end] & 63
            yield _message(int(chunk[cut]), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        # registers that have been met: what a task holds follows its texts, not the model
        seen, fresh, every = np.empty(0, np.int64), [], np.zeros(ALL, np.uint8)
        for batch in batches:
            texts = common.values(batch.column(0))
            for begin, stop in common.groups_of([len(t) for t in texts], GROUP):
                h, offsets = hashed(texts[begin:stop])
                before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
                before = before.copy()
                before[offsets[:-1][offsets[:-1] < len(h)]] = 0
                code = np.unique(_pair(before, h), return_index=True)
                code, h = code[0], h[code[1]]
                # low bits choose the register, the others give the rank of their lowest one
                high = code >> np.uint64(14)
                rank = np.frexp((high & (~high + np.uint64(1))).astype(np.float64))[1].astype(np.uint8)
                rank[high == 0] = 51
                np.maximum.at(every, (code % np.uint64(ALL)).astype(np.int64), rank)
                at, known = _find(own, h)
                places = (at[known] * REGISTERS + (code[known] % np.uint64(REGISTERS)).astype(np.int64)) * 64 + rank[known]
                fresh.append(joined(places))
                if sum(map(len, fresh)) > HELD // 2:
                    seen, fresh = joined(np.concatenate([seen, *fresh])), []
                    if len(seen) > HELD:
                        yield from messages(seen, own)
                        seen = np.empty(0, np.int64)
            common.release()
        yield from messages(joined(np.concatenate([seen, *fresh])), own)
        if every.any():
            yield _message(-1, every)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                most[i] = np.maximum(most[i], part) if i in most else part
        for i, part in most.items():
            n = distinct_of(part.reshape(-1, ALL if i < 0 else REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + i * CHUNK if i >= 0 else [-1], pa.int64()), pa.array(n)], ["at", "n"])

    rows = docs.select(common.text_bytes(text).alias("text")).mapInArrow(run, "chunk int, registers binary")
    found = rows.repartition("chunk").mapInArrow(merge, "at long, n double").toArrow().to_pandas()  # at most a row for each key
    at, n = found["at"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    out = np.zeros(len(keys))
    out[at[at >= 0]] = n[at >= 0]
    return out, float(n[at < 0].sum())


def _message(chunk: int, registers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(registers.tobytes(), 1)], pa.binary())], ["chunk", "registers"])


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y and fold of all rows that may be learned from."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return one.withColumn("fold", fold()).where("fold <> 1")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """fold, label and text of a bounded sample of the rows that may be learned from."""
    one = labelled(labels, label).withColumn("h", F.xxhash64("doc_id"))
    sample = one.where("y = 1").orderBy("h", "doc_id").limit(max_docs).unionByName(one.where("y = 0").orderBy("h", "doc_id").limit(max_docs))
    # at most 2 * max_docs ids
    rows = docs.select("doc_id", common.text_bytes().alias("text")).join(F.broadcast(sample.select("doc_id", "y", "fold")), "doc_id")
    return rows.select("y", "fold", F.coalesce("text", F.lit(b"")).alias("text"))


def class_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By fold and class: of words n, precedes (different words before) and begins (pairs with a word behind it); of pairs n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, folds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.values(batch.column(2))
            for begin, stop in common.groups_of([len(t) for t in texts], GROUP):
                h, offsets = hashed(texts[begin:stop])
                own = np.repeat(np.array(ys[begin:stop]) * 4 + np.array(folds[begin:stop]), np.diff(offsets))
                before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
                before = before.copy()
                before[offsets[:-1][offsets[:-1] < len(h)]] = 0
                # a text speaks once for a word and once for a pair: repetition within a text isn't evidence of a class
                text = np.repeat(np.arange(stop - begin), np.diff(offsets))
                places = pd.DataFrame({"own": own, "word": h.view(np.int64), "before": before.view(np.int64), "text": text}).drop_duplicates(["text", "before", "word"])
                pair = places.groupby(["own", "word", "before"], sort=False).size().reset_index(name="n")
                alone = places.drop_duplicates(["text", "word"]).groupby(["own", "word"], sort=False).size().reset_index(name="n")
                for frame, of in ((pair, pa.array(pair.before, pa.int64())), (alone, pa.nulls(len(alone), pa.int64()))):
                    yield pa.RecordBatch.from_arrays([pa.array(frame.own // 4, pa.int32()), pa.array(frame.own % 4, pa.int32()), pa.array(frame.word, pa.int64()), of, pa.array(frame.n, pa.int64())], ["y", "fold", "word", "before", "n"])
            common.release()

    distinct = rows.groupBy("y", "fold", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("y", "fold", "text")
    # before is null in the counts of words alone
    both = common.stage(distinct.mapInArrow(run, "y int, fold int, word long, before long, n long").groupBy("y", "fold", "word", "before").agg(F.sum("n").alias("n")), "pairs")
    pair = both.where("before is not null")
    zero = F.lit(0).cast("long")
    one = both.select("y", "fold", F.col("word").alias("hash"), F.when(F.col("before").isNull(), F.col("n")).otherwise(zero).alias("n"), F.col("before").isNotNull().cast("long").alias("precedes"), zero.alias("begins"))
    one = one.unionByName(pair.where("before <> 0").select("y", "fold", F.col("before").alias("hash"), zero.alias("n"), zero.alias("precedes"), F.col("n").alias("begins")))
    words = one.groupBy("y", "fold", "hash").agg(*[F.sum(c).alias(c) for c in ("n", "precedes", "begins")])
    return words, pair


class Model:
    """Evidence of words and pairs: sorted keys with the class counts, and the shared continuation counts."""

    def __init__(self, words: pd.DataFrame, both: pd.DataFrame, totals: dict[int, float], shared: tuple[np.ndarray, np.ndarray, float]):
        self.totals = totals
        self.keys = np.sort(words.hash.unique().view(np.uint64)) if len(words) else np.empty(0, np.uint64)
        # a word that the model doesn't hold has the same share in both classes, which cancels out
        every, continued, total = shared
        self.none = 0.5 / (total + 0.5 * (len(every) + 1))
        at = np.searchsorted(every, self.keys)
        self.base = self.none * (2 * continued[at] + 1)
        n, self.precedes, self.begins = (np.zeros((2, len(self.keys))) for _ in range(3))
        y, at = words.y.to_numpy(int), np.searchsorted(self.keys, words.hash.to_numpy(np.int64).view(np.uint64))
        for table, column in ((n, words.n), (self.precedes, words.precedes), (self.begins, words.begins)):
            np.add.at(table, (y, at), column.to_numpy(float))
        # a word of fewer than LEAST texts of either class leaves its mass to the counts that both classes share; any other has its
        # counts in both, as four texts against three are no evidence and four against none are
        self.precedes = np.where(n.max(axis=0) >= LEAST, np.maximum(self.precedes - DISCOUNT, 0), 0)
        before, word = (both[c].to_numpy(np.int64).view(np.uint64) for c in ("before", "word"))
        code, y = _pair(before, word), both.y.to_numpy(int)
        self.pairs, first, back = np.unique(code, return_index=True, return_inverse=True)
        n = np.zeros((2, len(self.pairs)))
        np.add.at(n, (y, back), both.n.to_numpy(float))
        self.pair_n = np.where(n.max(axis=0) >= LEAST, np.maximum(n - DISCOUNT, 0), 0)
        self.rest = self.begins.copy()
        at, known = _find(self.keys, before[first])
        for c in (0, 1):
            np.subtract.at(self.rest[c], at[known], self.pair_n[c][known])

    def log_ratios(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | word before, toxic) - log P(word | word before, ordinary) at each place, and the same of the word alone."""
        if not len(self.keys):
            return np.zeros(len(h)), np.zeros(len(h))
        own, back = np.unique(h, return_inverse=True)
        at, known = _find(self.keys, own)
        base = np.where(known, self.base[at], self.none)
        before = np.concatenate([[-1], back[:-1]])
        before[starts] = -1
        code = np.where(before >= 0, _pair(own[before], h), np.uint64(0))
        pair_at, pair_known = _find(self.pairs, code)
        out, alone = [], []
        for y in (0, 1):
            continued = max(self.totals[y], 1.0)
            low = np.where(known, self.precedes[y][at], 0) / continued + max(1 - self.precedes[y].sum() / continued, 1e-3) * base
            begins, rest = np.where(known, self.begins[y][at], 0)[before], np.where(known, self.rest[y][at], 0)[before]
            seen = (before >= 0) & (begins > 0)
            begins = np.maximum(begins, 1)
            high = np.where(pair_known, self.pair_n[y][pair_at], 0) if len(self.pairs) else np.zeros(len(h))
            out.append(np.log(np.where(seen, np.minimum(high / begins, 1), 0) + np.where(seen, np.clip(rest / begins, 1e-3, 1), 1) * low[back]))
            alone.append(np.log(low))
        return out[1] - out[0], (alone[1] - alone[0])[back]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text the evidence per word of its strongest word, its ``TOP`` strongest words, its strongest window and all of it: after the words before, then of words alone."""
        out = np.zeros((len(texts), FEATURES))
        for begin, stop in common.groups_of([len(t) for t in texts], GROUP):
            h, offsets = hashed(texts[begin:stop])
            if not len(h):
                continue
            ratios = self.log_ratios(h, offsets[:-1][offsets[:-1] < len(h)])
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            rows, first = begin + full, offsets[:-1][full]
            own = np.repeat(np.arange(len(size)), size)
            ends = np.arange(1, len(h) + 1)
            for k, ratio in zip((0, FEATURES // 2), ratios, strict=True):
                total = np.concatenate([[0.0], np.cumsum(ratio)])
                by = np.lexsort((-ratio, own))  # strongest first within each text
                ranked = np.concatenate([[0.0], np.cumsum(ratio[by])])
                out[rows, k] = ratio[by][first]
                out[rows, k + 1] = (ranked[np.minimum(first + TOP, offsets[1:][full])] - ranked[first]) / TOP
                # windows end at every word and begin at most WINDOW words before, within the text
                window = (total[ends] - total[np.maximum(ends - WINDOW, offsets[:-1][own])]) / WINDOW
                out[rows, k + 2] = np.maximum.reduceat(window, first)
                out[rows, k + 3] = (total[offsets[1:]] - total[offsets[:-1]])[full] / size[full]
        return out


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant first) by Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, model: Model | None, weights: np.ndarray, share: float):
        self.model, self.weights, self.share = model, weights, share

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.share)
        x = self.model.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 10_000) -> Scorer:
    rows = common.stage(training_rows(docs, labels, label, max_docs), "training")
    found = {(r.y, r.fold): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    n = [sum(v for (y, _), v in found.items() if y == c) for c in (0, 1)]
    labels_of = {r.y: r["count"] for r in labelled(labels, label).groupBy("y").count().collect()}
    rate = [min(1.0, max(1, max_docs) / max(1, labels_of.get(c, 0))) for c in (0, 1)]
    share = n[1] / rate[1] / max(1, n[0] / rate[0] + n[1] / rate[1])
    if not all(n):
        return Scorer(None, np.zeros(1 + FEATURES), share)
    words, both = class_counts(rows)
    words = common.stage(words, "words")
    sums = words.groupBy("y", "fold").agg(F.sum("precedes").alias("continued")).collect()

    def frequent(df: DataFrame, keys: list[str]) -> pd.DataFrame:
        # a term of fewer than LEAST texts of either class has no part in the model; others have their counts in both
        most = F.greatest(*[F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)) for y in (0, 1)])
        shown = df.groupBy(*keys).agg(most.alias("most")).where(F.col("most") >= LEAST).drop("most")
        # Arrow columns: rows as Python objects would take a kilobyte each; at most two rows a term and class
        return df.join(common.stage(shown, "terms"), keys).toArrow().to_pandas()

    words_kept, pairs_kept = frequent(words, ["hash"]), frequent(both, ["word", "before"])

    keys = np.sort(words_kept.hash.unique().view(np.uint64)) if len(words_kept) else np.empty(0, np.uint64)
    shared = (keys, *shared_continuations(docs, keys))

    def model(folds: tuple[int, ...]) -> Model:
        totals = {y: float(sum(s.continued for s in sums if s.y == y and s.fold in folds)) for y in (0, 1)}
        return Model(words_kept[words_kept.fold.isin(folds)], pairs_kept[pairs_kept.fold.isin(folds)], totals, shared)

    # each fold is scored by the model of the other, to learn what evidence means for unseen texts
    folds = {0: 2, 2: 0}
    across = {f: model((o,)) for f, o in folds.items()} if all(found.get((y, f)) for y in (0, 1) for f in folds) else dict.fromkeys(folds, model((0, 2)))

    names = [f"x{i}" for i in range(FEATURES)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, fs, texts = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist()), common.values(batch.column(2))
            x = np.zeros((len(texts), FEATURES))
            for f, own in across.items():
                at = np.flatnonzero(fs == f)
                x[at] = own.features([texts[i] for i in at])
            common.release()
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), *(pa.array(c) for c in x.T)], ["y", *names])

    seen = rows.mapInArrow(features, ", ".join(["y int", *(f"{c} double" for c in names)])).toArrow().to_pandas().sort_values(["y", *names])  # at most 2 * max_docs rows
    x, y = seen[names].to_numpy(), seen.y.to_numpy(float)
    weights = logistic(x, y)
    weights[0] -= np.log(rate[1] / rate[0])
    return Scorer(model((0, 2)), weights, share)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1, higher: label 1 likelier), which takes the place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # as large as the labelled rows make it

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for t in texts:
            yield pd.Series(own([x or b"" for x in t]))
            common.release()

    return docs.withColumn(name, run(common.text_bytes(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", (fold() == 1).alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


