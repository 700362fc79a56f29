"""Hard negatives by dual-tree search: trees over anchors and over all rows, inner products bounded for pairs of nodes.

Rows are ordered by label and by the leaf of a top tree (fitted to at most ``SAMPLE`` rows, each node cuts along the direction in which its rows spread
most) and dealt by ranges into slices of about ``SLICE`` rows. A slice is a tree of its own: halves along the component that varies most, down to leaves
of ``LEAF`` rows, one row of the written index each, with centre, radius, labels and vectors. Anchors have a tree likewise, in
leaves of ``BLOCK``.

A search sends every leaf of anchors first to the one slice with the nearest centre, whose results give each anchor the score it has to reach
(the k-th so far), and then to every slice whose interval of inner products (centre product plus or minus what the two radii can add) reaches
the least of those and isn't above all bounds; the whole leaf of anchors is left out elsewhere. In a slice the pair of trees is descended the
same way, from the node with the highest bound, and rows of leaf pairs that remain are scored exactly by one product of matrices for the anchors that can
still gain. A task reads a slice's index once and lets the leaves of anchors pass. Positives are the k nearest of the same label; negatives are searched with
one interval of scores for each anchor and positive, all in the same descent.

Vectors are whole numbers in 64-bit floats; where norms allow sums beyond 2^53, products are taken with Python's integers, and scores are held within
2^59 either way, components within 2^300. Vectors of several lengths: missing components count 0. Rows with a null id, label or vector or any component null or not finite take no part. Ties
go to the smaller id; rows with equal ids or vectors are rows of their own. Anchors without rows of their label have no positives and none of the results.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, SLICE, LEAF, BLOCK = 4096, 4096, 128, 64
#: Slices at most (a slice grows beyond), so that what is told of all slices stays small; depth of the top tree.
SLICES, DEPTH = 8192, 8
_FAR = 1 << 59
_NODE = "slice int, part int, size int, centre array<double>, radius double, labels array<long>, ids array<long>, rows array<long>, dims int, vectors binary"


def usable(rows: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label, v (whole numbers, as doubles) of the rows that take part."""
    x = F.col("x")
    rows = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.lit(2.0**300)
    # floor() of Spark gives 64-bit integers; beyond 2^52 a double is whole anyway
    return rows.where(finite).withColumn("v", F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(F.greatest(F.least(c * scale, far), -far)))).drop("x")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled with zeros to the longest."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x[:, :dims] if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _spread(x: np.ndarray) -> np.ndarray:
    """The direction in which rows vary most, by a few steps of power iteration."""
    x = x - x.mean(0)
    d = x[np.argmax((x * x).sum(1))] if len(x) else np.zeros(x.shape[1])
    for _ in range(8):
        d = x.T @ (x @ d)
        n = math.sqrt(d @ d)
        if not n:
            return np.zeros(x.shape[1])
        d /= n
    return d


class TopTree:
    """A complete binary tree over a sample; ``cell`` gives the leaf of any row, counted from the left."""

    def __init__(self, sample: np.ndarray, depth: int = DEPTH):
        sample = sample[:, :256]  # it only orders rows
        self.depth, self.dims = depth, sample.shape[1]
        self.along, self.cut = np.zeros((2**depth - 1, self.dims)), np.zeros(2**depth - 1)
        self.unit = max(1.0, float(np.abs(sample).max(initial=0)))
        held = {0: sample / self.unit}
        for node in range(2**depth - 1):
            x = held.pop(node)
            d = _spread(x) if len(x) > 1 else np.zeros(self.dims)
            p = x @ d
            self.along[node], self.cut[node] = d, np.median(p) if len(p) else 0.0
            right = p > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]

    def cell(self, x: np.ndarray) -> np.ndarray:
        x, node = _wide(x, self.dims) / self.unit, np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.along[node]).sum(1) > self.cut[node])
        return node - (2**self.depth - 1)


def _halves(x: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows ``at`` in runs of at most ``most``, halved along the component that varies most."""
    if len(at) <= most:
        return [at]
    own = x[at]
    order = at[np.argsort(own[:, np.argmax(own.var(0))] if own.shape[1] else np.arange(len(at)), kind="stable")]
    return _halves(x, order[: len(at) // 2], most) + _halves(x, order[len(at) // 2 :], most)


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1)).max(initial=0))


def pack(rows: DataFrame, tree: TopTree, slices: int, leaf: int, name: str) -> DataFrame:
    """The index of rows (row, id, label, v): a row for each leaf, in order of the slice's tree."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.cell(_matrix(b.column(3))).astype(np.int32))], ["row", "id", "label", "v", "cell"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # one slice, of a bounded size
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        x = _matrix(table.column("v").combine_chunks())
        row, ids, labels = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        runs = np.split(np.argsort(labels, kind="stable"), np.flatnonzero(np.diff(np.sort(labels))) + 1)
        if len(runs) * leaf > len(x):  # too few rows of a label for leaves of their own
            runs = [np.arange(len(x))]
        out = []
        for i, at in enumerate(p for run in runs for p in _halves(x, run, leaf)):
            centre, radius = _ball(x[at])
            out.append((TaskContext.get().partitionId(), i, len(at), centre, radius, labels[at], ids[at], row[at], x.shape[1], _thin(x[at])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    placed = rows.select("row", "id", "label", "v").mapInArrow(place, "row long, id long, label long, v array<double>, cell int")
    placed = common.stage(placed, f"{name}-cells")
    return common.stage(placed.repartitionByRange(slices, "label", "cell", "row").mapInArrow(leaves, _NODE), name)


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), *[pa.list_(pa.int64())] * 3, pa.int32(), pa.binary()]
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def _thin(x: np.ndarray) -> bytes:
    """A sign for the width, then the numbers as small as they fit."""
    small = float(np.abs(x).max(initial=0)) < 2**15
    return (b"s" + x.astype(np.int16).tobytes()) if small else b"d" + x.tobytes()


def _thick(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[:1] == b"s" else np.float64, offset=1).astype(np.float64).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, held within 2^59 either way."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if math.sqrt((a * a).sum(1).max(initial=0)) * math.sqrt((b * b).sum(1).max(initial=0)) < 2.0**52:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(v) for v in r] for r in x.tolist()] for x in (a, b)]
    return np.array([[max(-_FAR, min(_FAR, sum(map(int.__mul__, p, q)))) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


class Lanes:
    """What is sought for a leaf of anchors: for each lane its anchor, the interval of scores, the score to reach, and its k best so far."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.reach = np.maximum(reach, low)  # scores below it can't be among the k best
        self.found = tuple(np.empty(0, np.int64) for _ in range(4))  # lane, score, id, row

    def add(self, lane: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        lane, score, ids, rows = (np.concatenate(p) for p in zip(self.found, (lane, score, ids, rows), strict=True))
        order = np.lexsort((rows, ids, -score, lane))
        first = np.flatnonzero(np.diff(lane[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = order[nth == self.k - 1]
        self.reach[lane[last]] = np.maximum(self.reach[lane[last]], score[last])
        order = order[nth < self.k]
        self.found = lane[order], score[order], ids[order], rows[order]


class SliceTree:
    """A slice's leaves and the nodes above them; node 1 is the root, node i has the children 2 i and 2 i + 1."""

    def __init__(self, leaves: list[dict]):
        leaves = sorted(leaves, key=lambda x: x["part"])
        self.dims = dims = max(x["dims"] for x in leaves)
        self.leaves = [(_thick(x["vectors"], x["dims"]), *(np.array(x[c], np.int64) for c in ("labels", "ids", "rows"))) for x in leaves]
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        n = 2 * self.base
        self.centre, self.radius, self.size = np.zeros((n, dims)), np.zeros(n), np.zeros(n, np.int64)
        #: labels of a node, two where it has more
        self.only: list[set[int]] = [set() for _ in range(n)]
        for i, x in enumerate(leaves, self.base):
            self.centre[i] = _wide(np.array([x["centre"]]), dims)[0]
            self.radius[i], self.size[i], self.only[i] = x["radius"], x["size"], set(sorted(set(x["labels"]))[:2])
        for i in range(self.base - 1, 0, -1):
            l, r = 2 * i, 2 * i + 1
            self.size[i] = self.size[l] + self.size[r]
            self.only[i] = set(sorted(self.only[l] | self.only[r])[:2])
            if self.size[i]:
                self.centre[i] = (self.centre[l] * self.size[l] + self.centre[r] * self.size[r]) / self.size[i]
                self.radius[i] = max(math.sqrt(((self.centre[c] - self.centre[i]) ** 2).sum()) + self.radius[c] for c in (l, r) if self.size[c])
        self.norm = np.sqrt((self.centre**2).sum(1))

    def search(self, x: np.ndarray, labels: np.ndarray, rows: np.ndarray, lanes: Lanes, same: bool) -> None:
        """Fill ``lanes`` from this slice for anchors x, which are one leaf of their tree."""
        x = _wide(x, self.dims)
        centre, radius = _ball(x)
        size = math.sqrt(centre @ centre)
        lengths = np.sqrt((x * x).sum(1))
        kinds = set(labels.tolist())

        def bound(node: int) -> tuple[float, float]:
            mid = float(self.centre[node] @ centre)
            add = radius * self.norm[node] + size * self.radius[node] + radius * self.radius[node]
            add += 1e-9 * (abs(mid) + add) + 1e-6
            return mid + add, mid - add

        def fits(node: int) -> bool:
            if not self.size[node]:
                return False
            own = self.only[node]
            if same and len(own) == 1 and not own & kinds or not same and len(own) == 1 and own == kinds:
                return False
            high, low = bound(node)
            return bool(((lanes.reach <= high) & (lanes.high >= low)).any())

        heap = [1] if fits(1) else []
        while heap:
            node = heap.pop()
            if not fits(node):  # scores to reach have risen since
                continue
            if node < self.base:
                heap += sorted((c for c in (2 * node, 2 * node + 1) if fits(c)), key=lambda c: bound(c)[0])
                continue
            vectors, other, ids, own = self.leaves[node - self.base]
            # single anchors against the leaf's ball
            mid = x @ self.centre[node]
            add = lengths * self.radius[node]
            add += 1e-9 * (np.abs(mid) + add) + 1e-6
            can = (lanes.reach <= (mid + add)[lanes.anchor]) & (lanes.high >= (mid - add)[lanes.anchor])
            if not can.any():
                continue
            lane = np.flatnonzero(can)
            anchors, back = np.unique(lanes.anchor[lane], return_inverse=True)
            scores = products(x[anchors], vectors)
            allowed = (labels[anchors][:, None] == other) == same
            allowed &= rows[anchors][:, None] != own
            for begin in range(0, len(lane), 64):
                part, at = lane[begin : begin + 64], back[begin : begin + 64]
                s = scores[at]
                ok = allowed[at] & (s >= lanes.reach[part][:, None]) & (s <= lanes.high[part][:, None])
                i, j = np.nonzero(ok)
                if len(i):
                    lanes.add(part[i], s[i, j], ids[j], own[j])


def _route(blocks: DataFrame, tops: list[dict], home: bool, same: bool) -> DataFrame:
    """Each leaf of anchors once for each slice that it has to be searched in. ``tops``: root of each slice."""
    session = blocks.sparkSession
    tree = session.sparkContext.broadcast(tops)
    schema = blocks.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = tree.value
        dims = max((len(t["centre"]) for t in tops), default=0)
        centres = np.array([np.pad(t["centre"], (0, dims - len(t["centre"]))) for t in tops]).reshape(len(tops), dims)
        norms, radii = np.sqrt((centres**2).sum(1)), np.array([t["radius"] for t in tops])
        for b in batches:
            out = []
            for r in (r for r in b.to_pylist() if r["anchor"]):
                centre = _wide(np.array([r["centre"]]), dims)[0]
                kinds = set(r["labels"])
                lacks = np.array([bool(t["only"]) and (not set(t["only"]) & kinds if same else kinds == set(t["only"])) for t in tops], bool)
                mid = centres @ centre
                if home:
                    near = np.where(lacks, -np.inf, mid)
                    to = [int(near.argmax())] if len(near) and near.max() > -np.inf else []
                else:
                    add = r["radius"] * norms + math.sqrt(centre @ centre) * radii + r["radius"] * radii
                    add += 1e-9 * (np.abs(mid) + add) + 1e-6
                    to = np.flatnonzero(~lacks & (mid + add >= min(r["reach"])) & (mid - add <= max(r["high"])))
                    to = [int(t) for t in to if tops[t]["slice"] != r["home"]]
                out += [r | {"to": tops[t]["slice"]} for t in to]
            if out:
                yield pa.RecordBatch.from_pylist(out, b.schema)

    return blocks.mapInArrow(run, schema)


_FOUND = "slice int, part int, lane int, score long, id long, row long, to int"


def _search(index: DataFrame, blocks: DataFrame, k: int, same: bool, slices: int) -> DataFrame:
    """slice, part (of the anchors), lane, score, id, row, to: the k best of each lane in each slice that its leaf was sent to."""
    leaves = index.select(F.lit(0).alias("kind"), F.col("slice").alias("to"), *_NAMES)
    sought = blocks.select(F.lit(1).alias("kind"), "to", *_NAMES, "anchor", "low", "high", "reach")
    both = leaves.unionByName(sought, allowMissingColumns=True).repartition(slices, "to").sortWithinPartitions("to", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        tree, at = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["to"] != at:
                    held, tree, at = [], None, r["to"]
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if tree is None:
                    tree = SliceTree(held)
                lanes = Lanes(*(np.array(r[c], np.int64) for c in ("anchor", "low", "high", "reach")), k)
                tree.search(_thick(r["vectors"], r["dims"]), np.array(r["labels"], np.int64), np.array(r["rows"], np.int64), lanes, same)
                n = len(lanes.found[0])
                if n:
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(n, r["slice"], np.int32)), pa.array(np.full(n, r["part"], np.int32)), pa.array(lanes.found[0].astype(np.int32)), *map(pa.array, lanes.found[1:]), pa.array(np.full(n, at, np.int32))], [f.split()[0] for f in _FOUND.split(", ")]))
            yield from out

    return both.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("slice", "part", "lane").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _two_rounds(index: DataFrame, blocks: DataFrame, tops: list[dict], k: int, same: bool, slices: int, name: str) -> DataFrame:
    """The k best of every lane: the nearest slice first, then all that can still add to a lane."""
    first = common.stage(_search(index, _route(blocks, tops, True, same), k, same, slices), f"{name}-near")
    reach = first.groupBy("slice", "part", "lane").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.first("to").alias("to"))
    reach = reach.groupBy(F.col("slice").alias("s"), F.col("part").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("lane", F.when(F.col("n") == k, F.col("least"))))).alias("reached"), F.first("to").alias("near"))
    again = blocks.join(reach, (F.col("slice") == F.col("s")) & (F.col("part") == F.col("p")), "left")
    raised = F.transform("reach", lambda r, i: F.greatest(r, F.coalesce(F.try_element_at("reached", i), r)))
    again = again.withColumn("reach", raised).withColumn("home", F.col("near")).select(*blocks.columns)
    rest = _search(index, _route(again, tops, False, same), k, same, slices)
    return _best(first.unionByName(rest), k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10), per_slice: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: which rows are anchors, by column id. A negative's score lies between the fractions ``low`` and ``high`` of the positive's.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    used = common.stage(usable(rows, key, label, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = used.count()
    sample = used.orderBy(F.xxhash64("id", "row")).limit(SAMPLE).select("row", "id", "label", "v").toArrow() if n else None
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    tree = TopTree(_matrix(sample.column("v").combine_chunks()))
    slices = max(1, min(SLICES, math.ceil(n / per_slice)))
    index = pack(used, tree, slices, LEAF, "rows")
    chosen = used.where(anchor)
    count = chosen.count()
    blocks = pack(chosen, tree, max(1, min(SLICES, math.ceil(count / per_slice))), BLOCK, "anchors")
    # root of each slice: SLICES at most
    roots = index.groupBy("slice").agg(F.collect_list(F.struct("part", "size", "centre", "radius", "labels")).alias("leaves")).mapInArrow(_roots, "slice int, centre array<double>, radius double, only array<long>").toArrow().to_pylist()
    wide = len(roots)
    blocks = blocks.withColumn("to", F.lit(0)).withColumn("home", F.lit(-1))
    every = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: i)
    plain = blocks.withColumn("anchor", every).withColumn("low", F.transform("anchor", lambda _: F.lit(-_FAR))).withColumn("high", F.transform("anchor", lambda _: F.lit(_FAR))).withColumn("reach", F.col("low"))
    near = common.stage(_two_rounds(index, plain, roots, positives, True, wide, "positives"), "positives")
    # a lane for each anchor and positive whose interval holds anything
    (a, b), (c, d) = low, high
    least, most = F.expr(f"-((-score * {a} - pmod(-score * {a}, {b})) div {b})"), F.expr(f"(score * {c} - pmod(score * {c}, {d})) div {d}")
    lanes = near.select("slice", "part", "lane", "rank", "score", "id", least.alias("least"), most.alias("most")).where("least <= most")
    lanes = lanes.withColumn("own", F.row_number().over(Window.partitionBy("slice", "part").orderBy("lane", "rank")) - 1)
    lanes = common.stage(lanes, "lanes")
    held = lanes.groupBy(F.col("slice").alias("s"), F.col("part").alias("p")).agg(F.sort_array(F.collect_list(F.struct("own", "lane", "least", "most"))).alias("lanes"))
    sought = blocks.join(held, (F.col("slice") == F.col("s")) & (F.col("part") == F.col("p"))).withColumn("anchor", F.col("lanes.lane")).withColumn("low", F.col("lanes.least")).withColumn("high", F.col("lanes.most")).withColumn("reach", F.col("low"))
    found = _two_rounds(index, sought.select(*plain.columns), roots, negatives, False, wide, "negatives")
    ids = blocks.select(F.col("slice").alias("s"), F.col("part").alias("p"), F.posexplode("ids").alias("i", "anchor_id"))
    given = lanes.select(F.col("slice").alias("s1"), F.col("part").alias("p1"), "own", F.col("lane").alias("i1"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    given = given.join(ids, (F.col("s1") == F.col("s")) & (F.col("p1") == F.col("p")) & (F.col("i1") == F.col("i"))).drop("s", "p")
    out = found.join(given, (F.col("slice") == F.col("s1")) & (F.col("part") == F.col("p1")) & (F.col("lane") == F.col("own")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            leaves = r["leaves"]
            dims = max(len(x["centre"]) for x in leaves)
            centres = np.array([_wide(np.array([x["centre"]]), dims)[0] for x in leaves]).reshape(len(leaves), dims)
            sizes = np.array([x["size"] for x in leaves])
            centre = (centres * sizes[:, None]).sum(0) / sizes.sum()
            radius = float((np.sqrt(((centres - centre) ** 2).sum(1)) + [x["radius"] for x in leaves]).max())
            only = set().union(*(sorted(set(x["labels"]))[:2] for x in leaves))
            out.append({"slice": r["slice"], "centre": centre.tolist(), "radius": radius, "only": sorted(only) if len(only) == 1 else []})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("slice", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("only", pa.list_(pa.int64()))]))


def digest(rows: DataFrame, per_slice: int = SLICE) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows, F.col("id") % 100 == 0, label=label, per_slice=per_slice)


#: Brute force over all anchors and rows.
SQL = """
with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r, a.vec_id as anchor_id, a.label = b.label as same, b.r as br, b.vec_id as id, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by r order by score desc, id, br) as k from s where same qualify k <= 5)
select anchor_id, p.id as positive_id, (row_number() over (partition by p.r, p.k order by s.score desc, s.id, s.br))::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join (select r, id, br, score from s where not same) s on s.r = p.r and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify row_number() over (partition by p.r, p.k order by s.score desc, s.id, s.br) <= 10"""
