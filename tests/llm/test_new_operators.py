"""Winnowing, dual-tree search and alignment against brute force, with odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafmill.llm import alignment, dualtree, winnowing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cut(text):
    out, word = [], ""
    for c in [*(text or ""), " "]:
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def contaminated(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, met = cut(text), set(), set()
        for item_id, item in items:
            v = cut(item)
            n = min(10, len(v))
            own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    met.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def shared():
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "É", "é", "x9", "the", "Sollte", "日本"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(1, " ".join(some(40))), (2, "Only, three words"), (None, " ".join(some(12))), (4, ""), (5, None), (6, "É"), (7, "the " * 30), (8, " ".join(some(10)))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "THE"), (4, "the " * 300), (None, items[0][1]), (5, "only three WORDS only three words")]
    for i in range(30):
        item = items[r.choice([0, 2, 7])][1].split()
        a = r.randrange(len(item))
        docs.append((10 + i % 20, " ".join([*some(r.randrange(20)), *item[a : a + r.randrange(1, 20)], *some(r.randrange(20))])))
    return docs + [docs[-1]], items


@pytest.mark.parametrize("most", [winnowing.MOST, 0])
def test_winnowing(spark, most):
    docs, items = shared()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("Words", F.lit("x")).withColumn("s", F.lit("y"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, winnowing.digest(d, b, most).collect()), key=str)
    assert got == contaminated(docs, items)


def test_winnowed_spans(spark):
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, " ".join(["a", "b", "c", *words, "d", *words[:12], "e", *words[:9]]))], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert sorted(tuple(r) for r in winnowing.spans(d, b).collect()) == [(1, "9", 3, 33), (1, "9", 34, 46)]


def test_winnowing_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in winnowing.digest(d, none).collect()] == [(2, 0, False)]
    assert winnowing.digest(d.limit(0), none).collect() == []


def negatives(rows):
    """By the contract, pair by pair."""
    e = []
    for i, (key, vector, label) in enumerate(rows):
        if key is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            e.append((i, key, (label + 1) % 10 if key % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in vector]))
    out = []
    for a in (x for x in e if x[1] % 100 == 0):
        scored = sorted((-sum(p * q for p, q in zip(a[3], b[3])), b[1], b[0], b[2]) for b in e if b[0] != a[0])
        for s, key, _, label in [x for x in scored if x[3] == a[2]][:5]:
            fit = [x for x in scored if x[3] != a[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[1], key, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("per_slice", [dualtree.SLICE, 40])
def test_dual_tree(spark, per_slice):
    r = random.Random(3)
    vector = lambda n=6: [r.gauss(0.2, 1) for _ in range(n)]
    rows = [(i, vector(), r.randrange(3)) for i in range(0, 900, 3)] + [(i, [0.25] * 6, 1) for i in range(1000, 1090)]
    rows += [(100, vector(), 2), (100, [0.25] * 6, 1), (None, vector(), 1), (2000, None, 1), (2100, vector(), None), (2200, [None, 1.0], 1), (2300, [float("nan")] * 6, 1), (2400, [float("inf")] * 6, 0), (2500, [], 1), (2600, vector(3), 1), (2700, vector(9), 0), (2800, [0.0] * 6, 2), (2900, vector(), 77)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).withColumn("V", F.lit("x"))
    got = sorted(map(tuple, dualtree.digest(df, per_slice).collect()))
    assert got == negatives(rows) and got


def test_dual_tree_far_numbers(spark):
    """Products beyond 2^53 are exact."""
    rows = [(0, [2.0**22, 1.0], 1), (1, [2.0**22, 3.0], 1), (2, [2.0**21, 2.0], 2), (3, [2.0**21, 2.0 + 2**-8], 2), (5, [3e38, 3e38], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, dualtree.digest(df).collect())) == negatives([(k, v, l) for k, v, l in rows])


def test_dual_tree_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert dualtree.digest(none).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1), (3, [1.0], 2)], none.schema)
    assert dualtree.digest(alone).collect() == []


def links(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, signs = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment.byte_signs()
    a.encode_special_tokens = True
    docs, count = [], Counter()
    for text in texts:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        sides = [[bytes(signs[c] for c in t) for t in x.tokens], [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            docs.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        at = [{e: i for i, e in enumerate(side)} for side in ends]
        parts, own, i, j = [], [], 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            k, m = at[0][stop] + 1, at[1][stop] + 1
            parts.append(",".join(map(str, x.ids[i:k])) + "|" + ",".join(map(str, y[j:m])))
            own.append((x.ids[k - 1], y[m - 1]))
            i, j = k, m
        count.update(own)
        docs.append((len(x.ids), len(y), len(parts), own, ";".join(parts)))
    top = Counter()
    for (_, i), n in count.items():
        top[i] = max(top[i], n)
    return [(0,) * 6 + ("",) if d is None else (d[0], d[1], d[2], len(d[3]), sum(count[p] == top[p[1]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


TEXTS = [None, "", "a", "Hello  world", "▁a", "ﬁ é x\ty", "\n", " ", "<s>x</s> <0x41> <|endoftext|>", "日本語のテキスト 漢字", "👩‍👩‍👧 ok", "\x00a", "Hello  world", "é unbelievable internationalization " * 40, "word " * 30_000]


@pytest.mark.parametrize("most", [alignment.MOST, 0])
def test_alignment(spark, most):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("Links", F.lit("x"))
    got = [tuple(r)[1:] for r in alignment.digest(df, A, B, most).orderBy("doc_id").collect()]
    assert got == links(TEXTS)


def test_alignment_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(df, A, B).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.count_sum for r in alignment.digest(rows, A, B).collect()] == [4, 4]


def test_components():
    r = random.Random(1)
    u, v = (np.array([r.randrange(60) for _ in range(50)]) for _ in "uv")
    least = list(range(60))
    for _ in range(60):
        for a, b in zip(u, v):
            least[a] = least[b] = min(least[a], least[b])
    assert alignment.components(u, v, 60).tolist() == least
