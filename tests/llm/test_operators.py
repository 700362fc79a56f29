"""Operators on small inputs with nulls, empty texts, repeats and ties, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, fingerprints, hamming, licenses, mixing, neardup, packing, quality, simhash, suffixes, tokenfiles, toxicity
from leafmill.llm.tokens import TextTokenizer

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", "  a  b\n\n c ", "x\ty", "l'été don't 'S.", "<|endoftext|> hi", "a\x1cb c", "foo.\nBar baz,\nqux. a", "don't, _a. 12, ½.", " x", "中文。 ok..."]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_tokens_equal_the_library(path):
    own = TextTokenizer(path)
    ids, counts = own.encode(pa.array([*ODD, None], pa.string()))
    at = 0
    for t, n in zip([*ODD, ""], counts, strict=True):
        assert own.tokenizer.encode(t, add_special_tokens=False).ids == ids[at : at + n].tolist()
        at += n


def test_license_scan(spark):
    rows = licenses.digest(frame(spark, ["Under THE mit-License. under the mit license", "Apache License, Version 2.0", None, "", "CC BY-NC 4.0"])).collect()
    by = {r.doc_id: r for r in rows}
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].last_word, by[0].base_labels) == (8, 2, 0, 4, "mit")
    assert by[1].base_labels == "apache-2" and by[4].base_labels == "cc-by-nc"
    assert by[2].n_words == 0 and by[2].first_word is None and by[2].score == 0
    assert len(licenses.default_rules()) >= 200


def test_every_license_name_passes_its_gate():
    scanner = licenses.Scanner(licenses.default_rules())

    def samples(pattern):
        # with and without what is optional, each way of the groups, the first letter of classes
        if group := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
            ways = [*group[1].split("|"), *([""] if group[2] else [])]
            return [s for way in ways for s in samples(pattern[: group.start()] + way + pattern[group.end() :])]
        if one := re.search(r"\[([^\]])[^\]]*\](\*?)|(.)\?", pattern):
            ways = [one[3], ""] if one[3] else [one[1]]
            return [s for way in ways for s in samples(pattern[: one.start()] + way + pattern[one.end() :])]
        return [" ".join(pattern.replace(",", "").split())]

    for label, *_, names, _ in licenses.FAMILIES:
        for name in names:
            for sample in samples(name):
                for text in (sample, f"licensed under the {sample}"):
                    words = scanner.words(text.encode())
                    joined = b" " + b" ".join(words) + b" "
                    hits = [r for r, pattern, keys in scanner.rules if r.label == label and r.priority in (3, 6) and pattern.search(joined) and all(k in joined for k in keys)]
                    assert hits, (label, text)
    for text, label in (("licensed under the GNU Library General Public License", "lgpl"), ("the Internet Systems Consortium license", "isc"), ("Creative Commons Zero", "cc0"), ("the PSF license", "python-2"), ("a Responsible AI license", "openrail")):
        assert label in {r.label for *_, r in scanner.scan(scanner.words(text.encode()))}
    for rule, _, keys in scanner.rules:
        if rule.priority == 2:
            assert all(k in rule.pattern.encode() for k in keys)


@pytest.mark.parametrize("length,hot", [(40, 4096), (40, 2)])
def test_suffix_dedup(spark, length, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(1)
    w = ["".join(rng.choice(list("abcé"), 3)) for _ in range(50)]
    passage = " ".join(rng.choice(w, 30))
    texts = [" ".join(rng.choice(w, 15)) + (passage if i % 3 == 0 else "") for i in range(15)] + ["a" * 200, None, "", "a" * 200]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    want = []
    for t in raw:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        want.append((len(t), int(mask.sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.digest(frame(spark, texts), length).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("hot,mask", [(1000, None), (2, None), (2, 7), (0, 0)])
def test_hot_keys_go_by_bytes(spark, hot, mask, monkeypatch):
    """A length above the passage's, runs counted, equal doc_ids, and hashes of few bits, which different windows share."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    if mask is not None:
        monkeypatch.setattr(suffixes, "MASK", mask)
    rng = np.random.default_rng(2)
    w = ["".join(rng.choice(list("abcdefgé"), 4)) for _ in range(200)]
    passage, other = " ".join(rng.choice(w, 30)), " ".join(rng.choice(w, 14))
    texts = [" ".join(rng.choice(w, 12)) + (passage[i : 90 + 3 * i] if i % 2 else other) + " ".join(rng.choice(w, 9)) + (other[:50] if i % 3 else "") for i in range(24)] + ["x" * 130, None, "", passage, passage]
    raw = [(t or "").encode() for t in texts]

    def covered(t, length):
        mask = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[length][t[i : i + length]] > 1:
                mask[i : i + length] = True
        return mask, int((np.diff(mask.astype(int), prepend=0) == 1).sum())

    seen = {n: Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1)) for n in (60, 40)}
    want = []
    for t in raw:
        (own, runs), (wide, passages) = covered(t, 60), covered(t, 40)
        want.append((len(t), int(own.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~own[:-1]])).hexdigest(), int(wide.sum()), passages))
    rows = frame(spark, texts).withColumn("doc_id", F.col("doc_id") % 9)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.passage_bytes, r.n_passages) for r in suffixes.digest(rows, 60, 40).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 10


def test_classes_ignore_ascii_case_alone(spark):
    rows = spark.createDataFrame([("A  b\n",), ("a b",), ("É b",), ("é b",)], "text string").select(neardup._class("text").alias("h")).collect()
    assert rows[0].h == rows[1].h and rows[2].h != rows[3].h


@pytest.mark.parametrize("sources", [mixing.SOURCES, 0])
def test_mix_by_broadcast_and_by_shuffle(spark, sources, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", sources)
    rows = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(90)], "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.digest(rows).collect()), key=str)
    words = {s: sum(r[4] for r in got if i_source(r[0]) == s) for s in ("a", "b", None)}
    assert all(abs(words[i_source(r[0])] - r[3]) <= 0.5 for r in got) and all(r[4] <= 2 * r[1] for r in got)


def i_source(i):
    return ["a", "b", None][i % 3]


def test_cut_passages_go_by_whole_characters(spark):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(80))
    # both end in the byte A9 before the passage; the U+FFFD stood in the input
    docs = frame(spark, ["\ufffd a é" + passage, "b ©" + passage])
    assert {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()} == {0: "\ufffd a ", 1: "b "}


def test_resampling_keeps_its_share(spark):
    docs = frame(spark, [f"good word{i % 7} text here" if i % 4 else "%%% junk zz zz zz" for i in range(40)] + ["", None])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(20)], "doc_id long, quality int")
    rows = quality.resample(docs, labels, share=0.5).collect()
    assert len(rows) == 21


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, -2.0, 9.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 7)] == [*sorted(values, reverse=True), None]


def test_packing_holds_every_id_once(spark):
    texts = [*ODD, None, "word and " * 900]
    rows = packing.pack(frame(spark, texts), BYTES, 0).collect()
    places = Counter()
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4096
        places.update((r.sequence_id, r.offset + i) for i in range(r.length))
    assert set(places.values()) == {1}
    sizes = Counter(s for s, _ in places)
    assert all({o for s, o in places if s == q} == set(range(n)) for q, n in sizes.items())
    own = TextTokenizer(BYTES)
    assert sum(sizes.values()) == sum(len(own.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)


def test_mixing_meets_targets(spark):
    docs = frame(spark, ["w " * (3 + i * 7 % 40) for i in range(60)] + [None, "", " "])
    rows = mixing.digest(docs).collect()
    assert len(rows) == 63 and sorted(rows, key=str) == sorted(mixing.digest(docs).collect(), key=str)
    by = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[(r.source_size, r.target)] += r.taken
    assert all(abs(taken - target) <= 40 for (_, target), taken in by.items())


def test_simhash(spark):
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "A b  c d e f g h i j k l m x", None, "", "one"] + [f"u{i} v{i} w{i} x{i} y{i}" for i in range(30)]
    rows = simhash.digest(frame(spark, texts)).collect()

    def fp(t):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
        import xxhash

        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    want = Counter(f"{fp(t):016x}" for t in texts)
    assert Counter(r.fingerprint for r in rows) == want


def test_anchors_find_all_links(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    prints = {x for b in base for x in (b, b ^ 1, b ^ (1 << 31) ^ (1 << 40), b ^ (1 << 5) ^ (1 << 6))}
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fingerprint long")).collect()}
    assert got == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}


def test_hamming_search(spark):
    rng = np.random.default_rng(5)
    codes = [*map(int, rng.integers(0, 1 << 62, 60)), 7, 7, 7]
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in hamming.search(rows, rows.where("id % 20 = 0"), 4).collect()}
    for q in range(0, 63, 20):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, d) for d, i in near]


@pytest.mark.parametrize("kind", ["random", "near", "far", "few"])
def test_hamming_index_equals_brute_force(kind):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, 3 if kind == "few" else 3000, dtype=np.uint64)
    if kind == "near":  # one value in two segments
        codes = codes & np.uint64(0x3FF) | np.uint64(5 << 40)
    codes = rng.permutation(np.unique(codes))
    held = rng.integers(1, 4, len(codes)).astype(np.int32)
    queries = np.concatenate([codes[:40], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
    if kind == "far":
        queries = ~codes[:40]
    q, found, d = hamming.Index(codes, held).nearest(queries, 10)
    for i, query in enumerate(queries):
        true = np.bitwise_count(codes ^ query).astype(int)
        order = np.lexsort((np.arange(len(codes)), true))
        enough = int(np.searchsorted(np.cumsum(held[order]), 11)) if held.sum() > 10 else len(codes)
        want = [j for j in order if enough == len(codes) or true[j] <= true[order[enough]]][:11]
        assert found[q == i].tolist() == want and d[q == i].tolist() == true[want].tolist()


def test_hamming_search_by_slices_makes_few_rows(spark, monkeypatch):
    monkeypatch.setattr(hamming, "SLICE", 1500)
    monkeypatch.setattr(hamming, "BLOCK", 70)
    staged, plain = {}, common.stage
    monkeypatch.setattr(common, "stage", lambda df, name, *more: staged.setdefault(f"{name}{len(staged)}", plain(df, name, *more)))
    monkeypatch.setattr(common, "drop_stage", lambda df: None)
    rng = np.random.default_rng(9)
    codes = rng.integers(-(1 << 63), 1 << 63 - 1, 4000)
    codes[100:130], codes[2000:2004] = codes[0], codes[20]
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "id long, code long")
    got = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in hamming.search(rows, rows.where("id % 20 = 0")).collect()}
    assert len(got) == 2000
    for q in range(0, 4000, 20):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        near = [(int(j), int(d[j])) for j in np.lexsort((np.arange(4000), d)) if j != q][:10]
        assert [got[q, k + 1] for k in range(10)] == near
    # what candidates are met stays in a task: of each slice a query has k + 1 codes at most
    assert sum(df.count() for df in staged.values()) < 2 * 4000 + 200 + 200 * 3 * 11 + 100


def test_fingerprints(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(6)] + ["", None, "one two"]
    rows = {r.doc_id: r for r in fingerprints.digest(frame(spark, texts)).collect()}
    order = sorted((i for i in range(9) if i != 3), reverse=True) + [3]
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[i] or "", texts[following] or ""
        r = rows[None if i == 3 else i]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert rows[0].n_chars == len(texts[0]) and 0.15 < rows[5].near_edited < 0.6 and rows[5].near_next < 0.1


def test_token_files(spark):
    texts = [*ODD, None, "word and " * 500]
    rows = tokenfiles.digest(frame(spark, texts), WORDS).orderBy("start").collect()
    own, start = TextTokenizer(WORDS), 0
    for i, r in zip([i for i in range(len(texts)) if i != 3] + [3], rows, strict=True):
        ids = np.array([*own.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_huffman_lengths_are_bounded_and_complete():
    counts = np.array([1 << i for i in range(30)] + [0, 5])
    lengths = tokenfiles.code_lengths(counts, 12)
    assert lengths.max() <= 12 and lengths[30] == 0 and abs(sum(2.0 ** -int(n) for n in lengths if n) - 1) < 1e-12


def test_toxicity(spark):
    docs = frame(spark, [f"the idiot said w{i} and then more words" if i % 3 == 0 else f"the cat said w{i} and then more words" for i in range(120)] + ["", None])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert np.mean([rows[i].score for i in range(6, 120, 3)]) > np.mean([rows[i].score for i in range(7, 120, 3)]) + 0.3
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items() if i is not None)


def test_toxicity_undoes_the_sampling_of_classes(spark):
    # an eleventh is toxic whatever the text says: a sample of as many of either class must not make it a half
    docs = frame(spark, [f"w{i % 7} said w{i % 5} and then w{i % 3} words" for i in range(1200)])
    labels = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(1200)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, max_docs=60)
    mean = toxicity.score(docs, scorer).agg(F.avg("toxicity")).first()[0]
    assert 0.05 < mean < 0.2


def test_class_counts_hold_every_pair_of_a_text(spark):
    texts = ["a b c a c b b a b", "b a", "", "a"]
    rows = spark.createDataFrame([(1, 0, bytearray(t.encode())) for t in texts], "y int, fold int, text binary")
    words, pairs = toxicity.class_counts(rows)
    hashes = {w: int(toxicity.hashed([w.encode()])[0].view(np.int64)[0]) for w in "abc"} | {"": 0}
    split = [["", *t.split()] for t in texts]
    want = Counter(p for t in split for p in {(hashes[x], hashes[y]) for x, y in zip(t, t[1:])})
    assert {(r.before, r.word): r.n for r in pairs.collect()} == want
    got = {r.hash: (r.n, r.precedes, r.begins) for r in words.collect()}
    assert got == {h: (sum(w in t for t in split), sum(y == h for _, y in want), sum(n for (x, _), n in want.items() if x == h)) for w, h in hashes.items() if w}


def test_shared_continuations_grow_with_the_data(spark):
    docs = frame(spark, [f"b{i} many c{i % 40} some d{i % 3} few" for i in range(5000)])
    keys = np.sort(toxicity.hashed([b"many some few"])[0])
    n, total = toxicity.shared_continuations(docs.repartition(5), keys)
    by = dict(zip(keys.tolist(), n, strict=True))
    for word, true in (("many", 5000), ("some", 40), ("few", 3)):
        assert abs(by[int(toxicity.hashed([word.encode()])[0][0])] / true - 1) < 0.3
    assert abs(total / (5000 + 5000 + 40 + 40 + 3 * 40 + 3) - 1) < 0.05


def test_toxicity_keeps_every_term_of_enough_texts(spark):
    # more words than any bound of a table: all of them are in four texts of label 1
    n = (1 << 18) + 1000
    common_words = " ".join(f"w{i}" for i in range(n))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    docs = spark.createDataFrame([(i, f"{common_words} own{i}" if k < 4 else f"plain text {i}") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 4)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels).model
    assert len(set(toxicity.hashed([common_words.encode()])[0].tolist()) - set(model.keys.tolist())) == 0
    assert len(model.pairs) >= n and (model.precedes[1] > 0).sum() >= n


def test_a_term_of_one_class_keeps_its_count_in_the_other(spark):
    # "even" is in four texts of label 1 and in three of label 0, "lone" in four of label 1 only
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    docs = spark.createDataFrame([(i, f"own{i} even" + f" own{i} lone" * (k < 4) if k < 7 else "own other") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 4)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels).model
    at = {w: int(np.searchsorted(model.keys, toxicity.hashed([w.encode()])[0][0])) for w in ("even", "lone")}
    assert model.precedes[:, at["even"]].tolist() == [3 - toxicity.DISCOUNT, 4 - toxicity.DISCOUNT]
    assert model.precedes[:, at["lone"]].tolist() == [0, 4 - toxicity.DISCOUNT]


def test_shared_continuations_of_a_task_without_a_word_of_the_model(spark):
    docs = spark.createDataFrame([(i, "many words" if i < 4 else "other") for i in range(8)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    keys = np.sort(toxicity.hashed([b"many words"])[0])
    n, total = toxicity.shared_continuations(docs, keys)
    assert n.round().tolist() == [1, 1] and round(total) == 3


def test_keep_one(spark):
    a = [f"w{i}" for i in range(100)]
    near = [*a[:50], "changed", *a[51:]]
    texts = [" ".join(a), " ".join(a).upper(), " ".join(near), "first lone", " ".join(f"z{i}" for i in range(100)), "", None]
    rows = neardup.keep_one(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {0, None, 4, 5}


@pytest.mark.parametrize("length,replaced,variants", [(300, 5, 30), (300, 5, 300), (1000, 18, 60)])
def test_keep_one_of_a_star(spark, length, replaced, variants):
    # each variant is similar to the original, but few to one another
    rng = np.random.default_rng(variants)
    a = [f"w{i}" for i in range(length)]
    texts = [" ".join(a)]
    for v in range(variants):
        own = list(a)
        for i in rng.choice(np.arange(2, length - 2, 6), replaced, replace=False):
            own[i] = f"v{v}x{i}"
        texts.append(" ".join(own))
    assert [r.doc_id for r in neardup.keep_one(frame(spark, texts)).collect()] == [0]


def test_few_pairs_of_a_large_group_are_left_to_the_second_comparison(spark, monkeypatch):
    # texts with four words replaced are similar only to the few with two
    rng, n = np.random.default_rng(3), 400
    a, texts = [f"w{i}" for i in range(300)], []
    for v in range(n):
        own = list(a)
        for i in rng.choice(np.arange(6, 294, 6), rng.choice([2, 3, 4], p=[0.05, 0.2, 0.75]), replace=False):
            own[i] = f"v{v}x{i}"
        texts.append(" ".join(own))
    similar, counts = neardup._similar, []

    def counted(pairs, *rest):
        pairs = common.stage(pairs, "counted")
        counts.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(neardup, "_similar", counted)
    assert [r.doc_id for r in neardup.keep_one(frame(spark, texts)).collect()] == [0]
    assert len(counts) == 2 and counts[1] < 10 * n, counts


def exchanges(df):
    """Of the plan that ran: what is dealt out by rows, and not broadcast."""
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if re.search(r"\bExchange hashpartitioning", line)]


def test_sets_stay_where_they_are(spark, monkeypatch):
    # names of pairs that are too many to broadcast are dealt to the buckets of the sets, not the sets to them
    made, stage_by = [], common.stage_by
    monkeypatch.setattr(common, "stage_by", lambda *a: made.append(stage_by(*a)) or made[-1])
    dropped, drop = [], common.drop_stage
    monkeypatch.setattr(common, "drop_stage", dropped.append)
    texts = [f"a b c d e f g h i j k l m n o p q r s t {i // 2} {i}" for i in range(200)]
    neardup.links(frame(spark, texts), "text").collect()
    (sets,) = made
    assert any(x is sets for x in dropped) and sets.count() == 200 and not spark.sql("SHOW TABLES LIKE 'leafmill*'").collect()
    ths = [r.th_ for r in sets.select("th_").orderBy("th_").collect()]
    pairs = spark.createDataFrame(list(zip(ths[:60:2], ths[1:60:2], strict=True)), "a long, b long")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        of = neardup._of_pairs(pairs, sets)
        assert len(exchanges(of)) == 1 and sorted(r.th_ for r in of.collect()) == ths[:60]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    drop(sets)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        sets.collect()


def test_shared_prefixes_travel_once(spark):
    rows = [(1, 10, 0), (1, 11, 3), (2, 10, 1), (-5, 12, 0), (-5, 10, 2), (-5, 11, 0), (7, 12, 1)]
    shared = neardup._shared(spark.createDataFrame(rows, "token long, th_ long, place int"))
    assert len(exchanges(shared)) == 1 and sorted(map(tuple, shared.collect())) == sorted(x for x in rows if x[0] not in (2, 7))


def test_whole_rows_travel_once(spark):
    import corpus_pipeline

    # a null id and an empty one differ; rows with the text are dealt out once, for the join and for repeats
    texts = [" ".join(f"w{i}x{j}" for j in range(i % 23 + 1)) for i in range(60)]
    rows = [(None if i == 3 else "" if i == 4 else f"={i}", t, "en", f"s{i % 3}" if i % 5 else None, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], rows[7], ("=9y", texts[9].upper(), "en", "s0", 9)], "doc_id string, text string, lang string, source string, n_chars long")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(docs)
        mixed = corpus_pipeline.mix_sources(spark, docs, "")
        for df in (kept, mixed):
            dealt = [x for x in exchanges(df) if "doc_id" in x or "key_" in x or re.search(r"\bk_#", x)]
            assert len(dealt) == 1, dealt
        assert sorted((r.doc_id or "null", r.text) for r in kept.collect()) == sorted((r[0] or "null", r[1]) for r in [*rows[:3], ("null", *rows[3][1:]), *rows[4:]])
        taken = Counter(r.doc_id for r in mixed.collect())
        assert None in taken and set(taken) <= {r.doc_id for r in docs.collect()} and max(taken.values()) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_sample_of_shingles_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE", 10)
    # one text in twenty holds a shingle that ten texts would not show
    docs = spark.createDataFrame([(f"a b c d e own{i} more{i}" if i % 20 == 0 else f"x{i} y{i} z{i} u{i} v{i} w{i}",) for i in range(2000)], "text string")
    tokens, n = neardup._frequent(common.stage(neardup._sets(docs, "text"), "sets"))
    shingle = neardup.shingles(neardup.hashed([b"a b c d e"], signs=True)[0], 5)[0]
    assert shingle in tokens and n[tokens == shingle][0] > 2


def test_near_duplicate_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"c{i}" for i in range(12))
    texts = []
    for g in range(25):
        a = [f"g{g}w{i}" for i in range(rng.integers(3, 120))]
        for v in range(8):
            own = [w if rng.random() > 0.006 * v else f"x{rng.integers(1 << 30)}" for w in a[rng.integers(0, 4) :]]
            texts.append(" ".join(own) + (" " + line if g % 2 else ""))

    def shingled(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = frame(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == set(root)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for made in (licenses.digest(docs), suffixes.digest(docs), quality.resample(docs, labels), packing.digest(docs, BYTES), mixing.digest(docs), simhash.digest(docs), fingerprints.digest(docs), tokenfiles.digest(docs, WORDS), toxicity.digest(docs, labels), neardup.keep_one(docs)):
        assert made.count() == 0
    assert common.groups_of([], 5) == []


def test_ids_of_odd_words_equal_the_librarys():
    import random

    import pyarrow as pa
    import public_tokenizers

    from leafmill.llm import tokens

    draw = random.Random(1)
    signs = [*"abcXYZ'ÉßİΣςǅשׁⅧ²1.,!?*#-_́中<|>\n", "<|endoftext|>", "'s", " ", " ", " ", "Ġ", "Ċ"]
    texts = [None, "", " ", "\n", "a", "a\nb", "a.\nb, c", "İ? İ", "Ġ Ċ\nĊ"] + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = tokens.TextTokenizer(public_tokenizers.path(name))
        for _ in range(2):  # new words, then known ones
            ids, counts = own.encode(pa.array(texts))
            ends = counts.cumsum()
            assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [x.tolist() for x in own.library([t or "" for t in texts])]


def test_columns_may_clash(spark):
    import corpus_pipeline

    texts = [f"w{i} x{i} y{i} z{i} " * 30 for i in range(8)] + ["w1 x1 y1 z1 " * 30 + "end", None, ""]
    docs = frame(spark, texts)
    for name in ("th_", "t_", "id_", "i_", "toxicity", "toxicity_", "kept_", "raw_", "spans", "n_bytes", "row_", "copy_", "taken", "taken_", "size", "fingerprint"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs = docs.withColumn("facts", F.create_map(F.lit("a"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, toxic int, quality int")
    labels.write.mode("overwrite").parquet(f"{common.shared_dir(spark)}/clash/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, f"{common.shared_dir(spark)}/clash")
        assert made.columns == docs.columns, name
        assert made.where("th_ <> 'own th_' or toxicity <> 'own toxicity' or size <> 'own size'").count() == 0


def test_pipeline_by_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(60)]
    passage = " ".join(f"passage{i}" for i in range(60))
    texts += [texts[0], texts[1] + " more", texts[2] + " " + passage, texts[3] + " " + passage, "", None]
    docs = frame(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(66))
    lone = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r.doc_id for r in lone.collect()} == set(range(66)) - {60, 61, 65}
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, lone, str(tmp_path)).collect()}
    assert all("passage5 " not in cut[i].text for i in (62, 63)) and cut[10].text == texts[10] and cut[62].n_chars == len(cut[62].text)
    mixed = corpus_pipeline.mix_sources(spark, lone, str(tmp_path)).collect()
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * sum(words(r.text) for r in lone.collect())) <= 4 and max(Counter(r.doc_id for r in mixed).values()) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_license_base_places_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "x-y", "2.0"]
    texts = [" ".join(rng.choice(bits, 80)) for _ in range(40)] + ["Under the MIT-License; " * 300, "cc by nc " * 200]
    rows = {r.doc_id: r for r in licenses.digest(frame(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for label, phrase in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_license_suppression_equals_all_pairs():
    scanner = licenses.Scanner(licenses.default_rules())
    rng = np.random.default_rng(2)
    names = ["licensed under the", "mit license", "apache license version 2", "gnu general public license", "gpl 2 0 only", "bsd 3 clause", "spdx license identifier", "cc by nc sa 4 0", "the", "attribution share alike"]
    for _ in range(60):
        words = " ".join(rng.choice(names, 25)).encode().split()
        joined = b" " + b" ".join(words) + b" "
        found = []
        for rule, pattern, keys in scanner.rules:
            if all(k in joined for k in keys):
                found += [(joined.count(b" ", 0, m.start()) - 1, joined.count(b" ", 0, m.end()), rule) for m in pattern.finditer(joined)]
        found.sort(key=lambda d: (d[2].priority, d[0], -d[1], d[2].name))
        kept = []
        for b, e, rule in found:
            if not rule.priority or not any(x <= b and e <= y for x, y, _ in kept):
                kept.append((b, e, rule))
        assert {(b, e, r.name) for b, e, r in scanner.scan(words)} == {(b, e, r.name) for b, e, r in kept}


def test_packed_pieces_equal_the_librarys_ids(spark):
    texts = [*ODD, None, "word and " * 900, "same", "same"]
    own = TextTokenizer(BYTES)
    want = {}
    for i, t in enumerate(texts):
        want[i] = np.array([*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    docs = frame(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    covered = {i: np.zeros(len(w), int) for i, w in want.items()}
    for r in packing.digest(docs, BYTES).collect():
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(piece.tobytes()), len(want[r.doc_id]))
        covered[r.doc_id][r.start : r.start + r.length] += 1
    assert all((c == 1).all() for c in covered.values())


def test_simhash_components_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        a = list(rng.choice([f"v{i}" for i in range(300)], 400))
        for _ in range(5):
            own = list(a)
            own[rng.integers(400)] = f"z{rng.integers(1 << 30)}"
            texts.append(" ".join(own))
    docs = frame(spark, [*texts, texts[0], "", None]).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    rows = simhash.digest(docs).collect()
    root = {r.doc_id: r.doc_id for r in rows}
    bits = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for _ in root:
        for a in root:
            for b in root:
                if (bits[a] ^ bits[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in rows} == root


def test_fingerprints_take_bounded_memory():
    import tracemalloc

    texts = [" ".join(f"w{i % 50}x{j % 70}" for j in range(700)).encode() for i in range(1000)]  # 4 MB and more
    tracemalloc.start()
    fingerprints.of_texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000


def test_likeness_is_near_the_true_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        for _ in range(20):
            n = 3000
            same = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.concatenate([same, rng.integers(0, 1 << 63, n - len(same), dtype=np.uint64)]) for _ in range(2))
            true = len(same) / (2 * n - len(same))
            errors.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12
    sparse = [fingerprints.fingerprint(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(2)]
    assert fingerprints.likeness(sparse[0], sparse[0]) == 1 and fingerprints.likeness(*sparse) < 0.2


def test_tilts_equal_a_brute_force_dual(spark):
    sizes = [3, 9, 27, 81, 40, 5, 12]

    def total(tilt):
        return sum(s * min(np.exp(min(tilt * s / np.mean(sizes), 2.0)), 2.0) for s in sizes)

    cells = spark.createDataFrame([("a", s, 1) for s in sizes], "source string, size long, n long")
    for share in (0.2, 0.9, 1.5, 1.9):
        low, high = -64.0, 64.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < share * sum(sizes) else (low, mid)
        sources = spark.createDataFrame([("a", sum(sizes), share * sum(sizes), False)], "source string, source_size long, target double, full boolean")
        found = mixing.tilts(cells, sources).first()
        assert abs(total(found.tilt) - total(low)) <= 0.51 and abs(found.mean - np.mean(sizes)) < 1e-9


def test_resampling_weights_equal_brute_force(spark):
    texts = ["good text here", "bad junk zz", "good good", "", "other words stand here"]
    docs, labels = frame(spark, texts).where("doc_id is not null"), spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    ratio, share = quality.fit(docs, labels)
    ids = [0, 1, 2, 4]
    own = {i: [b for _, _, buckets, _ in quality._features([texts[i].encode()]) for b in buckets.tolist()] for i in ids}
    t, r = (Counter(b for i in which for b in own[i]) for which in ((0, 2), ids))
    nt, nr = (sum(c.values()) + quality.BUCKETS for c in (t, r))
    for row in quality.weigh(docs, ratio).collect():
        want = sum(np.log((t[b] + 1) / nt) - np.log((r[b] + 1) / nr) for b in own[row.doc_id])
        assert abs(row.log_weight - want) < 1e-9 and row.n_grams == len(own[row.doc_id])
    assert abs(share - 2 / 3) < 1e-12
