"""Rules that SQL can't express, files and streams, against sequential models and round trips."""

import io
import json
import os
import random
import struct
import time
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill import cli, config
from leafmill.functions import text as T
from leafmill.models import client, summarise
from leafmill.operators import documents, grounding, images, media, pages, retrieval, slides
from leafmill.sinks import files as sink
from leafmill.sinks.store import Store
from leafmill.sources import inputs, pptx
from leafmill.streaming import lines as stream_lines


def one(spark, column, **cells):
    kinds = {k: "string" if isinstance(v, str) or v is None else "int" for k, v in cells.items()}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {v}" for k, v in kinds.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("md,reason", [("\t\n\t", "empty"), ("", "empty"), ("\t" * 26 + "- x", "excessive nesting"), ("a\r\n" * 9, "repetitive"), ("x\r" * 301, "runaway length"), ("fine text", None), ("see ...", "placeholder")])
def test_quality_by_all_white_space(spark, md, reason):
    assert one(spark, documents.quality_reason(F.col("md")), md=md) == reason


def test_long_texts_are_refused_before_their_lines_are_normalised(spark):
    """Normalising comes behind the rule on length: its cost doesn't show in the time of long texts (2.5 million lines)."""
    rows = spark.range(50).select(F.expr("concat(id, repeat('\n- **a** line  of some words 12', 50000))").alias("md")).repartition(4).cache()
    rows.count()
    spent = lambda what: (time.perf_counter(), rows.select(what.alias("x")).agg(F.min("x"), F.max("x")).first(), time.perf_counter())
    spent(F.size(T.lines(F.col("md"))))
    begin, _, end = spent(F.size(F.filter(T.lines(F.col("md")), lambda x: x.rlike(r"\S"))))
    own_begin, found, own_end = spent(documents.quality_reason(F.col("md")))
    assert tuple(found) == ("runaway length", "runaway length")
    assert own_end - own_begin < 5 * (end - begin) + 1
    rows.unpersist()


def test_lines_end_at_every_line_end(spark):
    for text in ("", "a", "a\n", "a\r\nb\rc\x0bd\x85e f\n\n", "\n"):
        assert one(spark, T.lines(F.col("t")), t=text) == text.splitlines()
        assert one(spark, T.strip(F.col("t")), t=f"\x1c　 {text}x\t\xa0") == f"\x1c　 {text}x\t\xa0".strip()


def test_footers_and_images_count_all_pages(spark):
    whole = spark.createDataFrame([(1, p, 540.0) for p in range(10)], "document_id int, page int, height double")
    few = spark.createDataFrame([(1, p, "d") for p in range(2)], "document_id int, page int, digest string")
    assert documents.recurring_images(few, whole).count() == 0
    foot = spark.createDataFrame([(1, p, 500.0, 9.0, str(p)) for p in range(5)], "document_id int, page int, y0 double, size double, text string")
    assert [tuple(r) for r in documents.repeated_footers(foot, whole).collect()] == [(1, "", 5)]
    assert documents.repeated_footers(foot.limit(4), whole).count() == 0


def test_nearest_chunks_over_several_slices(spark):
    rng = np.random.default_rng(5)
    vectors = [v.tolist() for v in rng.integers(-3, 4, (120, 4)).astype(float)]  # many equal distances
    vectors += [None, [0.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], [1.0], []]
    rows = [(i, i % 2, v) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id int, embedding array<double>")
    asked = chunks.where("chunk_id % 3 = 0 or chunk_id >= 118").selectExpr("chunk_id as query_id", "document_id", "embedding as vector")

    def far(a, b):
        """Numbers, then NaN, then what isn't known."""
        if a is None or b is None or len(a) != len(b) or None in (*a, *b):
            return 2, 0.0
        with np.errstate(all="ignore"):
            d = float(np.sqrt(sum((np.float64(x) - np.float64(y)) * (np.float64(x) - np.float64(y)) for x, y in zip(a, b, strict=True))))
        return (1, 0.0) if np.isnan(d) else (0, d)

    want = {(q, c, n) for q, doc, v in rows if q % 3 == 0 or q >= 118 for n, (_, c) in enumerate(sorted((far(v, w), c) for c, d, w in rows if d == doc)[:7], 1)}
    for most in (10, 4096):
        assert {tuple(r) for r in retrieval.nearest_chunks(chunks, asked, 7, most).collect()} == want


def _flow(items, tables):
    """Sequential model: merge, interleave, merge again, emit."""

    def glyph(md):
        return md.lstrip()[:1] if md.lstrip()[:1] in tuple(T.GLYPHS) and md.lstrip() else None

    def rest(md):
        return md.lstrip()[1:].lstrip() if glyph(md) else md

    def merge(row):
        out, i = [], 0
        while i < len(row):
            x = row[i]
            if glyph(x["md"]) and not rest(x["md"]) and i + 1 < len(row) and abs(row[i + 1]["y0"] - x["y0"]) <= 6:
                out.append(row[i + 1] | {"md": glyph(x["md"]) + " " + row[i + 1]["md"].lstrip(), "x0": x["x0"], "y0": x["y0"]})
                i += 2
            else:
                out.append(x)
                i += 1
        return out

    five = lambda x: round(x / 5) * 5
    level = {x: i for i, x in enumerate(sorted({five(i["x0"]) for i in items if glyph(i["md"])}))}

    def emit(row):
        out, mode, depth, last = [], None, 0, None
        for x in row:
            md = x["md"].strip()
            if not md:
                continue
            near = (0 if last is None else x["y0"] - last) <= x["h"] * 1.6
            if glyph(md):
                depth = level.get(five(x["x0"]), 0)
                out += [""] * (mode == "para") + [("  " * depth + "- " + rest(md)).rstrip() if rest(md) else "  " * depth + "-"]
                mode = "list"
            elif mode == "list" and near and not md.startswith("**"):
                out.append("  " * (depth + 1) + md)
            else:
                out += [""] * (mode == "list" or (mode == "para" and not near)) + [md]
                mode = "para"
            last = x["y1"]
        return out

    nodes = sorted([(i["y0"], 0, n, i) for n, i in enumerate(merge(items))] + [(y, 1, 0, t) for y, t in tables], key=lambda z: z[:3])
    out, held = [], []
    for _, kind, _, x in nodes:
        if kind:
            out += emit(merge(held)) + x + [""]
            held = []
        else:
            held.append(x)
    return out + emit(merge(held))


def test_images_are_dealt_by_rows(spark, monkeypatch):
    """Tasks hold so many lines, whatever partitions a session has or joins together."""
    from leafmill.plans import adapters

    monkeypatch.setattr(adapters, "TASK", 500)
    rows = adapters.images(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in rows) > 5_000 and max(r.n for r in rows) < 1_000


def test_page_flow_gathers_a_page_once(spark):
    """Lines and tables travel once each and meet in one group; numbering, merging and writing are folds over its arrays."""
    df = spark.createDataFrame([(1, 1, 1, "a", 1.0, 2.0, 3.0, 4.0)], "document_id int, page int, n int, md string, x0 double, y0 double, x1 double, y1 double")
    plan = pages.page_markdown(df, spark.createDataFrame([(1, 1, 3.0, ["t"])], "document_id int, page int, y0 double, md array<string>"))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Generate" not in plan


def test_page_flow_equals_a_sequential_model(spark):
    draw, rows, tables, want = random.Random(4), [], [], {}
    for page in range(120):
        items = []
        for n in range(draw.randint(1, 12)):
            md = draw.choice(["• item", "•", "–", "plain text", "**Lead** in", " ", "more", "• "])
            y = float(draw.choice([20, 24, 29, 40, 60, 61, 90]) + draw.choice([0, 0, 3]))
            items.append({"n": n, "md": md, "x0": float(draw.choice([10, 12, 20, 35])), "y0": y, "y1": y + draw.choice([0.0, 9.0, 12.0])})
        rows += [(1, page, i["n"], i["md"], i["md"], i["x0"], i["y0"], i["x0"] + 5, i["y1"], 10.0) for i in items]
        own = [(float(draw.choice([24, 50, 61])), ["| t |", "| --- |"])] if draw.random() < 0.4 else []
        tables += [(1, page, y, t) for y, t in own]
        ordered, anchor, row = [], None, 0
        for i in sorted(items, key=lambda i: (i["y0"], i["x0"], i["n"])):
            if anchor is None or i["y0"] - anchor > 6:
                anchor, row = i["y0"], row + 1
            ordered.append((row, i["x0"], i["y0"], i["n"], i))
        want[page] = _flow([{**i, "h": max(i["y1"] - i["y0"], 1.0)} for *_, i in sorted(ordered, key=lambda z: z[:4])], own)
    df = spark.createDataFrame(rows, "document_id int, page int, n int, text string, md string, x0 double, y0 double, x1 double, y1 double, size double")
    made = pages.page_markdown(df, spark.createDataFrame(tables, "document_id int, page int, y0 double, md array<string>"))
    got = {r.page: r.out for r in made.collect()}
    assert {p: [x.rstrip() for x in v] for p, v in got.items()} == {p: [x.rstrip() for x in v] for p, v in want.items()}


def png(width, height, value):
    rows = b"".join(b"\0" + bytes(value(x, y) for x in range(width)) for y in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_are_decoded_once_and_gated(spark):
    flat, sharp = png(300, 260, lambda x, y: 9), png(300, 260, lambda x, y: 255 * ((x + y) % 2))
    assert images.laplacian_variance(images.decode_png(flat)) == 0 and images.laplacian_variance(images.decode_png(sharp)) > 1000
    rows = [("a", flat, 300, 260), ("b", sharp, 300, 260), ("b", sharp, 300, 260), ("c", sharp, 100, 100), ("d", b"no image", None, None)]
    df = spark.createDataFrame(rows, "digest string, blob binary, width int, height int")
    assert sorted((r.digest, r.unreadable) for r in images.readable(df).collect()) == [("a", "blurry"), ("b", None), ("b", None), ("c", "low resolution"), ("d", None)]
    out = images.transcribed(df, client.answer(client.StandIn("a chart")), client.answer(client.StandIn("- one\n- two"))).collect()
    assert {(r.digest, r.skipped, r.md) for r in out} == {("a", "blurry", None), ("b", None, "> - one\n> - two"), ("c", "low resolution", None), ("d", None, "> - one\n> - two")}
    assert one(spark, images.page_text(F.lit(None).cast("string"), F.lit("\n# T\n\nx"), F.lit("raw")), a="") == "x"


def deck():
    a, p, r = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda ph, body, n=1: f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="s{n}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'
    para = lambda text, look="", style="": f"<a:p>{look}<a:r><a:rPr {style}/><a:t>{text}</a:t></a:r></a:p>"
    body = para("first") + para("bold", "", 'b="1" i="1"') + "<a:p/>" + para("under", '<a:pPr lvl="1"><a:buChar char="-"/></a:pPr>') + para("num", "<a:pPr><a:buAutoNum/></a:pPr>") + para("plain", "<a:pPr><a:buNone/></a:pPr>")
    table = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="t"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h|</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p><a:p><a:r><a:t>y</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="7" name="Pic 1"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="30" cy="40"/></a:xfrm></p:spPr></p:pic>'
    slide = lambda inner: f'<p:sld {a} {p} {r}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{inner}</p:spTree></p:cSld></p:sld>'
    rel = lambda *to: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{kind}/{k}" Target="{t}"/>""" for i, (k, t) in enumerate(to, 1))}</Relationships>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {p} {r}><p:sldIdLst><p:sldId id="1" r:id="rId1"/><p:sldId id="2" r:id="rId2"/></p:sldIdLst><p:sldSz cx="100" cy="50"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("slide", "slides/slide1.xml"), ("slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape('<p:ph type="title"/>', para("A *t*")) + shape('<p:ph idx="1"/>', body, 2) + shape('<p:ph type="ftr"/>', para("foot"), 3) + shape('<p:ph type="sldNum"/>', para("1"), 4) + table),
        "ppt/slides/_rels/slide1.xml.rels": rel(("notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": f'<p:notes {a} {p}><p:cSld><p:spTree>{shape("""<p:ph type="body"/>""", para("n1") + para("n2"))}</p:spTree></p:cSld></p:notes>',
        "ppt/slides/slide2.xml": slide(f"<p:grpSp>{picture}</p:grpSp>" + picture),
        "ppt/slides/_rels/slide2.xml.rels": rel(("slideLayout", "../x.xml"), ("image", "../media/image1.png")),
        "ppt/media/image1.png": png(4, 4, lambda x, y: 1),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_a_deck_becomes_markdown(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d e.pptx").write_bytes(deck())
    (tmp_path / "in" / "bad.pptx").write_bytes(b"no zip")
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "note.txt").write_text("x")
    rows = cli.convert(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "note.txt")], str(tmp_path / "out")).collect()
    assert [(os.path.basename(r.source), r.error is None) for r in rows] == [("bad.pptx", False), ("d e.pptx", True), ("x.pdf", False), ("note.txt", False)]
    digest = __import__("hashlib").md5(png(4, 4, lambda x, y: 1)).hexdigest()[:8]
    shown = f"![Pic 1](assets/d%20e/d%20e_01_{digest}.png)"
    assert (tmp_path / "out" / "d e.md").read_text() == "\n".join([
        "# A \\*t\\* — Slide 1", "", "- first", "- ***bold***", "", "  - under", "1. num", "plain", "", "*foot*", "", "| h\\| |", "| --- |", "| x<br>y |", "", "> **Notes:**", "> n1", "> n2", "",
        "", grounding.PAGE_BREAK, "", "---", "", "# Slide 2", "", shown, "", shown, "", "", grounding.PAGE_BREAK, "", "---", "",
    ]).rstrip() + "\n"
    assert os.listdir(tmp_path / "out" / "assets" / "d e") == [f"d e_01_{digest}.png"]
    assert cli.main([str(tmp_path / "in" / "d e.pptx"), "-o", str(tmp_path / "o2"), "-q"], spark) == 0
    assert cli.main([str(tmp_path / "in" / "bad.pptx"), "-q"], spark) == 1
    region = slides.chart_regions(spark.createDataFrame([("s", 1, 0, "chart", 10, 5, 20, 10, 100, 50)], "source string, slide int, ord int, kind string, `left` long, `top` long, width long, height long, slide_w long, slide_h long"), F.lit(720.0), F.lit(540.0)).first()
    assert (region.x0, region.y0, region.x1, region.y1) == (72.0, 54.0, 216.0, 162.0)


def test_settings_and_passes():
    own = config.Config().enabled("classify").with_values({"CHAT_URL": "u"})
    assert own.vision and own.classify and not own.summary and own.chat_url == "u"
    with pytest.raises(ValueError):
        config.Config().with_values({"nope": "1"})
    assert cli.config(cli.parser().parse_args(["x", "--all"])).summary


def test_statements_need_grounded_parts(spark):
    reply = "alpha | uses | beta\nalpha | uses | beta\nalpha | uses | unknown\nalpha | | beta\nal | uses | beta\nMeaning: it works.\n\nwell | so | it"
    df = spark.createDataFrame([(1, reply, ['"Alpha node"', "USES", "beta"])], "reply_id int, reply string, labels array<string>")
    row = grounding.statements(df).first()
    assert row.triples == [["alpha", "uses", "beta"]] and row.meaning == "it works. well | so | it"


def test_a_rewrite_keeps_anchors_and_words(spark):
    slide = f"# Title\n\nseveral words here\n\n{grounding.PAGE_BREAK}\n\n---\n\n"
    rows = [(0, slide, "# Title\n\n- several words here"), (1, slide, "Title several words here"), (2, slide, "# Title\n\nwords here"), (3, slide, "# Title\n\nseveral words here invented"), (4, "# Only\n> q", "# Only")]
    got = {r.k: r for r in grounding.rewrite_gate(spark.createDataFrame(rows, "k int, md string, rewritten string")).collect()}
    assert got[0].accepted and got[0].result == f"# Title\n\n- several words here\n\n{grounding.PAGE_BREAK}\n\n---"
    assert [got[k].accepted for k in (1, 2, 3, 4)] == [False] * 4 and got[1].lost == 1 and got[3].added == ["invented"] and not got[4].eligible
    assert all(got[k].result == rows[k][1] for k in (1, 2, 3, 4))


def test_enumerated_gists(spark):
    assert one(spark, images.gist_reason(F.col("a"), F.lit("diagram")), a="\n".join(f"- i{k} x" for k in "abcdefg")) == "enumerated"
    assert one(spark, images.gist_reason(F.col("a"), F.lit("text")), a="\n".join(f"- i{k} x" for k in "abcdefg")) is None


def test_attached_transcripts_are_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# A\n\nbody\n"), ("b", "# B\n")], "stem string, md string")
    replies = spark.createDataFrame([("a", json.dumps({"segments": [{"start": 0, "end": 2, "text": " hi "}, {"text": " "}, {"start": 3.5, "end": 4, "text": "you"}]}))], "stem string, json string")
    said = media.segments_of(replies, "stem").withColumnsRenamed({"start": "seg_start", "end": "seg_end"}).withColumn("speaker", F.lit(None).cast("string"))
    once = sink.attached(docs, said, "m")
    again = sink.attached(once, said, "m")
    assert sorted(once.collect()) == sorted(again.collect())
    text = {r.stem: r.md for r in once.collect()}
    assert text["b"] == "# B\n" and text["a"].startswith("# A\n\nbody\n\n# Transcript\n") and "[00:00:04] you" in text["a"]
    taken = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3)], "stem string, version int")
    made = sink.transcript_files(said, taken, "m").collect()
    assert {r.path for r in made} == {"a.transcript.2.md", "a.transcript.2.srt"}
    wrote = sink.write_files(spark.createDataFrame([(str(tmp_path / "x" / "t.md"), "text")], "path string, content string")).collect()
    assert wrote[0].error is None and os.listdir(tmp_path / "x") == ["t.md"]
    named = cli.transcribe(spark, docs.withColumn("path", F.concat(F.lit(str(tmp_path) + "/"), "stem", F.lit(".md"))), replies, spark.createDataFrame([("a", '[{"start": 0, "end": 3, "speaker": "S"}]')], "stem string, json string"), "m").collect()
    assert len(named) == 1 and "**S:** hi" in (tmp_path / "a.md").read_text()


def test_polished_and_reported(spark):
    docs = spark.createDataFrame([("p", "# a\nb  \n"), ("q", "# a\n\nb\n")], "path string, md string")
    assert [(r.path, r.content) for r in sink.polished_files(docs).collect()] == [("p", "# a\n\nb\n")]
    results = spark.createDataFrame([("s", "m", None, ["w"]), ("t", None, "bad", None)], "source string, md_path string, error string, warnings array<string>")
    assert {(r.line, r.exit_code) for r in sink.report(results).collect()} == {("[OK] s -> m", 1), ("[WARN] w", 1), ("[ERR] t: bad", 1), ("Done: 1 of 2 converted", 1)}


def test_store_merges_and_replaces(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s")).open()
    assert own.setting("schema_version") == "1"
    own.set_setting("k", "1")
    own.set_setting("k", "2")
    assert own.setting("k") == "2" and own.setting("none") is None
    at = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    use = lambda p, n: spark.range(1).select(F.lit(p).alias("path"), at(n).alias("last_used"))
    own.record_recent(use("a", 1).unionByName(use("b", 2)))
    own.record_recent(use("a", 3))
    assert [r.path for r in own.recent(5).collect()] == ["a", "b"]
    doc = lambda h, n: spark.range(1).select(F.lit("x.pptx").alias("source"), F.lit(h).alias("source_hash"), F.lit("x").alias("stem"), F.lit(2).alias("slide_count"), at(n).alias("updated_at"))
    number = own.upsert_documents(doc("h1", 1)).first().document_id
    own.upsert_documents(doc("h2", 4))
    row = own.read("deck_documents").first()
    assert (row.source_hash, row.created_at.day, row.updated_at.day) == ("h2", 1, 4)
    chunk = lambda *texts: spark.createDataFrame([(number, i, "t", t, t) for i, t in enumerate(texts)], "document_id long, chunk_index int, title string, content string, content_hash string")
    embed = client.embedding()
    assert own.index_chunks(chunk("a", "b", "c"), embed).count() == 3
    assert [r.chunk_index for r in own.index_chunks(chunk("a", "changed"), embed).collect()] == [1]
    assert [r.content for r in own.chunks(number).collect()] == ["a", "changed"] and own.read("deck_vectors").count() == 2
    assert own.append("vision_events", spark.range(2).select(F.lit("s").alias("source"))) is None and own.read("vision_events").count() == 2


def test_models_retry_and_fall_back(spark):
    calls = spark.createDataFrame([("a",), (None,)], "t string")

    def failing(messages):
        raise OSError("down")

    rows = calls.select(client.chat(failing)(F.col("t")).alias("r")).select("r.*").collect()
    assert rows[0].text is None and rows[0].error == "down" and rows[1].error is None
    decks = spark.createDataFrame([(1, "/x/d.pptx", "# One — Slide 1\n\n- a\n\n# Slide 2\n\nb")], "document_id int, source string, md string")
    day = F.lit("2024-01-02").cast("date")
    fall = summarise.headers(decks, day, client.answer(client.StandIn("nothing"))).first()
    assert fall.used == "titles" and fall.md.startswith("# Summary\n\n## Abstract\nOne\n\n## Key Topics\n- One\n\n## Metadata\n- Source: d.pptx\n- Slides: 2\n- Converted: 2024-01-02\n\n# One")
    good = summarise.headers(decks, day, client.answer(client.StandIn("## Abstract\nAll.\n## Key Topics\n- t\n## Key Takeaways\n- k"))).first()
    assert good.used == "reply" and "## Key Takeaways\n- k" in good.md


def test_voices_and_windows(spark):
    t = np.arange(60)
    a, b = np.sin(t), 5 * np.cos(t * 0.7)
    rows = [("s", 0, 0, 30, 60, [a[:30].tolist(), b[:30].tolist()], [i < 3 for i in range(30)]), ("s", 1, 25, 60, 60, [b[25:].tolist(), a[25:].tolist()], None)]
    df = spark.createDataFrame(rows, "source string, nth int, begin long, end long, total long, signals array<array<double>>, speech array<boolean>")
    first = media.pick_voice(np.array([a[:30], b[:30]]).T, np.array([i < 3 for i in range(30)]))
    got = {r.nth: r["values"] for r in media.voices(df).collect()}
    assert got[0] == [a, b][first][:30].tolist() and got[1] == [a, b][first][25:].tolist()
    joined = sorted(media.overlap_add(media.voices(df), 5).collect(), key=lambda r: r["at"])
    assert np.allclose([r.value for r in joined], [a, b][first][:60])
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    assert [r.x for r in spark.createDataFrame([(sound.getvalue(),), (b"x",)], "c binary").select(inputs.wave_seconds("c").alias("x")).collect()] == [0.5, None]


def test_streams_keep_tails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"job": "j", "at": f"2024-01-01T00:00:{i:02d}Z", "line": f"l{i}"}) for i in range(15)))
    query = stream_lines.tails(stream_lines.lines(spark, str(tmp_path / "in")), 3).writeStream.format("memory").queryName("tails").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert stream_lines.run_for(query, 120)
    assert [r.tail for r in spark.table("tails").collect()] == [["l12", "l13", "l14"]]
    beat = stream_lines.heartbeats(stream_lines.lines(spark, str(tmp_path / "in")), 1000).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    for _ in range(60):
        time.sleep(1)
        if spark.table("beats").where("kind = 'silent'").count():
            break
    beat.stop()
    assert spark.table("beats").where("kind = 'silent'").count() >= 1 and spark.table("beats").where("kind = 'line'").count() == 15


def test_readers_can_be_registered(spark):
    inputs.register(".LMX", pptx.shapes)
    assert ".lmx" in inputs.supported()
    inputs.READERS.pop(".lmx")
