"""Tables on pages, labels by index, as-of joins, event time, sketches, buckets of the store, remembered answers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from test_engine import deck

from leafmill import cli
from leafmill.functions import text as T
from leafmill.models import client, memo, summarise
from leafmill.operators import asof, documents, grounding, log, slides, tables
from leafmill.sinks.store import BUCKETS, Store
from leafmill.sources import pptx
from leafmill.streaming import events as S

LINES = "document_id int, page int, n int, x0 double, y0 double, x1 double, y1 double, md string, text string"


def lines(spark, rows):
    return spark.createDataFrame([(1, p, n, float(x0), float(y0), float(x1), float(y0 + 8), md, md) for p, n, x0, y0, x1, md in rows], LINES)


def test_tables_are_found_and_left_out_of_the_text(spark):
    head = [(1, 0, 0, 0, 300, "A paragraph as wide as the page")]
    grid = [(1, 1, 0, 20, 40, "a|b"), (1, 2, 100, 21, 140, "c"), (1, 3, 200, 20, 240, "d"), (1, 4, 0, 40, 45, "1"), (1, 5, 102, 40, 130, "2"), (1, 6, 0, 60, 30, "x"), (1, 7, 33, 60, 50, "y"), (1, 8, 105, 62, 150, "z")]
    below = [(1, 9, 0, 100, 300, "Text below"), (2, 0, 0, 0, 50, "two"), (2, 1, 100, 0, 150, "columns once"), (3, 0, 0, 0, 50, "one line")]
    df = lines(spark, head + grid + below)
    found = tables.detect(df).collect()
    assert [(r.page, r.nth, r.n_rows, r.n_cols, r.x0, r.y0, r.x1, r.y1) for r in found] == [(1, 1, 3, 3, 0.0, 20.0, 240.0, 70.0)]
    # y begins before the first column ends
    assert found[0].cells == [["a|b", "c", "d"], ["1", "2", ""], ["x y", "z", ""]]
    out = {r.page: r.out for r in tables.flow(df).collect()}
    assert out[1][0] == "A paragraph as wide as the page" and out[1][1].startswith("| a\\|b |") and out[1][2].startswith("| ---") and out[1][-1] == "Text below"
    assert tables.detect(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [grounding.MOST, 0])
def test_labels_by_index_equal_all_pairs(spark, most):
    r = random.Random(4)
    some = lambda n: "".join(r.choice("ab C'`é*  ") for _ in range(n))
    candidates = [(i, i % 3, some(r.randrange(12))) for i in range(300)] + [(900, 0, None), (901, None, "abc"), (902, 0, "  ")]
    labels = [(i % 3, some(r.randrange(9))) for i in range(60)] + [(0, None), (None, "abc"), (1, "a" * 40)]
    c, k = spark.createDataFrame(candidates, "id int, key int, text string"), spark.createDataFrame(labels, "key int, label string")
    want = c.join(k, "key").where(T.labels_match(F.col("text"), F.col("label"))).select("key", "id").distinct().collect()
    got = grounding.label_pairs(c, k, "key", most=most).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 0 < len(want) < 300


def test_label_keys_equal_patterns(spark):
    r = random.Random(5)
    signs = T._WHITE_SIGNS + "\"\u201c\u2019`*" * 3 + "aB\u00c9\u200b\u2003" * 4
    rows = [("".join(r.choice(signs) for _ in range(r.randrange(9))),) for _ in range(3000)] + [(None,)]
    quotes = "\"\u201c\u201d\u2018\u2019`*"
    bare = F.regexp_replace(T.strip(F.col("t")), f"^[{quotes}]+|[{quotes}]+$", "")
    want, got = F.lower(T.strip(F.regexp_replace(bare, f"[{T.WHITE}]+", " "))), T.label_key(F.col("t"))
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~got.eqNullSafe(want) | ((got == "") != (T.bare_label(F.col("t")) == ""))).count() == 0


def test_last_row_as_of(spark):
    r = random.Random(2)
    left = [(i, r.choice(["hot"] * 8 + ["a", None]), r.choice([None, *range(100)])) for i in range(400)]
    right = [(r.choice(["hot"] * 3 + ["a", "b", None]), r.randrange(100) if i else None, i) for i in range(80)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    got = {x.i: x.found and x.found.v for x in asof.asof(a, b, "k", "t", F.floor(F.col("t") / 7), "v").collect()}
    for i, k, t in left:
        own = [(y, v) for x, y, v in right if x == k and y is not None and t is not None and y <= t]
        assert got[i] == (max(own)[1] if own else None)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def some_events():
    r, at = random.Random(1), dt.datetime(2024, 1, 1)
    return [(i, at + dt.timedelta(seconds=i * 60 + r.randrange(50)), r.randrange(4), r.choice(["view", "click"]), float(i)) for i in range(200)]


def stream(spark, tmp_path, batches):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (part,) = [f for f in os.listdir(tmp_path / f"w{n}") if f.endswith(".parquet")]
        os.replace(tmp_path / f"w{n}" / part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (n + 1, n + 1))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return df.sparkSession.table(name)


def test_closed_sessions_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rows = some_events()
    last = (999, dt.datetime(2024, 1, 3), 77, "view", 0.0)  # moves the watermark behind all others
    flow = stream(spark, tmp_path, [rows[:70], rows[70:150], rows[150:], [last]])
    got = drained(S.sessions(flow, "5 minutes", "10 minutes"), tmp_path, "closed").where("user_id <> 77")
    want = S.sessions(spark.createDataFrame(rows, EVENTS), "5 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_followers_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rows = some_events()
    flow = stream(spark, tmp_path, [rows[:90], rows[90:]])
    got = drained(S.followed(flow.where("event_type = 'view'"), flow.where("event_type = 'click'"), "7 minutes"), tmp_path, "behind")
    both = spark.createDataFrame(rows, EVENTS)
    want = [(a[0], b[0], a[2]) for a in rows for b in rows if a[2] == b[2] and a[3] == "view" and b[3] == "click" and dt.timedelta(0) < b[1] - a[1] <= dt.timedelta(minutes=7)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, S.followed(both.where("event_type = 'view'"), both.where("event_type = 'click'"), "7 minutes").collect())) == sorted(want)


def test_late_rows_have_a_sink_of_their_own(spark, tmp_path):
    rows = some_events()
    late, near = (500, dt.datetime(2024, 1, 1), 9, "view", 1.0), (501, rows[99][1] - dt.timedelta(minutes=5), 9, "view", 1.0)
    flow = stream(spark, tmp_path, [rows[:100], [late, near], rows[100:]])
    to = lambda where: lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / where / f"batch={n}"))
    part = S.parted(to("on"), to("late"), str(tmp_path / "state"), 600)
    assert flow.writeStream.foreachBatch(part).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    ids = lambda where: sorted(r.event_id for r in spark.read.parquet(str(tmp_path / where)).collect())
    assert ids("late") == [500] and ids("on") == sorted([501, *range(200)])
    part(spark.createDataFrame([late, near], EVENTS), 1)  # a batch that is tried again is parted as before
    assert ids("late") == [500] and ids("on") == sorted([501, *range(200)])


def test_merged_sketches_are_near_the_exact_values(spark):
    r = random.Random(3)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=20 * i), r.randrange(3000), "view", r.gauss(100, 30)) for i in range(20_000)]
    events = spark.createDataFrame(rows, EVENTS)
    got = {x.day: x for x in log.spans(log.sketches(events), F.to_date("hour"), "day").collect()}
    for day, own in {d: [x for x in rows if x[1].date() == d] for d in got}.items():
        users, values = len({x[2] for x in own}), sorted(x[4] for x in own)
        assert got[day].n == len(own) and abs(got[day].users - users) <= 3 * 0.0163 * users
        for q, x in ((0.5, got[day].p50), (0.9, got[day].p90), (0.99, got[day].p99)):
            rank = sum(v <= x for v in values) / len(values)
            assert abs(rank - q) <= 0.0265  # the bound of k = 200 at 99 %, doubled for merged sketches


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_of_one_document_rewrites_one_bucket(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    schema = "document_id long, chunk_index int, title string, content string, content_hash string"
    chunk = lambda d, *texts: spark.createDataFrame([(d, i, "t", t, t) for i, t in enumerate(texts)], schema)
    every = chunk(0, "a", "b")
    for d in range(1, 40):
        every = every.unionByName(chunk(d, "a", f"b{d}"))
    assert own.index_chunks(every, client.embedding()).count() == 80
    before = {t: files_of(f"{own.path}/{t}") for t in ("deck_chunks", "deck_vectors")}
    assert own.index_chunks(chunk(7, "a", "new", "more"), client.embedding()).count() == 2
    for name, old in before.items():
        now = files_of(f"{own.path}/{name}")
        gone = {os.path.dirname(f) for f in old if f not in now or now[f] != old[f]}
        assert len(gone) == 1 and {os.path.dirname(f) for f in now if f not in old} == gone
    assert [r.content for r in own.chunks(7).collect()] == ["a", "new", "more"] and own.read("deck_vectors").count() == 81
    assert own.index_chunks(chunk(7, "a", "new", "more"), client.embedding()).count() == 0 and own.read("deck_chunks").count() == 81
    # vectors of another width empty the index
    assert own.index_chunks(chunk(7, "a", "new", "more"), client.embedding(width=8)).count() == 3
    assert own.read("deck_chunks").count() == 3 and {len(r.embedding) for r in own.read("deck_vectors").collect()} == {8}
    plan = own.of("deck_chunks", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert BUCKETS >= len({os.path.dirname(f) for f in files_of(f"{own.path}/deck_chunks")})


def test_logs_are_read_by_source(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.concat(F.lit("s"), F.col("id") % 9).alias("source"), F.lit("x").alias("text"), F.col("id").cast("double").alias("start"))
    assert own.append("transcript_segments", rows) is None and own.append("transcript_segments", rows) is None
    one = own.of("transcript_segments", "s4")
    assert one.count() == 44 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert own.read("transcript_segments").where("day = '1970-01-02'").count() == 48


def test_answers_are_asked_for_once_ever(spark, tmp_path):
    own, calls = Store(spark, str(tmp_path / "s")), tmp_path / "calls"

    def asking(messages):
        text = messages[0]["content"]
        with open(calls, "a") as out:
            out.write(text + "\n")
        if text == "bad":
            raise OSError("down")
        return {"text": f"<{text}>"}

    rows = spark.createDataFrame([("d1", "x"), ("d1", "x"), ("d2", "y"), ("d3", "bad"), (None, "z")], "digest string, request string")
    ask = client.answer(asking)
    found = lambda df: sorted(((r.digest, r.answer) for r in df.collect()), key=str)
    want = [("d1", "<x>"), ("d1", "<x>"), ("d2", "<y>"), ("d3", None), (None, None)]
    first = memo.remembered(own, rows, "gist", ask)
    assert found(first) == found(first) == sorted(want, key=str)
    assert sorted(calls.read_text().split()) == ["bad", "bad", "x", "y"]  # a failed call is tried once more
    calls.write_text("")
    assert found(memo.remembered(own, rows, "gist", ask)) == sorted(want, key=str)
    assert calls.read_text().split() == ["bad", "bad"]
    calls.write_text("")
    memo.remembered(own, rows.where("digest = 'd1'"), "other", ask).count()
    assert calls.read_text().split() == ["x"]


def test_blank_slides_are_slides(spark):
    import io
    import zipfile

    old = deck()
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(old)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            text = a.read(name)
            if name == "ppt/slides/slide1.xml":
                head, rest = text.split(b"<p:spTree>")[0], b"</p:spTree></p:cSld></p:sld>"
                text = head + b"<p:spTree><p:nvGrpSpPr/><p:grpSpPr/>" + rest
            if name.startswith("ppt/slides/_rels/slide1"):
                continue
            b.writestr(name, text)
    shapes = pptx.shapes(spark.createDataFrame([("d.pptx", out.getvalue())], "source string, content binary"))
    md = slides.deck_markdown(shapes).first().lines
    assert [x for x in md if x.startswith("# ")] == ["# Slide 1", "# Slide 2"] and md.count(grounding.PAGE_BREAK) == 2
    assert md[:6] == ["# Slide 1", "", "", grounding.PAGE_BREAK, "", "---"]
    # the picture is on one slide of two, twice: blank slides count
    assert not slides.pictures(shapes).where("recurs").count()


def test_the_break_of_a_document_is_peeled(spark):
    md = '# T\n\nbody\n\n<div style="page-break-after: always; break-after: page;"></div>\n\n---\n'
    body, trailer = grounding.peeled(F.col("md"))
    row = spark.createDataFrame([(md,)], "md string").select(body.alias("b"), trailer.alias("t")).first()
    assert row.b == ["# T", "", "body"] and row.t == [grounding.PAGE_BREAK, "", "---"]


def test_missing_inputs_and_passes(spark, tmp_path, capsys):
    (tmp_path / "d.pptx").write_bytes(deck())
    rows = cli.convert(spark, [str(tmp_path / "none.pptx"), str(tmp_path / "d.pptx")], str(tmp_path / "out")).collect()
    assert [r.error for r in rows] == ["no such file", None]
    assert cli.main([str(tmp_path / "d.pptx"), "--all"], spark) == 2 and "summary" in capsys.readouterr().err


def test_slides_are_looked_up_within_their_deck(spark):
    md = "# Aims — Slide 1\n\nsubject and aims of the presentation\n\n# Slide 2\n\nzebra\n\n# Slide 3\n\nconclusions and main points"
    decks = spark.createDataFrame([(1, "/x/a.pptx", md), (2, "/x/b.pptx", md)], "document_id int, source string, md string")
    rows = documents.slides(decks.select("document_id", "md"))
    pick = lambda k: sorted((r.document_id, r.slide) for r in summarise.retrieved(rows, client.embedding(width=64), k).collect())
    assert pick(summarise.EVERY) == [(d, n) for d in (1, 2) for n in (1, 2, 3)]
    assert {(1, 1), (1, 3), (2, 1), (2, 3)} <= set(pick(1))
    reply = "## Abstract\nAll.\n## Key Topics\n- t\n## Key Takeaways\n- k"
    out = summarise.headers(decks, F.lit("2024-01-02").cast("date"), client.answer(client.StandIn(reply)), client.embedding()).orderBy("document_id").collect()
    assert [r.used for r in out] == ["reply", "reply"] and all(r.md.startswith("# Summary\n") and "- Source: " in r.md and "# Aims — Slide 1" in r.md for r in out)


def test_decks_and_markdown_as_a_data_source(spark, tmp_path):
    from leafmill.sources import datasource

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "b.pptx").write_bytes(deck())
    (tmp_path / "in" / "bad.pptx").write_bytes(b"no zip")
    (tmp_path / "in" / "deep" / "a.MD").write_text("# Text\n", encoding="utf-8")
    (tmp_path / "in" / "x.txt").write_text("x")
    datasource.register(spark)
    read = lambda *paths, **more: spark.read.format("leafmill").options(paths="\n".join(map(str, paths)), **more).load()
    df = read(tmp_path / "in", tmp_path / "gone.pptx", tmp_path / "in" / "x.txt", tmp_path / "in" / "b.pptx", files=1)
    assert df.rdd.getNumPartitions() == 5
    errors = {os.path.basename(r.source): r.error.split(":")[0] for r in df.where("error is not null").collect()}
    assert errors == {"bad.pptx": "BadZipFile", "gone.pptx": "FileNotFoundError", "x.txt": "ValueError"}
    texts = read(tmp_path / "in", files=1).where("suffix = '.md'")
    assert [r.markdown for r in texts.collect()] == ["# Text\n"] and texts.rdd.getNumPartitions() == 1
    assert read(tmp_path / "in", recursive="false").where("suffix = '.md'").count() == 0
    lines = slides.deck_markdown(df.where("suffix = '.pptx'").drop("suffix", "markdown")).collect()
    assert [x for x in lines[0].lines if x.startswith("# ")] == ["# A \\*t\\* — Slide 1", "# Slide 2"]
