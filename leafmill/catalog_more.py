"""Further queries of the engine: pages, text rules, summaries, gates, images, media and tables, each with DuckDB SQL for the same rows where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import documents as D
from leafmill.operators import grounding as G
from leafmill.operators import images as I
from leafmill.operators import media as E
from leafmill.operators import pages as P
from leafmill.operators import slides as L
from leafmill.operators import summary as U
from leafmill.plans import adapters as A
from leafmill.sinks import store
from leafmill.sources.inputs import expand
from leafmill.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]

_BREAK = G.PAGE_BREAK


def _deck_slides(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations").selectExpr("conv_id as document_id", "turn as chunk_index", "repeat(text, 1 + cast(turn % 3 as int) * 4) as content", "role")
    return rows


def _tables_of_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey % 40 as document_id", "o_orderkey as page", "10D as x0", "35D as y0", "60D as x1", "60D as y1")


def _rewrites(s: SparkSession, d: str) -> DataFrame:
    """Slides with a page break behind some, and rewrites that keep all, lose a heading, lose words, or invent one."""
    md = f"concat('# ', role, '\\n\\n', text, if(turn % 2 = 0, '\\n\\n{_BREAK}\\n\\n---\\n', ''))"
    new = "case cast(turn % 4 as int) when 0 then concat('# ', role, '\\n\\n- ', text, ' ') when 1 then concat('#  ', role, '\\n\\n', text) when 2 then concat('# ', role, '\\n\\nshorter') else concat('# ', role, '\\n\\n', text, ' inventedword') end"
    return table(s, d, "conversations").selectExpr("conv_id", "turn", f"{md} as md", f"{new} as rewritten")


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Lines of three parts of the text's own words, doubled, broken and foreign ones, then prose."""
    w = "split(text, ' ')"
    reply = f"concat({w}[0], ' | ', {w}[1], ' | ', {w}[2], '\\n', {w}[0], ' | ', {w}[1], '\\n', {w}[0], ' | ', {w}[1], ' | ', {w}[2], '\\nzzzzqqq | ', {w}[1], ' | ', {w}[2], '\\nMeaning: it ', {w}[3], '\\n\\n goes on ')"
    return table(s, d, "conversations").where("size(split(text, ' ')) > 4").selectExpr("conv_id * 1000 + turn as reply_id", f"{reply} as reply", f"transform(slice({w}, 1, 3), x -> concat('\"', upper(x), '\"')) as labels")


def _sections(s: SparkSession, d: str) -> DataFrame:
    md = "concat('intro\\n## Abstract\\n\\n', text, '\\n## Key Topics\\n- ', role, '\\nnone\\n- two \\n', if(turn % 2 = 0, '## Key Takeaways\\n- one\\n', ''), '## Key Terms\\n**', role, '** — x\\n\\n## topic again\\n- three\\n')"
    return table(s, d, "conversations").selectExpr("conv_id * 1000 + turn as document_id", f"{md} as md")


def _phrases(rows: DataFrame, id: str, name: str) -> DataFrame:
    """All phrases between the signs of a text, under one key, which so holds all rows."""
    return rows.select(id, F.posexplode(F.split("text", r"[.,;:!?\n]+")).alias("nth", name)).select(F.lit(1).alias("key"), F.struct(id, "nth").alias("id"), name)


def _hits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").selectExpr("label as document_id", "vec_id % 3 as query", "vec_id as rank", "(vec_id * 7) % 50 as chunk_id")


def _artefacts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_custkey % 5 > 0").selectExpr("concat('lec', c_custkey % 200) as stem", "cast(c_nationkey % 4 as int) as version")


QUERIES: dict[str, Query] = {
    "row_anchoring": lambda s, d: P.rows_of(A.page_lines(s, d)).select("page", "n", "row", "at"),
    "complex_pages": lambda s, d: P.complexity(A.page_lines(s, d)).select("page", "edges", "gap_rows", "is_complex"),
    "page_titles": lambda s, d: P.titles(A.page_lines(s, d)).select("page", "title"),
    "bullet_levels": lambda s, d: P.bullet_levels(A.page_lines(s, d)).select("page", "edge", "level"),
    "content_lines": lambda s, d: P.content_lines(A.page_lines(s, d), D.repeated_footers(A.page_lines(s, d).withColumn("y0", F.col("y0") + 450), A.page_sizes(s, d)), _tables_of_pages(s, d)).select("page", "n"),
    "page_flow": lambda s, d: P.page_markdown(A.page_lines(s, d), _tables_of_pages(s, d).withColumn("md", F.array(F.lit("| a |"), F.lit("| --- |")))).select("page", F.md5(F.array_join("out", "\n").cast("binary")).alias("md")),
    "raw_pages": lambda s, d: P.raw_text(A.page_lines(s, d)).select("page", T.details(F.lit("Raw extracted text"), F.col("raw")).alias("md")),
    "span_runs": lambda s, d: P.lines_of_spans(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p")).selectExpr("1L as document_id", "l_orderkey as page", "cast(l_orderkey % 3 as int) as line_ord", "l_linenumber as span_ord", "concat(if(p % 3 = 0, ' ', ''), 'w_', p, if(p % 4 = 0, '  ', '')) as text", "if(p % 2 = 0, 16, 2) as flags", "10D as size", "1D as x0", "2D as y0", "3D as x1", "4D as y1")).select("page", "n", "md"),
    "emphasis": lambda s, d: table(s, d, "part").select("p_partkey", T.emphasis(F.concat(F.lit("#a_b*"), F.col("p_partkey")), F.expr("p_partkey % 2 = 0"), F.expr("p_partkey % 3 = 0")).alias("md")),
    "paragraphs": lambda s, d: table(s, d, "part").select("p_partkey", T.paragraph(F.expr("if(p_partkey % 7 = 0, ' ', concat('p', p_partkey))"), F.expr("cast(p_partkey % 3 as int)"), F.expr("element_at(array('bullet', 'number', 'none', null), 1 + cast(p_partkey % 4 as int))"), F.expr("p_partkey % 5 = 0")).alias("md")),
    "bullet_split": lambda s, d: A.page_lines(s, d).select("page", "n", T.bullet_glyph(F.col("md")).alias("glyph"), T.after_bullet(F.col("md")).alias("rest")),
    "mime_types": lambda s, d: table(s, d, "part").select("p_partkey", T.mime_type(F.expr("element_at(array('.PNG', 'jpg', 'jpeg', '..gif', 'webp', 'xyz', null), 1 + cast(p_partkey % 7 as int))")).alias("mime")),
    "data_urls": lambda s, d: table(s, d, "nation").select("n_nationkey", T.data_url(F.col("n_name").cast("binary"), F.lit("jpg")).alias("url")),
    "categories": lambda s, d: table(s, d, "documents").select("doc_id", T.category(F.col("text")).alias("category")),
    "gated_categories": lambda s, d: A.images(s, d).groupBy(I.gated_category(F.expr("if(width % 3 = 0, 'A Chart', 'logo')"), F.expr("width % 7 = 0"), F.col("width"), F.col("height")).alias("category")).agg(F.count("*").alias("n")),
    "gist_reasons": lambda s, d: A.drafts(s, d).select("doc_id", I.gist_reason(F.expr("concat('- ', replace(md, ' ', '\\n- w'))"), F.expr("if(doc_id % 2 = 0, 'diagram', 'text')")).alias("reason")),
    "blockquotes": lambda s, d: A.drafts(s, d).select("doc_id", F.md5(T.blockquote(F.col("md")).cast("binary")).alias("quote")),
    "label_keys": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.label_key(F.expr("concat(' \"**', text, '`\" ')")).cast("binary")).alias("label")),
    "elapsed_times": lambda s, d: table(s, d, "orders").select("o_orderkey", T.elapsed(F.expr("(o_orderkey * 37) % 9000 + 0.75D")).alias("took")),
    "emu_points": lambda s, d: table(s, d, "part").select("p_partkey", F.round(T.points(F.expr("p_partkey * 12700L"), F.lit(12192000), F.lit(960.0)), 6).alias("pt")),
    "unit_vectors": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(T.unit_vector(F.transform("embedding", lambda x: x * 3)), F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")), 4).alias("square")),
    "output_paths": lambda s, d: table(s, d, "customer").select("c_custkey", T.output_folder(F.expr("concat('/in/', c_nationkey, '/deck', c_custkey, '.pptx')")).alias("folder"), T.isolated_name(F.expr("concat('lec', c_custkey, '.clean.flac')")).alias("isolated")),
    "headless_texts": lambda s, d: A.drafts(s, d).select("doc_id", F.md5(T.without_heading(F.col("md")).cast("binary")).alias("md")),
    "bounded_samples": lambda s, d: U.bounded_sample(_deck_slides(s, d), budget=3000).select("document_id", "chunk_index"),
    "deck_characters": lambda s, d: _deck_slides(s, d).groupBy("document_id").agg(F.sum(F.length("content")).alias("chars")),
    "reply_sections": lambda s, d: U.reply_sections(_sections(s, d)).select("document_id", F.md5(F.col("abstract").cast("binary")).alias("abstract"), F.array_join("topics", "|").alias("topics"), F.array_join("takeaways", "|").alias("takeaways"), F.array_join("terms", "|").alias("terms"), "valid"),
    "summary_headers": lambda s, d: table(s, d, "nation").select("n_nationkey", U.header(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")), F.array("n_name", F.lit("b"), F.lit("c")), F.array().cast("array<string>"), F.array(F.lit("t")), U.metadata(F.concat(F.lit("/x/"), F.col("n_name")), F.col("n_regionkey"), F.lit("2024-05-06").cast("date")), F.lit(2), F.lit(3), F.lit(1)).alias("md")),
    "fallback_topics": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.expr("if(turn % 3 = 0, '', role)").alias("t")))), lambda x: x["t"]).alias("titles")).select("conv_id", U.fallback(F.col("titles"))[0].alias("abstract"), F.size(U.fallback(F.col("titles"))[1]).alias("n")),
    "retrieved_union": lambda s, d: U.first_hits(_hits(s, d), _hits(s, d).select("chunk_id").distinct().withColumn("chunk_index", F.col("chunk_id") * 3 % 50)).select("document_id", "chunk_id", "first_query", "place"),
    "statements": lambda s, d: G.statements(_replies(s, d)).select("reply_id", F.size("triples").alias("n"), "meaning"),
    "rendered_statements": lambda s, d: table(s, d, "nation").select("n_nationkey", G.rendered(F.array(F.array("n_name", F.lit("in"), F.col("n_regionkey").cast("string"))), F.expr("if(n_nationkey % 2 = 0, '', n_name)")).alias("md")),
    "grounded_labels": lambda s, d: G.label_pairs(_phrases(table(s, d, "documents"), "doc_id", "text"), _phrases(table(s, d, "benchmark"), "item_id", "label"), "key").groupBy(F.col("id.doc_id").alias("doc_id")).agg(F.count("*").alias("n")),
    "rewrite_gate": lambda s, d: G.rewrite_gate(_rewrites(s, d)).select("conv_id", "turn", "eligible", "lost", F.size("omitted").alias("omitted"), F.size("added").alias("added"), "accepted", F.md5(F.col("result").cast("binary")).alias("result")),
    "asset_names": lambda s, d: I.asset_names(A.images(s, d).groupBy("document_id", "page", "n").agg(F.min("digest").alias("digest")).selectExpr("document_id", "page", "n", "digest", "if(page % 2 = 0, '.png', null) as ext", "concat('deck', document_id) as stem")).groupBy("document_id", "filename").agg(F.count("*").alias("n")),
    "image_page_sets": lambda s, d: I.pages_of(A.images(s, d)).select("document_id", "digest", F.size("pages").alias("n"), F.array_min("pages").alias("first")),
    "page_image_sets": lambda s, d: I.contents_of(A.images(s, d)).select("document_id", "page", F.array_join("digests", ",").alias("digests")),
    "recognised_segments": lambda s, d: E.segments_of(table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.5).alias("end"), F.expr("if(turn % 3 = 0, ' ', concat(' ', role, ' '))").alias("text")))).alias("segments"))).alias("json")), "conv_id"),
    "speaker_turns": lambda s, d: E.turns_of(table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.5).alias("end"), F.expr("if(turn % 3 = 0, '', role)").alias("speaker"), F.expr("if(turn % 2 = 0, null, 'L')").alias("label"))))).alias("a")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("a")).otherwise(F.concat(F.lit('{"turns":'), F.col("a"), F.lit("}"))).alias("json")), "conv_id").select("conv_id", "turn_ord", "speaker"),
    "round_robin_turns": lambda s, d: E.round_robin(table(s, d, "customer").selectExpr("c_custkey as source", "cast(c_custkey % 30 as double) as duration"), 3).select("source", "turn_ord", "t_start", "t_end", "speaker"),
    "speech_seconds": lambda s, d: E.speech_seconds(table(s, d, "conversations").selectExpr("conv_id as source", "turn * 2D as start", "turn * 2D + turn % 4 as end")),
    "media_targets": lambda s, d: E.targets(table(s, d, "customer").selectExpr("concat('/m/lec', c_custkey, element_at(array('.md', '.transcript.md', '.WAV', '.clean.flac', '.isolated.2.flac', '.txt'), 1 + cast(c_custkey % 6 as int))) as path")).select("path", "kind"),
    "audio_targets": lambda s, d: E.audio_to_markdown(A.files(s, d).where("ext = 'wav'").selectExpr("concat(dir, '/', stem, '.wav') as path", "stem"), A.files(s, d).where("ext = 'md'").selectExpr("concat(dir, '/', stem, '.md') as path", "stem", "dir as ord").groupBy("stem").agg(F.min("path").alias("path"), F.min("ord").alias("ord"))).select("path", "md"),
    "free_versions": lambda s, d: E.free_version(_artefacts(s, d).select("stem").distinct(), _artefacts(s, d)),
    "sample_windows": lambda s, d: E.windows(table(s, d, "customer").selectExpr("c_custkey as source", "c_custkey * 37 % 900 as total"), 200, 10),
    "overlap_added": lambda s, d: E.overlap_add(E.windows(table(s, d, "nation").selectExpr("n_nationkey as source", "40L + n_nationkey as total"), 20, 4).withColumn("values", F.expr("transform(sequence(begin, end - 1), i -> cast(i as double))")), 4).select("source", "at", F.round("value", 6).alias("value")),
    "input_files": lambda s, d: expand(table(s, d, "customer").selectExpr("cast(c_nationkey as int) as arg", "concat('/in/', c_custkey % 300, element_at(array('.pptx', '.PDF', '.txt'), 1 + cast(c_custkey % 300 % 3 as int))) as path", "c_nationkey % 2 = 0 as from_folder").distinct()).select("arg", "path", "error", "ord"),
    "document_upsert": lambda s, d: store.merge_documents(
        table(s, d, "events").where("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("t")).selectExpr("user_id as document_id", "cast(user_id as string) as source", "'old' as source_hash", "'' as stem", "1 as slide_count", "cast(t as timestamp) as created_at", "cast(t as timestamp) as updated_at"),
        table(s, d, "events").where("event_id % 2 = 1").groupBy("user_id").agg(F.max("ts").alias("t")).selectExpr("user_id as document_id", "cast(user_id as string) as source", "'new' as source_hash", "'' as stem", "1 as slide_count", "cast(t as timestamp) as created_at", "cast(t as timestamp) as updated_at"),
    ).selectExpr("source", "source_hash", "cast(created_at as timestamp_ntz) as created_at", "cast(updated_at as timestamp_ntz) as updated_at"),
    "stale_vectors": lambda s, d: store.stale_dropped(table(s, d, "embeddings").selectExpr("vec_id as chunk_id"), table(s, d, "embeddings").where("vec_id % 10 > 0").selectExpr("vec_id as chunk_id"), table(s, d, "embeddings").where("vec_id % 3 = 0").selectExpr("vec_id as chunk_id")),
    "shape_paragraphs": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(F.lit(0).alias("level"), F.when(x["turn"] % 4 == 1, "number").alias("kind"), F.array(F.struct(F.when(x["turn"] % 3 == 2, "").otherwise(x["role"]).alias("text"), (x["turn"] % 2 == 0).alias("bold"), F.lit(False).alias("italic"))).alias("runs"))).alias("p")).select("conv_id", F.array_join(L.text_lines(F.col("p"), F.lit(False)), "\n").alias("md")),
    "shape_tables": lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(x["n_name"], F.lit("|\n.")))).alias("c")).select("n_regionkey", F.array_join(L.table_lines(F.col("c")), "\n").alias("md")),
}

_W = T.WHITE
_G = T.GLYPHS
_MD = "case p % 5 when 0 then '•' || ' item ' || p when 1 then '•' when 2 then '**Term ' || p || '** is' when 3 then ' ' || (p % 1200) || ' ' else '12 line ' || p end"
_PL = f"""base as (select l_orderkey as page, l_linenumber as n, max(l_partkey) p, max(l_suppkey) s from lineitem group by all),
 pl as (select page % 40 as document_id, page, n, p, (p % 9) * 12.5 as x0, 20.0 + n * (4 + s % 6) as y0, (p % 9) * 12.5 + 20 + p % 50 as x1, 20.0 + n * (4 + s % 6) + 8 + s % 14 as y1, (8 + s % 14)::double as size, {_MD} as md from base)"""
_TRIM = lambda x: f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"
_ROWS = lambda order: f"""sorted as (select *, row_number() over (partition by page order by {order}) as rn from pl),
 walk(page, rn, n, x0, x1, anchor, r) as (select page, rn, n, x0, x1, y0, 1 from sorted where rn = 1 union all
  select s.page, s.rn, s.n, s.x0, s.x1, case when s.y0 - w.anchor <= 6 then w.anchor else s.y0 end, case when s.y0 - w.anchor <= 6 then w.r else w.r + 1 end from walk w join sorted s on s.page = w.page and s.rn = w.rn + 1)"""  # noqa: E731
_TITLED = f"""c as (select *, size >= 16 and not regexp_matches({_TRIM('md')}, '^[0-9]{{1,3}}$') as can from pl), m as (select *, max(case when can then size end) over (partition by page) as most from c),
 t as (select *, coalesce(can and most - size < 0.5, false) as top from m), u as (select *, sum(top::int) over (partition by page) as tops, max(case when top then y0 end) over (partition by page) as low from t),
 b as (select *, can and not top and y0 >= low - 6 as below, size >= 0.7::double * most and y1 <= 540 * 0.45::double as fits from u),
 o as (select *, min(fits::int) over w as all_fit, count(*) over w as nth from b window w as (partition by page, below order by y0, n rows unbounded preceding)),
 titled as (select *, coalesce(tops <= 4 and (top or (below and all_fit = 1 and tops + nth <= 4)), false) as is_title from o)"""
_DRAFTS = """drafts as (select doc_id, case doc_id % 4 when 0 then '# ' || replace(text, '. ', '.  ' || chr(10) || '# ') when 1 then repeat(chr(10), 3) || replace(text, ' ', chr(10)) || repeat(chr(10), 4) || '- end' || repeat(chr(10), 2)
  when 2 then replace('# a~```~# b~- c~', '~', chr(10)) || replace(text, '. ', repeat(chr(10), 4)) || replace('~```~## d~> e', '~', chr(10))
  else replace('intro~# T~- **Term:** x~  - **Other** : y~1. one~| c |~~', '~', chr(10)) || replace(text, '. ', chr(10) || '- ') end as md from documents)"""
_NUMBERLESS = f"regexp_replace(x, '^[{_W}]*[0-9]{{1,3}}[{_W}]+', '')"
_DIGITLESS = f"regexp_replace(lower(regexp_replace(md, '[0-9]', '', 'g')), '[{_W}]+', ' ', 'g')"
_QUOTES = '"“”‘’`*'
_KEY = lambda x: "lower(" + _TRIM(f"regexp_replace(regexp_replace({_TRIM(x)}, '^[{_QUOTES}]+|[{_QUOTES}]+$', '', 'g'), '[{_W}]+', ' ', 'g')") + ")"
_IMAGES = """images as (select o_custkey % 100 as document_id, o_orderkey as page, l_linenumber as n,
  substr(md5(case when l_linenumber <= 3 and o_custkey % 2 = 0 then 'logo' || (o_custkey % 100) else 'img' || (p_partkey % 50) end), 1, 8) as digest,
  p_size * 40 as width, p_size * 10 + 60 * l_linenumber as height
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
_CATEGORY = lambda x: "case " + " ".join(f"when regexp_matches(lower({x}), '{'|'.join(words)}') then '{name}'" for name, words in T.CATEGORIES.items()) + " else 'decorative' end"

ORACLE: dict[str, str] = {
    "row_anchoring": f"with recursive {_PL}, {_ROWS('y0, x0, n')}, y as (select w.*, p.y0 from walk w join pl p on p.page = w.page and p.n = w.n) select page, n, r as row, row_number() over (partition by page order by r, x0, y0, n)::int as at from y",
    "complex_pages": f"with recursive {_PL}, {_ROWS('y0, n')}, g as (select page, r, lead(x0) over (partition by page, r order by x0, n) - x1 >= 30 as gap from walk), e as (select page, count(distinct round_even(x0 / 5, 0)) as edges from pl group by 1) select page, edges, count(distinct case when gap then r end) as gap_rows, edges >= 8 or count(distinct case when gap then r end) >= 3 as is_complex from e join g using (page) group by page, edges",
    "page_titles": f"with {_PL}, {_TITLED}, j as (select page, string_agg({_TRIM('md')}, ' ' order by y0, n) as x from titled where is_title group by 1), k as (select page, {_TRIM(_NUMBERLESS)} as title from j) select * from k where title <> ''",
    "bullet_levels": f"with {_PL}, e as (select distinct page, (round_even(x0 / 5, 0) * 5)::bigint as edge from pl where regexp_matches(md, '^[{_W}]*[{_G}]')) select page, edge, (dense_rank() over (partition by page order by edge) - 1)::int as level from e",
    "content_lines": f"with {_PL}, {_TITLED}, p as (select o_orderkey % 40 as document_id, count(distinct o_orderkey) pages from orders group by 1), keyed as (select *, {_TRIM(_DIGITLESS)} as footer from titled), f as (select document_id, footer from keyed where y0 + 450 >= 470 and size <= 16 group by 1, 2 having count(*) >= greatest(2, floor((select pages from p where p.document_id = keyed.document_id) * 0.5::double))) select page, n from keyed k where not is_title and not (regexp_matches({_TRIM('md')}, '^[0-9]{{1,3}}$') and size <= 16 and y0 < 40) and not exists (select 1 from f where f.document_id = k.document_id and f.footer = k.footer) and not (page % 2 = 0 and greatest(0, least(x1, 60) - greatest(x0, 10)) * greatest(0, least(y1, 60) - greatest(y0, 35)) >= (x1 - x0) * (y1 - y0) * 0.5)",
    "raw_pages": f"with {_PL} select page, '<details>' || chr(10) || '<summary>Raw extracted text</summary>' || chr(10) || chr(10) || string_agg({_TRIM('md')}, chr(10) order by n) || chr(10) || chr(10) || '</details>' as md from pl group by 1",
    "span_runs": "with b as (select l_orderkey as page, (l_orderkey % 3)::int as n, l_linenumber as k, max(l_partkey) p from lineitem group by all), s as (select page, n, k, (case when p % 3 = 0 then ' ' else '' end) || 'w_' || p || (case when p % 4 = 0 then '  ' else '' end) as t, p % 2 = 0 as bold from b), c as (select *, coalesce((lag(bold) over (partition by page order by k) <> bold)::int, 0) as new from s), r as (select *, sum(new) over (partition by page order by k) as run from c), g as (select page, n, run, bold, string_agg(t, '' order by k) as t from r group by all), m as (select *, regexp_extract(t, '^ *', 0) || case when bold then '**' || replace(trim(t, ' '), '_', chr(92) || '_') || '**' else '*' || trim(t, ' ') || '*' end || regexp_extract(t, ' *$', 0) as x from g) select page, n, string_agg(x, '' order by run) as md from m group by 1, 2",
    "emphasis": "with x as (select p_partkey, p_partkey % 2 = 0 as b, p_partkey % 3 = 0 as i, chr(92) || '#a' || case when p_partkey % 3 = 0 then '_' else chr(92) || '_' end || 'b' || chr(92) || '*' || p_partkey as t from part) select p_partkey, case when b and i then '***' || t || '***' when b then '**' || t || '**' when i then '*' || t || '*' else t end as md from x",
    "paragraphs": "select p_partkey, case when p_partkey % 7 = 0 then '' when p_partkey % 4 = 0 or (p_partkey % 4 = 3 and (p_partkey % 3 > 0 or p_partkey % 5 = 0)) then repeat('  ', p_partkey % 3) || '- p' || p_partkey when p_partkey % 4 = 1 then repeat('  ', p_partkey % 3) || '1. p' || p_partkey else 'p' || p_partkey end as md from part",
    "bullet_split": f"with {_PL} select page, n, case when starts_with(md, '•') then '•' end as glyph, case when starts_with(md, '•') then ltrim(substr(md, 2), ' ') else md end as rest from pl",
    "mime_types": "select p_partkey, (['image/png', 'image/jpeg', 'image/jpeg', 'image/gif', 'image/webp', 'image/png', 'image/png'])[p_partkey % 7 + 1] as mime from part",
    "data_urls": "select n_nationkey, 'data:image/jpeg;base64,' || base64(encode(n_name)) as url from nation",
    "categories": f"select doc_id, {_CATEGORY('text')} as category from documents",
    "gated_categories": f"with {_IMAGES}, c as (select case when width % 7 = 0 then 'decorative' when width % 3 = 0 then 'diagram' else 'decorative' end as c, width * height >= 150000 and greatest(width, height)::double / least(width, height) >= 2.0 as is_content from images) select case when c = 'decorative' and is_content then 'diagram' else c end as category, count(*) as n from c group by 1",
    "blockquotes": f"with {_DRAFTS}, l as (select doc_id, string_split(md, chr(10)) as a from drafts) select doc_id, md5(array_to_string(list_transform(case when a[-1] = '' then a[:-2] else a end, lambda x: case when {_TRIM('x')} = '' then '>' else '> ' || x end), chr(10))) as quote from l",
    "label_keys": "select doc_id, md5(" + _KEY("' \"**' || text || '`\" '") + ") as label from documents",
    "elapsed_times": "with t as (select o_orderkey, (o_orderkey * 37) % 9000 as s from orders) select o_orderkey, case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as took from t",
    "emu_points": "select p_partkey, round(p_partkey * 12700::double / 12192000 * 960, 6) as pt from part",
    "unit_vectors": "select vec_id, 1.0::double as square from embeddings",
    "output_paths": "select c_custkey, '/in/' || c_nationkey || '/markdown' as folder, 'lec' || c_custkey || '.isolated.flac' as isolated from customer",
    "headless_texts": f"with {_DRAFTS}, b as (select doc_id, regexp_replace(md, '^([{_W}]*{chr(92)}n)+', '') as x from drafts) select doc_id, md5(case when regexp_matches(x, '^[{_W}]*#') then regexp_replace(regexp_replace(x, '^[^{chr(92)}n]*', ''), '^([{_W}]*{chr(92)}n)+', '') else x end) as md from b",
    "bounded_samples": """with recursive c as (select conv_id, turn, length(text) * (1 + turn % 3 * 4) as size, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n, sum(length(text) * (1 + turn % 3 * 4)) over (partition by conv_id) as total from conversations),
     k as (select *, total <= 3000 as all_fit, (i = 0 or i = n - 1 or i % (case when n > 6 then greatest(1, n // 6) else 1 end) = 0) as wanted from c),
     w(conv_id, i, used, kept, turn) as (select conv_id, i, case when all_fit or (wanted and size <= 3000) then size else 0 end, all_fit or (wanted and size <= 3000), turn from k where i = 0 union all
      select k.conv_id, k.i, w.used + case when all_fit or (wanted and w.used + size <= 3000) then size else 0 end, all_fit or (wanted and w.used + size <= 3000), k.turn from w join k on k.conv_id = w.conv_id and k.i = w.i + 1)
     select conv_id as document_id, turn as chunk_index from w where kept""",
    "deck_characters": "select conv_id as document_id, sum(length(text) * (1 + turn % 3 * 4))::bigint as chars from conversations group by 1",
    "reply_sections": f"select conv_id * 1000 + turn as document_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> ''), chr(10))) as abstract, role || '|two' as topics, case when turn % 2 = 0 then 'one' else '' end as takeaways, '**' || role || '** — x' as terms, turn % 2 = 0 and {_TRIM('text')} <> '' as valid from conversations",
    "summary_headers": "select n_nationkey, replace('# Summary~~## Abstract~' || n_name || '~~## Key Topics~- ' || n_name || '~- b~~## Key Terms~t~~## Metadata~- Source: ' || n_name || '~- Slides: ' || n_regionkey || '~- Converted: 2024-05-06', '~', chr(10)) as md from nation",
    "fallback_topics": "select conv_id, coalesce(arg_min(role, turn) filter (turn % 3 <> 0), '') as abstract, count(*) filter (turn % 3 <> 0 and role <> '')::int as n from conversations group by 1",
    "retrieved_union": "with h as (select label as document_id, vec_id % 3 as query, vec_id as rank, (vec_id * 7) % 50 as chunk_id from embeddings), f as (select document_id, chunk_id, min(query) as first_query from h group by 1, 2) select *, row_number() over (partition by document_id order by chunk_id * 3 % 50)::int as place from f",
    "rendered_statements": "select n_nationkey, '**Relationships:**' || chr(10) || chr(10) || '- `' || n_name || '` —`in`→ `' || n_regionkey || '`' || case when n_nationkey % 2 = 0 then '' else replace('~~**Meaning:**~~', '~', chr(10)) || n_name end as md from nation",
    "grounded_labels": f"with c as (select doc_id, nth, {_KEY('x')} as c from (select doc_id, unnest(string_split_regex(text, '[.,;:!?{chr(92)}n]+')) as x, unnest(range(len(string_split_regex(text, '[.,;:!?{chr(92)}n]+')))) as nth from documents)), l as (select distinct {_KEY('x')} as k from (select unnest(string_split_regex(text, '[.,;:!?{chr(92)}n]+')) as x from benchmark)), u as (select distinct c from c where c <> ''), g as (select c from u where exists (select 1 from l where k <> '' and (c = k or (length(c) >= 4 and (contains(k, c) or contains(c, k)))))) select doc_id, count(*) as n from c join g using (c) group by 1",
    "asset_names": f"with {_IMAGES}, u as (select document_id, page, n, min(digest) as digest from images group by all), f as (select *, row_number() over (partition by document_id, digest order by page, n) as nth from u), a as (select document_id, digest, row_number() over (partition by document_id order by page, n) as asset, case when page % 2 = 0 then 'png' else 'bin' end as ext from f where nth = 1) select document_id, printf('deck%d_%02d_%s.%s', document_id, asset, digest, ext) as filename, count(*) as n from f join a using (document_id, digest) group by 1, 2",
    "image_page_sets": f"with {_IMAGES} select document_id, digest, count(distinct page)::int as n, min(page) as first from images group by 1, 2",
    "page_image_sets": f"with {_IMAGES}, u as (select distinct document_id, page, digest from images) select document_id, page, string_agg(digest, ',' order by digest) as digests from u group by 1, 2",
    "recognised_segments": 'select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as ord, turn::double as start, turn + 1.5::double as "end", role as text from conversations qualify turn % 3 <> 0',
    "speaker_turns": "select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as turn_ord, case when turn % 3 <> 0 then role when turn % 2 = 0 then 'SPEAKER' else 'L' end as speaker from conversations",
    "round_robin_turns": "with t as (select c_custkey as source, (c_custkey % 30)::double as duration, unnest(range(0, 4)) as k from customer) select source, k::int as turn_ord, k * 8.0::double as t_start, least(k * 8.0 + 8, duration)::double as t_end, printf('SPEAKER_%02d', k % 3) as speaker from t where k * 8 < duration",
    "speech_seconds": "select conv_id as source, sum(turn % 4)::double as speech, sum(turn % 4) < 5 as skip_isolation from conversations group by 1",
    "media_targets": "select '/m/lec' || c_custkey || case when c_custkey % 6 = 0 then '.md' else '.WAV' end as path, case when c_custkey % 6 = 0 then 'md' else 'audio' end as kind from customer where c_custkey % 6 in (0, 2)",
    "audio_targets": "with f as (select c_nationkey as dir, 'lec' || (c_custkey % 200) as stem, c_custkey % 6 as k from customer), m as (select stem, min(dir || '/' || stem || '.md') as md from f where k = 0 group by 1) select dir || '/' || stem || '.wav' as path, md from f left join m using (stem) where k = 2",
    "free_versions": "with a as (select distinct 'lec' || (c_custkey % 200) as stem, c_nationkey % 4 as v from customer where c_custkey % 5 > 0), s as (select distinct stem from a) select stem, (select min(k) from range(0, 5) t(k) where not exists (select 1 from a where a.stem = s.stem and a.v = k))::int as version from s",
    "sample_windows": 'with t as (select c_custkey as source, c_custkey * 37 % 900 as total from customer where c_custkey * 37 % 900 > 0), p as (select *, case when total <= 200 then [0] else range(0, total - 10, 190) end as b from t), w as (select source, total, unnest(case when b[-1] + 200 < total then list_append(b, total - 200) else b end) as begin from p) select source, total, (row_number() over (partition by source order by begin) - 1)::int as nth, begin::bigint as begin, least(begin + 200, total)::bigint as "end" from w',
    "overlap_added": "select n_nationkey as source, i as at, case when i = 0 then 0.0 else i end::double as value from nation, range(0, 70) t(i) where i < 40 + n_nationkey",
    "input_files": "with l as (select distinct c_nationkey as arg, '/in/' || (c_custkey % 300) || (['.pptx', '.PDF', '.txt'])[c_custkey % 300 % 3 + 1] as path, c_nationkey % 2 = 0 as f, c_custkey % 300 % 3 < 2 as known from customer), k as (select * from l where known or not f), o as (select *, row_number() over (partition by path order by arg) as nth from k) select arg, path, case when not known then 'unsupported format: .txt' end as error, row_number() over (partition by arg order by path)::int as ord from o where nth = 1",
    "document_upsert": "with b as (select user_id, event_id % 2 as k, max(ts) as t from events group by 1, 2) select user_id::varchar as source, case when arg_max(k, (t, k)) = 1 then 'new' else 'old' end as source_hash, min(t) as created_at, max(t) as updated_at from b group by 1",
    "stale_vectors": "select vec_id as chunk_id from embeddings where vec_id % 10 > 0 and vec_id % 3 > 0",
    "shape_paragraphs": "with t as (select conv_id, turn, case when turn % 3 = 2 then '' else role end as x, turn % 4 = 1 as numbered, turn % 2 = 0 as bold, lag(turn % 3 = 2, 1, false) over (partition by conv_id order by turn) as gap from conversations), l as (select conv_id, turn, (case when gap then chr(10) else '' end) || (case when numbered then '1. ' else '' end) || (case when bold then '**' || x || '**' else x end) as line from t where x <> '') select conv_id, string_agg(line, chr(10) order by turn) as md from l group by 1",
    "shape_tables": "with l as (select n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || n_name || chr(92) || '|<br>. |' as line, row_number() over (partition by n_regionkey order by n_nationkey) nth from nation) select n_regionkey, string_agg(line || case when nth = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by n_nationkey) as md from l group by 1",
}
