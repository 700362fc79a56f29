"""All registered queries of the engine itself, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import catalog_events, catalog_more
from leafmill.functions import text as T
from leafmill.operators import documents as D
from leafmill.operators import layout as P
from leafmill.operators import log as L
from leafmill.operators import markdown as M
from leafmill.operators import retrieval as R
from leafmill.operators import transcripts as S
from leafmill.plans import adapters as A
from leafmill.sources.readers import table
from leafmill.streaming.transcripts import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

_IMAGES = """images as (select o_custkey % 100 as document_id, o_orderkey as page, l_linenumber as n,
  substr(md5(case when l_linenumber <= 3 and o_custkey % 2 = 0 then 'logo' || (o_custkey % 100) else 'img' || (p_partkey % 50) end), 1, 8) as digest,
  p_size * 40 as width, p_size * 10 + 60 * l_linenumber as height
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
_LINES = """rows as (select l_orderkey, l_linenumber, max(l_partkey) p, max(l_suppkey) s from lineitem group by all),
 lines as (select l_orderkey as page, l_orderkey % 40 as document_id, l_linenumber as n, (p % 9) * 12.5 as x0,
  case when l_linenumber = max(l_linenumber) over (partition by l_orderkey) then 500.0 else 30.0 + 4 * l_linenumber end as y0, 8 + s % 14 as size,
  case when l_linenumber = max(l_linenumber) over (partition by l_orderkey) then 'Footer ' || l_orderkey else 'line ' || p end as text from rows)"""
_SEGMENTS = """segments as (select conv_id, turn, 10 * turn as s, 10 * turn + 5 + length(text) % 20 as e from conversations),
 turns as (select conv_id, turn as turn_ord, 12 * turn as t_start, 12 * turn + 11 as t_end, role as speaker from conversations)"""

_DRAFTS = """drafts as (select doc_id, case doc_id % 4 when 0 then '# ' || replace(text, '. ', '.  ' || chr(10) || '# ') when 1 then repeat(chr(10), 3) || replace(text, ' ', chr(10)) || repeat(chr(10), 4) || '- end' || repeat(chr(10), 2)
  when 2 then replace('# a~```~# b~- c~', '~', chr(10)) || replace(text, '. ', repeat(chr(10), 4)) || replace('~```~## d~> e', '~', chr(10))
  else replace('intro~# T~- **Term:** x~  - **Other** : y~1. one~| c |~~', '~', chr(10)) || replace(text, '. ', chr(10) || '- ') end as md from documents),
 raw as (select doc_id, unnest(range(len(string_split(md, chr(10))))) as n, unnest(string_split(md, chr(10))) as x from drafts),
 fences as (select doc_id, n, x, regexp_replace(x, '\\s+$', '') as y, ltrim(x) like '```%' as f, sum((ltrim(x) like '```%')::int) over (partition by doc_id order by n) % 2 = 1 as open from raw)"""
_SPOKEN = "spoken as (select conv_id, turn, 10 * turn + 0.5 as s, 10 * turn + 5 + length(text) % 20 + 0.25 as e, case when turn % 3 <> 0 then role end as speaker, trim(text, ' ') as text from conversations)"

QUERIES: dict[str, Query] = {
    "quality_gate": lambda s, d: A.candidates(s, d).select("doc_id", F.coalesce(D.quality_reason(F.col("md")), F.lit("ok")).alias("reason")),
    "content_words": lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).alias("n_words")),
    "escape_markdown": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.escape_markdown(F.col("text")).cast("binary")).alias("escaped")),
    "cell_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.cell_text(F.col("text")).cast("binary")).alias("cell")),
    "recurring_images": lambda s, d: D.recurring_images(A.images(s, d), A.image_pages(s, d)),
    "content_override": lambda s, d: A.images(s, d).withColumn("is_content", D.looks_like_content(F.col("width"), F.col("height"))).groupBy("is_content").agg(F.count("*").alias("n")),
    "repeated_footers": lambda s, d: D.repeated_footers(A.layout(s, d), A.page_sizes(s, d)),
    "split_slides": lambda s, d: D.split_slides(A.decks(s, d)),
    "assign_speakers": lambda s, d: R.assign_speakers(A.segments(s, d), A.turns(s, d)),
    "audio_beside": lambda s, d: R.audio_beside(A.files(s, d)),
    "nearest_chunks": lambda s, d: R.nearest_chunks(
        table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding"),
        table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("document_id"), F.col("embedding").alias("vector")), 5,
    ),
    "log_rollup": lambda s, d: L.rollup(table(s, d, "events")),
    "log_by_source": lambda s, d: L.rollup_by(table(s, d, "events"), F.col("user_id"), "source"),
    "log_by_digest": lambda s, d: L.rollup_by(table(s, d, "events"), F.md5(F.col("props").cast("binary")), "digest"),
    "recent_sources": lambda s, d: L.recent(table(s, d, "events"), 20),
    "image_placement": lambda s, d: D.image_placement(A.images(s, d).groupBy("document_id", "page", "n").agg(F.min("digest").alias("digest"))).groupBy("document_id", "placement").agg(F.count("*").alias("n"), F.max("asset").alias("asset")),
    "polished": lambda s, d: M.polish(A.drafts(s, d)).select("doc_id", F.md5(F.col("md").cast("binary")).alias("polished")),
    "line_kinds": lambda s, d: M.line_kinds(A.drafts(s, d)),
    "summary_targets": lambda s, d: M.summary_targets(A.drafts(s, d)),
    "sections": lambda s, d: M.sections(A.replies(s, d), "conv_id"),
    "strip_transcript": lambda s, d: A.attached(s, d).select("document_id", F.md5(M.strip_transcript(F.col("md")).cast("binary")).alias("head")),
    "omissions": lambda s, d: M.omissions(table(s, d, "documents").withColumn("half", F.expr("concat(substring(text, 1, cast(length(text) div 2 as int)), ' addedword')")), "text", "half"),
    "changed_chunks": lambda s, d: M.changed_chunks(
        table(s, d, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("content_hash")),
        table(s, d, "conversations").where("turn % 3 <> 0").select("conv_id", "turn", F.when(F.expr("turn % 3 = 1"), F.md5(F.col("text").cast("binary"))).otherwise("old").alias("content_hash")), ["conv_id", "turn"],
    ),
    "pipe_tables": lambda s, d: M.pipe_table(table(s, d, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"]),
    "transcript_markdown": lambda s, d: S.to_markdown(A.spoken(s, d), "asr").select("conv_id", F.md5(F.col("md").cast("binary")).alias("md")),
    "transcript_srt": lambda s, d: S.to_srt(A.spoken(s, d)).select("conv_id", F.md5(F.col("srt").cast("binary")).alias("srt")),
    "same_duration": lambda s, d: table(s, d, "orders").select("o_orderkey", S.same_duration(F.when(F.expr("o_orderkey % 5 > 0"), (F.col("o_orderkey") % 23 + 90).cast("double")), (F.col("o_custkey") % 7 * 20).cast("double")).alias("accepted")),
    "unused_audio": lambda s, d: S.unused_audio(A.files(s, d).where("ext <> 'md'"), A.files(s, d).where("ext = 'md'").select("dir", "stem")),
    "page_numbers": lambda s, d: A.layout(s, d).withColumn("text", F.concat(F.lit("\t"), (F.col("page") % 1500).cast("string"), F.lit(" "))).where(P.is_page_number(F.col("text"), F.col("size"), F.col("y0"))).select("page", "n"),
    "backgrounds": lambda s, d: P.backgrounds(A.images(s, d).withColumn("is_full", F.col("width") >= 200)),
    "readability": lambda s, d: A.images(s, d).groupBy(F.coalesce(P.readability(F.col("width"), F.col("height")), F.lit("readable")).alias("verdict")).agg(F.count("*").alias("n")),
    "outside_tables": lambda s, d: P.outside_tables(
        A.layout(s, d).selectExpr("page", "n", "x0", "y0", "x0 + 40 as x1", "y0 + 10 as y1"),
        table(s, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey as page", "10D as x0", "35D as y0", "60D as x1", "48D as y1"),
    ).select("page", "n"),
    "windowed_counts": lambda s, d: windowed_counts(table(s, d, "events")),
} | catalog_more.QUERIES | catalog_events.QUERIES
FLAGSHIP = "quality_gate"

_W = T.WHITE
_TRIM = lambda x: f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"
_SPLIT = f"string_split_regex(md, '{T.LINE_ENDS}')"
_CUT = f"case when {_SPLIT}[-1] = '' then {_SPLIT}[:-2] else {_SPLIT} end"
_BARE = f"regexp_replace({_TRIM("replace(" + _TRIM('x') + ", '*', '')")}, '^[-+][{_W}]+|[{_W}]*[0-9]+$', '', 'g')"
_NORMAL = f"lower({_TRIM(f"regexp_replace({_BARE}, '[{_W}]+', ' ', 'g')")})"
_LEFT = f"regexp_replace(x, '^[{_W}]+', '')"

ORACLE: dict[str, str] = {
    "quality_gate": rf"""with c as (select doc_id, case doc_id % 8 when 0 then text when 1 then rtrim(repeat('- **' || substr(split_part(text, chr(10), 1), 1, 12) || '**' || chr(10), 12), chr(10))
        when 2 then text || ' ...' when 3 then repeat(' ', 50) || '- ' || split_part(text, chr(10), 1) when 4 then '' when 5 then repeat('process ', 60)
        when 6 then (select string_agg('- item ' || k, chr(10) order by k) from range(400) t(k)) else '- ' || replace(text, chr(10), chr(10) || '- ') end as md from documents),
      l as (select doc_id, x, {_NORMAL} as y from (select doc_id, unnest({_CUT}) as x from c) where {_TRIM('x')} <> ''),
      k as (select doc_id, y, count(*) n from l group by all), m as (select doc_id, max(n) most, count(*) kinds, sum(n) lines from k group by 1),
      depth as (select doc_id, max(case when regexp_matches({_LEFT}, '^[-*+] ') then (length(x) - length({_LEFT})) // 2 else 0 end) depth from l group by 1),
      w as (select doc_id, regexp_extract_all(lower(md), '[a-z0-9]+') w from c)
      select c.doc_id, case when {_TRIM('md')} = '' then 'empty' when lines > 300 then 'runaway length'
        when regexp_matches(md, '\.\.\.|\[(?:specific|your|insert|placeholder)[^\]]*\]') then 'placeholder' when depth > 12 then 'excessive nesting'
        when most > 8 or (lines >= 20 and kinds::double / lines < 0.5) then 'repetitive'
        when len(w) >= 50 and len(list_distinct(w))::double / len(w) < 0.05 then 'low information' else 'ok' end as reason
      from c left join m using (doc_id) left join depth using (doc_id) left join w using (doc_id)""",
    "content_words": f"select doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')), lambda x: x not in ({STOP})))::int as n_words from documents",
    "escape_markdown": r"select doc_id, md5(case when t like '#%' then chr(92) || t else t end) as escaped from (select doc_id, regexp_replace(text, '([\\`*_])', '\\\1', 'g') t from documents)",
    "cell_text": r"select doc_id, md5(trim(replace(replace(coalesce(text, ''), '|', '\|'), chr(10), '<br>'), ' ')) as cell from documents",
    "recurring_images": f"with {_IMAGES}, p as (select o_custkey % 100 as document_id, count(distinct o_orderkey) pages from orders group by 1), i as (select document_id, digest, count(distinct page) on_pages from images group by 1, 2) select document_id, digest, on_pages from i join p using (document_id) where on_pages >= greatest(2, ceil(pages * 0.8::double))",
    "content_override": f"with {_IMAGES} select (width * height >= 150000 and greatest(width, height)::double / least(width, height) >= 2.0) as is_content, count(*) as n from images group by 1",
    "repeated_footers": f"with {_LINES}, p as (select o_orderkey % 40 as document_id, count(distinct o_orderkey) pages from orders group by 1), k as (select document_id, trim(regexp_replace(lower(regexp_replace(text, '[0-9]', '', 'g')), '\\s+', ' ', 'g')) footer, count(*) n from lines where y0 >= 470 and size <= 16 group by 1, 2) select document_id, footer, n from k join p using (document_id) where n >= greatest(2, floor(pages * 0.5::double))",
    "split_slides": "select conv_id as document_id, (turn + 1)::int as slide, role as title, (2 + len(string_split(text, chr(10))) + case when turn < last then 3 else 0 end)::bigint as n_lines, md5(trim('# ' || role || ' — Slide ' || (turn + 1) || chr(10) || chr(10) || text || case when turn < last then chr(10) || chr(10) || '---' else '' end)) as content_hash from (select *, max(turn) over (partition by conv_id) as last from conversations)",
    "assign_speakers": f"with {_SEGMENTS} select s.conv_id, s.turn, arg_min(speaker, turn_ord) as speaker from segments s left join turns t on s.conv_id = t.conv_id and (s + e) / 2.0 >= t_start and (s + e) / 2.0 < t_end group by 1, 2",
    "audio_beside": "with f as (select c_nationkey as dir, 'lec' || (c_custkey % 200) as stem, (['md', 'mp3', 'wav', 'm4a', 'flac', 'wma'])[c_custkey % 6 + 1] as ext from customer), a as (select dir, stem, arg_min(ext, list_position(['wav', 'm4a', 'mp3', 'flac', 'wma'], ext)) as audio from f where ext <> 'md' group by 1, 2) select distinct f.dir, f.stem, audio from f left join a using (dir, stem) where ext = 'md'",
    "nearest_chunks": "with r as (select q.vec_id as query_id, c.vec_id as chunk_id, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], c.embedding::double[]), c.vec_id)::int as rank from embeddings q join embeddings c on q.label = c.label where q.vec_id % 20 = 0) select * from r where rank <= 5",
    "log_rollup": "select event_type, count(*) as n, count(distinct user_id) as sources, round(avg(value), 6) as mean_value, max(value) as max_value from events group by rollup (event_type)",
    "log_by_source": "select user_id as source, event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by grouping sets ((user_id, event_type), (user_id))",
    "log_by_digest": "select md5(props) as digest, event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by grouping sets ((md5(props), event_type), (md5(props)))",
    "recent_sources": "select user_id, max(ts) as last_used from events group by 1 order by last_used desc, user_id limit 20",
    "image_placement": f"with {_IMAGES}, u as (select document_id, page, n, min(digest) as digest from images group by all), r as (select *, row_number() over (partition by document_id, digest order by page, n) nth from u), a as (select document_id, digest, row_number() over (partition by document_id order by page, n)::int as asset from r where nth = 1) select document_id, case when nth = 1 then 'inline' else 'link' end as placement, count(*) as n, max(asset) as asset from r join a using (document_id, digest) group by 1, 2",
    "polished": f"with {_DRAFTS}, h as (select *, not open and y like '#%' as h from fences), l as (select *, lag(y) over w as b, lag(y, 2) over w as bb, lag(h) over w as hb from h window w as (partition by doc_id order by n)) select doc_id, md5(rtrim(string_agg(case when coalesce(b <> '' and y <> '' and (h or hb), false) then chr(10) else '' end || y, chr(10) order by n), chr(10))) as polished from l where not (y = '' and coalesce(b = '' and bb = '', false)) group by 1",
    "line_kinds": rf"with {_DRAFTS}, k as (select doc_id, x, regexp_matches({_LEFT}, '{M.STRUCTURAL}') as s from raw) select doc_id, count_if(s)::bigint as structural, count_if(trim(x, ' ') <> '' and not s)::bigint as editable, count_if(ltrim(x, ' ') like '**%')::bigint as leads, count_if(regexp_matches(ltrim(x, ' '), '^[-*+] '))::bigint as bullets from k group by 1",
    "summary_targets": rf"with {_DRAFTS}, c as (select doc_id, count_if(not open and not f and regexp_matches(y, '^([-*]\s+|[0-9]+\.\s+)\S'))::bigint as concepts, count_if(not open and not f and regexp_matches(trim(y, ' '), '{M.TERM}'))::bigint as terms from fences group by 1) select *, greatest(3, least(16, concepts)) as n_topics, greatest(3, least(12, concepts)) as n_takeaways, greatest(0, least(8, terms)) as n_terms from c",
    "sections": "select conv_id, lower(role) as section, sum(len(string_split(text, chr(10))))::bigint as n_lines from conversations where turn > 0 group by all",
    "strip_transcript": "select conv_id as document_id, md5(case when conv_id % 2 = 0 then rtrim(md, chr(10)) || chr(10) else md end) as head from (select conv_id, string_agg('# ' || role || ' — Slide ' || (turn + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as md from conversations group by 1)",
    "omissions": f"with w as (select doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')), lambda x: x not in ({STOP})) as b, list_filter(list_distinct(regexp_extract_all(lower(substr(text, 1, length(text) // 2) || ' addedword'), '[a-z0-9]{{4,}}')), lambda x: x not in ({STOP})) as a from documents) select doc_id, len(b) - len(list_intersect(a, b)) as omitted, len(a) - len(list_intersect(a, b)) as added from w",
    "changed_chunks": "select conv_id, turn from conversations where turn % 3 <> 1",
    "pipe_tables": "with l as (select n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' as line, row_number() over (partition by n_regionkey order by n_nationkey) nth from nation) select n_regionkey, string_agg(line || case when nth = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by n_nationkey) as md from l group by 1",
    "transcript_markdown": f"with {_SPOKEN}, t as (select *, round_even(s, 0)::bigint as r from spoken) select conv_id, md5(replace('# Transcript~~<details>~<summary>Auto-generated transcript (asr)</summary>~~', '~', chr(10)) || string_agg('[' || printf('%02d:%02d:%02d', r // 3600, r % 3600 // 60, r % 60) || '] ' || coalesce('**' || speaker || ':** ', '') || text, chr(10) order by turn) || replace('~~</details>', '~', chr(10))) as md from t group by 1",
    "transcript_srt": f"with {_SPOKEN}, t as (select *, (s * 1000)::bigint as a, (e * 1000)::bigint as b, row_number() over (partition by conv_id order by turn) as i from spoken) select conv_id, md5(string_agg(i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b % 3600000 // 60000, b % 60000 // 1000, b % 1000) || chr(10) || coalesce('[' || speaker || '] ', '') || text, chr(10) || chr(10) order by turn) || chr(10)) as srt from t group by 1",
    "same_duration": "select o_orderkey, case when o_custkey % 7 > 0 and o_orderkey % 5 > 0 then abs(o_orderkey % 23 + 90 - o_custkey % 7 * 20)::double / (o_custkey % 7 * 20) < 0.05 else true end as accepted from orders",
    "unused_audio": "with f as (select c_nationkey as dir, 'lec' || (c_custkey % 200) as stem, (['md', 'mp3', 'wav', 'm4a', 'flac', 'wma'])[c_custkey % 6 + 1] as ext from customer) select dir, stem, ext from f where ext <> 'md' and (dir, stem) not in (select (dir, stem) from f where ext = 'md')",
    "page_numbers": f"with {_LINES} select page, n from lines where page % 1500 < 1000 and size <= 16 and y0 < 40",
    "backgrounds": f"with {_IMAGES}, f as (select document_id, digest, page, bool_or(width >= 200) as filled from images group by all) select document_id, digest, count(*) as pages from f group by 1, 2 having count(*) > 1 and bool_and(filled)",
    "readability": f"with {_IMAGES} select case when least(width, height) < 250 then 'low resolution' else 'readable' end as verdict, count(*) as n from images group by 1",
    "outside_tables": f"with {_LINES}, o as (select distinct o_orderkey from orders where o_orderkey % 2 = 0) select page, n from lines left join o on page = o_orderkey where not (o_orderkey is not null and greatest(0, least(x0 + 40, 60) - greatest(x0, 10)) * greatest(0, least(y0 + 10, 48) - greatest(y0, 35)) >= 200)",
    "windowed_counts": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
} | catalog_more.ORACLE | catalog_events.ORACLE
