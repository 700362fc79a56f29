"""Queries over time and place: tables found on pages, as-of joins, sessions, events that follow others, percentiles and sketches of the log; with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import asof as J
from leafmill.operators import layout
from leafmill.operators import log as L
from leafmill.operators import tables as G
from leafmill.plans import adapters as A
from leafmill.sources.readers import table
from leafmill.streaming import events as S

Query = Callable[[SparkSession, str], DataFrame]


def _headings(s: SparkSession, d: str) -> DataFrame:
    """For each line of a draft the last heading at it or before it; a stretch is two hundred lines."""
    lines = A.drafts(s, d).select("doc_id", F.posexplode(F.split("md", "\n")).alias("n", "line"))
    heads = lines.where(F.col("line").startswith("#")).select("doc_id", "n", F.col("line").alias("heading"))
    return J.asof(lines.select("doc_id", "n"), heads, "doc_id", "n", F.floor(F.col("n") / 200))


def _orders_as_of(s: SparkSession, d: str) -> DataFrame:
    """For each order, set in the month of the events, the last event of its customer's number until then; a stretch is a day."""
    orders = table(s, d, "orders").selectExpr("o_orderkey", "o_custkey % 150 as user_id", "timestamp_micros(1704067200000000 + pmod(o_orderkey * 7919, 2592000) * 1000000) as ts")
    events = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return J.asof(orders, events, "user_id", "ts", F.to_date("ts"), "event_id")


def _kind(s: SparkSession, d: str, kind: str) -> DataFrame:
    return table(s, d, "events").where(F.col("event_type") == kind)


QUERIES: dict[str, Query] = {
    "detected_tables": lambda s, d: G.detect(A.grid_lines(s, d)).select("page", "nth", "x0", "y0", "x1", "y1", "n_rows", "n_cols", F.md5(F.array_join("md", "\n").cast("binary")).alias("md")),
    "outside_detected": lambda s, d: layout.outside_tables(A.grid_lines(s, d), G.detect(A.grid_lines(s, d)), ("document_id", "page")).select("page", "n"),
    "detected_flow": lambda s, d: G.flow(A.grid_lines(s, d)).select("page", F.md5(F.array_join("out", "\n").cast("binary")).alias("md")),
    "last_headings": lambda s, d: _headings(s, d).select("doc_id", "n", F.md5(F.col("found.heading").cast("binary")).alias("heading")),
    "orders_as_of": lambda s, d: _orders_as_of(s, d).select("o_orderkey", F.coalesce("found.event_id", F.lit(-1)).alias("event_id")),
    "sessions": lambda s, d: S.sessions(table(s, d, "events"), "6 hours"),
    "followed_events": lambda s, d: S.followed(_kind(s, d, "view"), _kind(s, d, "click"), "6 hours"),
    "log_cube": lambda s, d: L.percentiles(table(s, d, "events")),
    "log_spans": lambda s, d: L.spans(L.sketches(table(s, d, "events")), F.to_date("hour"), "day"),
}

_GRID = """base as (select l_orderkey as page, l_linenumber as n, max(l_partkey) p, max(l_suppkey) s from lineitem group by all),
 pl as (select page % 40 as document_id, page, n, p, (n % 3) * 120.0 + p % 5 as x0, 20.0 + (n // 3) * 14 + s % 3 as y0, (n % 3) * 120.0 + p % 5 + case when p % 37 = 0 then 300 else 40 + p % 50 end as x1, 20.0 + (n // 3) * 14 + s % 3 + 8 as y1, ' cell|' || p as md from base)"""
_FOUND = f"""{_GRID}, sorted as (select *, row_number() over (partition by page order by y0, x0, n) as rn from pl),
 walk(page, rn, n, anchor, r) as (select page, rn, n, y0, 1 from sorted where rn = 1 union all
  select s.page, s.rn, s.n, case when s.y0 - w.anchor <= 6 then w.anchor else s.y0 end, case when s.y0 - w.anchor <= 6 then w.r else w.r + 1 end from walk w join sorted s on s.page = w.page and s.rn = w.rn + 1),
 placed as (select p.*, w.r, count(*) over (partition by p.page, w.r) as held from walk w join pl p on p.page = w.page and p.n = w.n),
 reach as (select *, max(x1) over (partition by page order by x0, x1, n rows between unbounded preceding and 1 preceding) as far from placed where held > 1),
 banded as (select *, sum(case when far is null or x0 > far then 1 else 0 end) over (partition by page order by x0, x1, n rows unbounded preceding) as band from reach),
 cell as (select document_id, page, r, band, string_agg(trim(md, ' '), ' ' order by x0, y0, n) as t, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from banded group by all),
 held as (select page, r, list_sort(list(band)) as own from cell group by all),
 opened as (select *, case when r = lag(r) over w + 1 and len(list_intersect(own, lag(own) over w)) >= 2 then 0 else 1 end as opens from held window w as (partition by page order by r)),
 runs as (select *, sum(opens) over (partition by page order by r) as run from opened),
 whole as (select page, run, count(*) as n_rows, list_sort(list_distinct(flatten(list(own)))) as cols from runs group by all having count(*) >= 2 and len(list_distinct(flatten(list(own)))) >= 2),
 each as (select w.page, w.run, n_rows, cols, r.r, unnest(cols) as b from whole w join runs r on r.page = w.page and r.run = w.run),
 line as (select e.page, e.run, n_rows, cols, e.r, '| ' || string_agg(coalesce(replace(t, '|', chr(92) || '|'), ''), ' | ' order by b) || ' |' as x from each e left join cell c on c.page = e.page and c.r = e.r and c.band = e.b group by all),
 found as (select l.page, l.run, l.n_rows, len(l.cols)::int as n_cols, string_agg(x || case when first then chr(10) || '| ' || array_to_string(list_transform(cols, lambda b: '---'), ' | ') || ' |' else '' end, chr(10) order by r) as md
   from (select *, r = min(r) over (partition by page, run) as first from line) l group by all),
 box as (select c.page, r.run, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from cell c join runs r on r.page = c.page and r.r = c.r group by all)"""

ORACLE: dict[str, str] = {
    "detected_tables": f"with recursive {_FOUND} select f.page, (row_number() over (partition by f.page order by f.run))::int as nth, x0, y0, x1, y1, n_rows, n_cols, md5(md) as md from found f join box b on f.page = b.page and f.run = b.run",
    "outside_detected": f"with recursive {_FOUND}, t as (select b.* from box b join whole w on w.page = b.page and w.run = b.run) select page, n from pl where not exists (select 1 from t where t.page = pl.page and greatest(0, least(pl.x1, t.x1) - greatest(pl.x0, t.x0)) * greatest(0, least(pl.y1, t.y1) - greatest(pl.y0, t.y0)) >= (pl.x1 - pl.x0) * (pl.y1 - pl.y0) * 0.5)",
    "last_headings": "with drafts as (select doc_id, case doc_id % 4 when 0 then '# ' || replace(text, '. ', '.  ' || chr(10) || '# ') when 1 then repeat(chr(10), 3) || replace(text, ' ', chr(10)) || repeat(chr(10), 4) || '- end' || repeat(chr(10), 2) when 2 then replace('# a~```~# b~- c~', '~', chr(10)) || replace(text, '. ', repeat(chr(10), 4)) || replace('~```~## d~> e', '~', chr(10)) else replace('intro~# T~- **Term:** x~  - **Other** : y~1. one~| c |~~', '~', chr(10)) || replace(text, '. ', chr(10) || '- ') end as md from documents), l as (select doc_id, (unnest(range(len(string_split(md, chr(10))))))::int as n, unnest(string_split(md, chr(10))) as line from drafts) select doc_id, n, md5(last_value(case when line like '#%' then line end ignore nulls) over (partition by doc_id order by n rows unbounded preceding)) as heading from l",
    "orders_as_of": "with o as (select o_orderkey, o_custkey % 150 as user_id, make_timestamp(1704067200000000 + (o_orderkey * 7919) % 2592000 * 1000000) as ts from orders) select o_orderkey, coalesce(event_id, -1) as event_id from o asof left join events e on o.user_id = e.user_id and o.ts >= e.ts",
    "sessions": "with g as (select *, coalesce((ts - lag(ts) over w >= interval 6 hours)::int, 1) as opens from events window w as (partition by user_id order by ts)), s as (select *, sum(opens) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, max(ts) as last, count(*) as n, string_agg(distinct event_type, ',' order by event_type) as types, round(sum(value), 6) as total from s group by user_id, k",
    "followed_events": "select a.event_id as first_id, b.event_id as then_id, a.user_id from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 6 hours where a.event_type = 'view' and b.event_type = 'click'",
    "log_cube": "select event_type, ts::date::varchar as day, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, grouping(event_type, ts::date) as level from events group by cube (event_type, ts::date)",
}
