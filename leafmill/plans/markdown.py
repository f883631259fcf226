"""Queries over Markdown documents derived from the orders, and over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import chunking, markdown as op
from leafmill.tables import line_table, table

from . import fixtures as fx
from .registry import query

LINES_SQL = fx.MARKDOWN_SQL + ", lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from md)"
SECTION_SQL = f"""with {LINES_SQL}, marked as (select *, regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') as h from lines),
sectioned as (select *, cast(sum(h::int) over w as bigint) as section, coalesce(last_value(case when h then trim(regexp_replace(line, '^#+[ \\t]+', '')) end ignore nulls) over w, '') as heading from marked window w as (partition by doc_id order by n))"""


@query("section_lines", SECTION_SQL + " select doc_id, n, line, section, heading from sectioned where not h")
def section_lines(spark, folder):
    return chunking.section_lines(fx.markdown(spark, folder)).select("doc_id", "n", "line", "section", "heading")


RUNS_SQL = SECTION_SQL + """, body as (select *, starts_with(trim(line), '|') as is_table from sectioned where not h),
changed as (select *, case when lag(is_table) over (partition by doc_id order by n) = is_table then 0 else 1 end as ch from body),
runs as (select *, cast(sum(ch) over (partition by doc_id order by n) as bigint) as run from changed)"""


@query("table_runs", RUNS_SQL + " select doc_id, n, is_table, run from runs")
def table_runs(spark, folder):
    return chunking.table_runs(chunking.section_lines(fx.markdown(spark, folder))).select("doc_id", "n", "is_table", "run")


@query("ditto_groups", RUNS_SQL + """, data as (select *, trim(string_split(trim(trim(line), '|'), '|')[1]) as cell from (select *, row_number() over (partition by doc_id, run order by n) as nth from runs where is_table) where nth > 2),
seen as (select *, last_value(case when cell not in ('', '〃') then cell end ignore nulls) over (partition by doc_id, run order by n rows between unbounded preceding and 1 preceding) as prev from data),
opened as (select *, case when nth = 3 or not (cell in ('', '〃') or cell is not distinct from prev) then 1 else 0 end as o from seen)
select doc_id, n, cell, cast(sum(o) over (partition by doc_id, run order by n) as bigint) as grp from opened""")
def ditto_groups(spark, folder):
    runs = chunking.table_runs(chunking.section_lines(fx.markdown(spark, folder))).where("is_table")
    data = runs.selectExpr("*", "row_number() over (partition by doc_id, run order by n) as nth").where("nth > 2")
    return chunking.ditto_groups(data.drop("nth"), ["doc_id", "run"]).select("doc_id", "n", "cell", "grp")


@query("fixed_windows", """with w as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as body from documents), s as (select doc_id, body, unnest(generate_series(0, length(body) - 1, 700)) as s from w where length(body) > 0)
select doc_id, cast(s // 700 as int) as part, trim(substring(body, cast(s + 1 as int), 800), ' ' || chr(9) || chr(10) || chr(13)) as chunk from s""")
def fixed_windows(spark, folder):
    return chunking.fixed_windows(table(spark, folder, "documents").select("doc_id", "text"))


@query("chunk_documents")
def chunk_documents(spark, folder):
    return chunking.chunk_documents(fx.markdown(spark, folder))


@query("chunk_prose")
def chunk_prose(spark, folder):
    return chunking.chunk_documents(table(spark, folder, "documents").select("doc_id", "text"))


#: Every third order's document is fenced as a whole, with a tilde mark inside that closes nothing.
FENCED_SQL = LINES_SQL.replace("unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from md", "unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from (select doc_id, case doc_id % 3 when 0 then '```md' || chr(10) || '~~~' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' else text end as t from md)")


def _fenced(spark, folder):
    return fx.markdown(spark, folder).selectExpr("doc_id", r"if(doc_id % 3 = 0, concat('```md\n~~~\n', text, '\n```\nend'), text) as text")


@query("fence_state", f"""with {FENCED_SQL}, last as (select doc_id, max(n) as m from lines group by doc_id)
select doc_id, n, doc_id % 3 = 0 and (n <= 2 or n = m - 1) as is_fence, doc_id % 3 = 0 and n < m as in_fence from lines join last using (doc_id)""")
def fence_state(spark, folder):
    return op.fence_state(line_table(_fenced(spark, folder))).select("doc_id", "n", "is_fence", "in_fence")


@query("broken_tables", f"with {fx.MARKDOWN_SQL} select doc_id, 7 as line, '| part | qty | cents |' as excerpt from md where doc_id % 4 = 1 and doc_id % 3 <> 0")
def broken_tables(spark, folder):
    return op.broken_tables(_fenced(spark, folder))


def _linted(spark, folder):
    return fx.markdown(spark, folder).selectExpr("doc_id", r"""concat(if(doc_id % 5 = 0, '---\ntitle: T\n---\n', ''), text, if(doc_id % 2 = 0, '\n<b>bold</b> and `<i>`', ''), if(doc_id % 7 = 0, '\n![x](http://e.example/a.png)', '')) as text""")


@query("lint_markdown", f"""with {fx.MARKDOWN_SQL}, d as (select doc_id, len(string_split(text, chr(10))) as n, case when doc_id % 5 = 0 then 3 else 0 end as f from md)
select doc_id, 'front-matter' as code, [1] as lines from d where doc_id % 5 = 0
union all select doc_id, 'broken-table', [7 + f] from d where doc_id % 4 = 1
union all select doc_id, 'raw-html', [n + f + 1] from d where doc_id % 2 = 0
union all select doc_id, 'unsupported-image', [n + f + 1 + (doc_id % 2 = 0)::int] from d where doc_id % 7 = 0""")
def lint_markdown(spark, folder):
    return op.lint_markdown(_linted(spark, folder))


@query("repair_tables", f"""with {fx.MARKDOWN_SQL} select doc_id, case when doc_id % 4 = 1 then replace(text, chr(10) || '| --- | --- |' || chr(10), chr(10) || '| --- | --- | --- |' || chr(10)) else text end as text from md""")
def repair_tables(spark, folder):
    return op.repair_tables(fx.markdown(spark, folder))


def _referring(spark, folder):
    return fx.markdown(spark, folder).selectExpr("doc_id", r"concat(text, '\n![p](img/', doc_id % 9, '.png) ![q](<a b.png>) `![no](x.png)`\n\n[d]: def/', doc_id % 4, '.png') as text")


@query("collect_references", """with d as (select distinct l_orderkey as doc_id from lineitem join orders on l_orderkey = o_orderkey)
select doc_id, 'img/' || cast(doc_id % 9 as varchar) || '.png' as ref from d union all select doc_id, 'a b.png' from d union all select doc_id, 'def/' || cast(doc_id % 4 as varchar) || '.png' from d""")
def collect_references(spark, folder):
    return op.collect_references(_referring(spark, folder))


@query("blank_runs", f"""with {fx.MARKDOWN_SQL} select doc_id, repeat('&nbsp;' || chr(10) || chr(10), cast(doc_id % 4 // 2 as int)) || (case when doc_id % 2 = 1 then chr(10) else '' end)
  || 'start' || chr(10) || chr(10) || repeat('&nbsp;' || chr(10) || chr(10), cast(greatest(0, (doc_id % 5 - 1)) // 2 as int)) || (case when doc_id % 5 in (2, 4) then chr(10) else '' end) || text || chr(10) || chr(10) as text from md""")
def blank_runs(spark, folder):
    docs = fx.markdown(spark, folder).selectExpr("doc_id", r"concat(repeat('\n', cast(doc_id % 4 as int)), 'start\n', repeat('\n', cast(if(doc_id % 5 = 0, 1, doc_id % 5) as int)), text, '\n\n') as text")
    return op.blank_runs(docs)


@query("document_titles", f"with {fx.MARKDOWN_SQL} select doc_id, case when doc_id % 3 = 0 then '無題' else 'Order ' || cast(doc_id as varchar) end as title from md")
def document_titles(spark, folder):
    return op.document_titles(_fenced(spark, folder))


@query("diagram_blocks", """with d as (select distinct l_orderkey as doc_id from lineitem join orders on l_orderkey = o_orderkey)
select doc_id, 'graph TD' || chr(10) || 'A-->' || cast(doc_id as varchar) as source, case when doc_id % 4 = 0 then 'both' else 'diagram' end as view from d where doc_id % 4 <> 1""")
def diagram_blocks(spark, folder):
    block = r"'\n```mermaid', case doc_id % 4 when 0 then ' show=both' when 1 then ' show=code' else '' end, '\ngraph TD\nA-->', doc_id, '\n```'"
    return op.diagram_blocks(fx.markdown(spark, folder).selectExpr("doc_id", f"concat(text, {block}, {block}) as text"))


@query("page_parts", f"with {LINES_SQL} select doc_id, n + (n > 3)::int as n, line, cast((n > 3)::int as bigint) as part from lines")
def page_parts(spark, folder):
    docs = fx.markdown(spark, folder).selectExpr("doc_id", r"""regexp_replace(text, '^(# [^\n]*\n\n[^\n]*\n)', '$1<div style="page-break-after: always"></div>\n') as text""")
    return op.page_parts(docs).selectExpr("doc_id", "cast(n as bigint) as n", "line", "part")


@query("neutralize_links", f"""with {fx.MARKDOWN_SQL} select doc_id, text || ' [ok](https://e.example) x (javascript:' || cast(doc_id as varchar) || ') [画像: i](ftp://e.example/i.png) [rel](a/b.md)' as text from md""")
def neutralize_links(spark, folder):
    docs = fx.markdown(spark, folder).selectExpr("doc_id", "concat(text, ' [ok](https://e.example) [x](javascript:', doc_id, ') ![i](ftp://e.example/i.png) [rel](a/b.md)') as text")
    return op.neutralize_links(docs)


@query("strip_data_images", "select o_custkey % 10 as image_no, 'data:image/png;base64,' || to_base64(encode(cast(o_custkey % 10 as varchar))) as image from orders group by all")
def strip_data_images(spark, folder):
    docs = table(spark, folder, "orders").selectExpr("o_orderkey as doc_id", "concat('x ![i](data:image/png;base64,', base64(cast(cast(o_custkey % 10 as string) as binary)), ') y') as text")
    _, images = op.strip_data_images(docs)
    return images.selectExpr("cast(cast(unbase64(substring_index(image, ',', -1)) as string) as bigint) as image_no", "image")


@query("escape_angles", r"""with d as (select distinct l_orderkey as doc_id from lineitem join orders on l_orderkey = o_orderkey)
select doc_id, 'a \<b> \<c' || chr(10) || '```' || chr(10) || '<raw>' || chr(10) || '```' || chr(10) || cast(doc_id as varchar) || ' \< d' as text from d""")
def escape_angles(spark, folder):
    ids = fx.markdown(spark, folder).select("doc_id")
    return op.escape_angles(ids.selectExpr("doc_id", r"concat('a <b> \\<c\n```\n<raw>\n```\n', doc_id, ' < d') as text"))


@query("nth_visible_char", """with pieces as (select conv_id as doc_id, turn as piece, text, length(regexp_replace(text, '\\s+', '', 'g')) as v from conversations),
c as (select *, sum(v) over (partition by doc_id order by piece) as upto from pieces), t as (select distinct conv_id as doc_id, 50 + conv_id % 100 as nth from conversations),
hit as (select t.doc_id, nth, piece, text, nth - (upto - v) as k from t join c on t.doc_id = c.doc_id and nth > upto - v and nth <= upto),
chars as (select doc_id, nth, piece, k, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as i from hit),
vis as (select *, row_number() over (partition by doc_id, nth order by i) as r from chars where not regexp_matches(ch, '\\s'))
select doc_id, nth, piece, cast(i - 1 as int) as at from vis where r = k""")
def nth_visible_char(spark, folder):
    pieces = table(spark, folder, "conversations").selectExpr("conv_id as doc_id", "turn as piece", "text")
    return op.nth_visible_char(pieces, pieces.selectExpr("doc_id", "50 + doc_id % 100 as nth").distinct())
