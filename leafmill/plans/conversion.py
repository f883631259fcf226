"""Queries over bundles of files and HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import bundles as op
from leafmill.tables import table

from . import fixtures as fx
from .registry import query


@query("classify_reference", f"""with {fx.BUNDLE_SQL} select ref_id, case ref_id % 4 when 1 then 'external' else 'local' end as kind,
  case ref_id % 4 when 0 then 'img/' || substring(ref, 8, length(ref) - 11) when 1 then null when 2 then null else 'doc/a/' || string_split(substring(ref, 10), '#')[1] end as path from refs""")
def classify_reference(spark, folder):
    refs = fx.bundle_references(spark, folder).withColumn("c", op.classify_reference(F.col("ref"), F.lit("doc")))
    return refs.select("ref_id", "c.kind", "c.path")


@query("resolve_references", f"""with {fx.BUNDLE_SQL}, local as (select bundle_id, ref_id, 'img/' || substring(ref, 8, length(ref) - 11) as path, ref_id % 3 <> 0 as structured from refs where ref_id % 4 = 0),
f as (select distinct bundle_id, path from files), ci as (select bundle_id, lower(path) as k, min(path) as p from f group by 1, 2 having count(*) = 1),
nm as (select bundle_id, lower(string_split(path, '/')[-1]) as k, min(path) as p from f group by 1, 2 having count(*) = 1)
select l.bundle_id, ref_id, l.path, coalesce(f.path, ci.p, case when not structured then nm.p end) as resolved from local l left join f on f.bundle_id = l.bundle_id and f.path = l.path
left join ci on ci.bundle_id = l.bundle_id and ci.k = lower(l.path) left join nm on nm.bundle_id = l.bundle_id and nm.k = lower(string_split(l.path, '/')[-1])""")
def resolve_references(spark, folder):
    refs = fx.bundle_references(spark, folder).where("ref like '../img/%'").withColumn("path", op.classify_reference(F.col("ref"), F.lit("doc"))["path"])
    refs = refs.withColumn("structured", F.expr("ref_id % 3 <> 0"))
    return op.resolve_references(refs, fx.bundle_files(spark, folder)).select("bundle_id", "ref_id", "path", "resolved")


@query("bundle_paths", "select p_partkey as file_id, case p_partkey % 4 when 0 then 'a/' || p_brand || '.HTML' when 1 then p_brand || '.md' when 2 then 'css/' || p_brand || '.css' end as path, case p_partkey % 4 when 0 then 'html' when 1 then 'markdown' when 2 then 'css' end as kind from part where p_partkey % 4 <> 3")
def bundle_paths(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey as file_id", "concat('chosen/', case p_partkey % 4 when 0 then concat('a/', p_brand, '.HTML') when 1 then concat(p_brand, '.md') when 2 then concat('css/', p_brand, '.css') else if(p_partkey % 8 = 3, '.git/x', 'node_modules/x.js') end) as path")
    return op.bundle_paths(files).select("file_id", "path", "kind")


@query("bundle_size_guard", f"with {fx.BUNDLE_SQL} select bundle_id, count(*) as files, count(*) > 50 as too_many from files group by bundle_id")
def bundle_size_guard(spark, folder):
    return op.size_guard(fx.bundle_files(spark, folder), 50)


KINDS_SQL = "k as (select p_partkey % 97 as bundle_id, p_partkey % 97 % 2 = 0 as structured, case p_size % 5 when 0 then 'html' when 1 then 'markdown' when 2 then 'css' when 3 then 'image' else 'other' end as kind from part)"


@query("rank_import_candidates", f"""with {KINDS_SQL}, n as (select bundle_id, structured, count(*) filter (where case when structured then kind in ('html', 'markdown') else kind not in ('css', 'image') end) as candidates from k group by all)
select bundle_id, structured, candidates, case when candidates = 1 then 'take' when candidates = 0 then 'error-none' when structured then 'choose' else 'error-many' end as outcome from n""")
def rank_import_candidates(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey % 97 as bundle_id", "p_partkey % 97 % 2 = 0 as structured", "case p_size % 5 when 0 then 'html' when 1 then 'markdown' when 2 then 'css' when 3 then 'image' else 'other' end as kind")
    return op.rank_import_candidates(files)


@query("candidate_order", "select p_partkey // 20 as bundle_id, path, row_number() over (partition by p_partkey // 20 order by len(string_split(path, '/')), path) as position from (select p_partkey, repeat('d/', cast(p_size % 3 as int)) || cast(p_partkey as varchar) || '.md' as path from part)")
def candidate_order(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey div 20 as bundle_id", "concat(repeat('d/', cast(p_size % 3 as int)), p_partkey, '.md') as path")
    return op.default_candidate_order(files)


@query("embeddable_images", """select p_partkey as file_id, case p_partkey % 3 when 0 then 'image/jpeg' else 'image/png' end as mime, 'n' || cast(p_partkey as varchar) as alt from part where p_partkey % 3 <> 2 and p_size <= 30""")
def embeddable_images(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey as file_id", "concat('a/n', p_partkey, if(p_partkey % 3 = 2, '.txt', '.PNG')) as path", "p_size as length", "case p_partkey % 3 when 0 then ' image/JPEG' when 1 then ' ' end as mime")
    return op.embeddable_images(files, 30).select("file_id", "mime", "alt")


@query("image_uris", """select p_partkey as file_id, 'data:image/png;base64,' || to_base64(encode(p_name)) as uri from part where p_size <= 30""")
def image_uris(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey as file_id", "concat('n', p_partkey, '.png') as path", "p_size as length", "'' as mime", "cast(p_name as binary) as content")
    return op.embeddable_images(files, 30).select("file_id", "uri")


@query("link_stylesheets", """with css as (select distinct p_partkey % 20 as bundle_id, p_partkey % 20 % 2 = 0 as structured, case when p_size % 2 = 0 then 'C' else 'c' end || cast(p_size % 10 as varchar) || '.css' as path from part),
links as (select distinct p_partkey % 20 as bundle_id, 'c' || cast(p_size % 5 as varchar) || '.css' as path from part)
select 'used' as what, bundle_id, path from css where not structured or (bundle_id, path) in (select bundle_id, path from links)
union all select 'unreferenced', bundle_id, path from css where (bundle_id, path) not in (select bundle_id, path from links)
union all select 'clash', bundle_id, lower(path) from css group by bundle_id, lower(path) having count(distinct path) > 1""")
def link_stylesheets(spark, folder):
    part = table(spark, folder, "part")
    css = part.selectExpr("p_partkey % 20 as bundle_id", "p_partkey % 20 % 2 = 0 as structured", "concat(if(p_size % 2 = 0, 'C', 'c'), p_size % 10, '.css') as path").distinct()
    links = part.selectExpr("p_partkey % 20 as bundle_id", "concat('c', p_size % 5, '.css') as path")
    used, unreferenced, clash = op.link_stylesheets(links, css)
    row = lambda df, what, c="path": df.selectExpr(f"'{what}' as what", "bundle_id", f"{c} as path")
    return row(used, "used").unionByName(row(unreferenced, "unreferenced")).unionByName(row(clash, "clash", "name"))


@query("plan_exports", """with o as (select s_suppkey // 9 as export_id, s_suppkey, case when s_suppkey % 50 = 7 then 'a/../b' else 'out/' || cast(s_suppkey as varchar) || '.pdf' end as path from supplier),
m as (select export_id, path, path = 'a/../b' as bad, s_suppkey % 11 = 0 and path <> 'a/../b' as "exists" from o)
select export_id, path, bad, "exists", case when bool_or(bad) over (partition by export_id) then 'reject' when bool_or("exists") over (partition by export_id) then 'ask' else 'write' end as decision from m""")
def plan_exports(spark, folder):
    suppliers = table(spark, folder, "supplier")
    outputs = suppliers.selectExpr("s_suppkey div 9 as export_id", "if(s_suppkey % 50 = 7, 'a/../b', concat('out/', s_suppkey, '.pdf')) as path")
    return op.plan_exports(outputs, suppliers.where("s_suppkey % 11 = 0").selectExpr("concat('out/', s_suppkey, '.pdf') as path"))


@query("html_lint", r"""with c as (select page_id, len(regexp_extract_all(html, '(?i)<script[\s>]')) + len(regexp_extract_all(html, '(?i)<[a-z][^<>]*\son[a-z]+\s*=')) as a, len(regexp_extract_all(html, '(?i)<noscript[\s>]')) as b,
  len(regexp_extract_all(html, '(?i)<link\b[^>]*href\s*=\s*["'']?(?:https?:)?//')) as c, len(regexp_extract_all(html, '(?i)@import\b')) as d from pages)
select page_id, code, count from (select page_id, unnest(['script', 'noscript', 'external-css', 'import']) as code, unnest([a, b, c, d]) as count from c) where count > 0""")
def html_lint(spark, folder):
    return op.count_markup(table(spark, folder, "pages"))


#: Pages with markup of every kind behind them, and the bundles that they are in; lines are counted from the page's own last one.
PAGE_TAIL = """'\\n<link rel="stylesheet" href="css/' {c} if(page_id % 3 = 2, 'none', cast(page_id % 3 as string)) {c} '.css">\\n<img src="' {c}
  case page_id % 4 when 0 then 'img/A.png' when 1 then 'http://e.example/a.png' when 2 then 'img/lost.png' else 'doc.pdf' end {c} '">\\n<img srcset="img/a.png 1x, img/lost.png 2x">\\n<div ' {c}
  if(page_id % 2 = 0, 'onclick="go()" style="background:url(//e.example/x.png)"', 'class=">"') {c} '>\\n<style>\\n@import "x.css";\\np{{background:url(data:image/png;base64,AA)}}\\n</style><!-- <img src="no.png"> -->\\n<noscript>x</noscript><iframe src="page2.html"></iframe>'"""


@query("lint_pages", r"""with l as (select page_id, len(string_split(html, chr(10))) as n, list_filter(range(1, len(string_split(html, chr(10))) + 1), lambda i: regexp_matches(string_split(html, chr(10))[i], '(?i)<script[\s>]')) as scripts from pages)
select page_id, 'script' as code, list_sort(list_concat([x::int for x in scripts], case when page_id % 2 = 0 then [(n + 4)::int] else [] end)) as lines from l where len(scripts) > 0 or page_id % 2 = 0
union all select page_id, 'noscript', [(n + 9)::int] from l union all select page_id, 'stylesheet-missing', [(n + 1)::int] from l where page_id % 3 = 2
union all select page_id, 'external-resource', list_concat(case when page_id % 4 = 1 then [(n + 2)::int] else [] end, case when page_id % 2 = 0 then [(n + 4)::int] else [] end) from l where page_id % 4 <> 3
union all select page_id, 'missing-resource', list_concat(case when page_id % 4 = 2 then [(n + 2)::int] else [] end, [(n + 3)::int]) from l
union all select page_id, 'unsupported-resource', list_concat(case when page_id % 4 = 3 then [(n + 2)::int] else [] end, [(n + 9)::int]) from l
union all select page_id, 'css-import', [(n + 6)::int] from l
union all select page_id, 'external:css/9.css', [2::int] from l union all select page_id, 'import:css/9.css', [3::int] from l
union all select page_id, 'unreferenced-stylesheet:css/' || s || '.css', []::int[] from l, (values ('0'), ('1'), ('9')) v(s) where s <> cast(page_id % 3 as varchar)""")
def lint_pages(spark, folder):
    tail = PAGE_TAIL.format(c="||")
    pages = table(spark, folder, "pages").selectExpr("page_id", "page_id div 10 as bundle_id", "true as structured", "'' as base", f"concat(html, {tail}) as html")
    bundle = pages.select("bundle_id").distinct()
    files = bundle.select("bundle_id", F.explode(F.array(*[F.lit(x) for x in ("img/a.png", "doc.pdf", "page2.html", "css/0.css")])).alias("path"))
    sheets = {"css/0.css": "p{}", "css/1.css": "", "css/9.css": 'a{}\nb{background:url(http://e.example/y)}\n@import "z";'}
    css = bundle.select("bundle_id", F.explode(F.create_map(*[F.lit(x) for kv in sheets.items() for x in kv])).alias("path", "text"))
    return op.lint_pages(pages, files, css)


@query("html_refs", r"""select distinct page_id, regexp_replace(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*"[^"]*"')), '(?i)^(?:href|src)\s*=\s*"|"$', '', 'g') as ref from pages""")
def html_refs(spark, folder):
    refs = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*\"[^\"]*\""), 0), lambda m: F.regexp_replace(m, r"(?i)^(?:href|src)\s*=\s*\"|\"$", ""))
    return table(spark, folder, "pages").select("page_id", F.explode(refs).alias("ref")).distinct()


@query("sanitize_html", r"""with c as (select page_id, regexp_replace(html, '(?i)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>', '', 'g') as h from pages)
select page_id, case when regexp_matches(h, '(?i)<head[\s>]') then regexp_replace(h, '(?is)\A(.*?<head\b[^>]*>)', '\1<meta http-equiv="Content-Security-Policy" content="default-src ''none''; img-src data:; style-src ''unsafe-inline''">')
  else '<meta http-equiv="Content-Security-Policy" content="default-src ''none''; img-src data:; style-src ''unsafe-inline''">' || h end as html from c""")
def sanitize_html(spark, folder):
    return op.sanitize_html(table(spark, folder, "pages").select("page_id", "html"))


@query("css_urls", """select p_partkey, ['a' || cast(p_partkey as varchar) || '.png', 'b.png', 'c d.png'] as urls, ['s.png', 't.png'] as srcset from part""")
def css_urls(spark, folder):
    part = table(spark, folder, "part").selectExpr("p_partkey", """concat('x{background:url(a', p_partkey, '.png)} y{src:URL( "b.png" )} z{b:url(''c d.png'')}') as css""", "'s.png 1x, t.png 2x' as s")
    return part.select("p_partkey", op.css_urls(F.col("css")).alias("urls"), op.srcset_urls(F.col("s")).alias("srcset"))
