"""Retrieval over the embeddings: questions are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import retrieval as op
from leafmill.tables import table

from . import fixtures as fx
from .registry import query

SIMS_SQL = """
q as (select vec_id as query_id, embedding::double[] as qe, label as qlabel from embeddings where vec_id % 100 = 0),
c as (select vec_id as chunk_id, vec_id % 50 as document_id, embedding::double[] as ce, label from embeddings),
sims as (select query_id, chunk_id, document_id, qlabel, label, list_cosine_similarity(qe, ce) as s from q, c),
""" + fx.TAGS_SQL + ", held as (select document_id, list(tag order by tag) as tags from tags group by document_id)"  # fmt: skip


def questions(spark, folder):
    """Questions want the tag of their own label, where it is one."""
    return table(spark, folder, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding", "if(label < 7, array(concat('T', label)), null) as wanted", "label as qlabel")


def tagged_chunks(spark, folder):
    return op.with_tags(fx.chunks(spark, folder), fx.tags(spark, folder))


def _hits(spark, folder):
    return op.search(questions(spark, folder).drop("wanted"), fx.chunks(spark, folder), 5, None, exclude_self=True)


TOP_SQL = f"with {SIMS_SQL}, top as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from sims where query_id <> chunk_id qualify rank <= 5)"


@query("knn_topk", TOP_SQL + " select query_id, chunk_id, document_id, rank, round(s, 6) as similarity from top")
def knn_topk(spark, folder):
    return _hits(spark, folder).select("query_id", "chunk_id", "document_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("knn_tag_scope", f"""with {SIMS_SQL}, top as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank
  from sims left join held using (document_id) where qlabel >= 7 or tags is null or list_contains(tags, 'T' || cast(qlabel as varchar)) qualify rank <= 5)
select query_id, chunk_id, rank, round(s, 6) as similarity from top""")
def knn_tag_scope(spark, folder):
    return op.search(questions(spark, folder), tagged_chunks(spark, folder)).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("knn_tagged_only", f"""with {SIMS_SQL}, top as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank
  from sims join held using (document_id) where qlabel < 7 and list_contains(tags, 'T' || cast(qlabel as varchar)) qualify rank <= 5)
select query_id, chunk_id, rank, round(s, 6) as similarity from top""")
def knn_tagged_only(spark, folder):
    return op.search(questions(spark, folder), tagged_chunks(spark, folder), scope="tagged").select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("best_chunk_per_doc", f"""with {SIMS_SQL}, one as (select *, row_number() over (partition by query_id, document_id order by s desc, chunk_id) as nth from sims qualify nth = 1),
top as (select *, row_number() over (partition by query_id order by s desc, document_id) as rank from one qualify rank <= 5)
select query_id, document_id, chunk_id, rank, round(s, 6) as similarity from top""")
def best_chunk_per_doc(spark, folder):
    found = op.best_chunk_per_document(questions(spark, folder).drop("wanted"), fx.chunks(spark, folder), scope=None)
    return found.select("query_id", "document_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("relevance_gate", TOP_SQL + " select query_id, chunk_id, rank, round(s, 6) as similarity from top where s >= 0.35 or qlabel = 3")
def relevance_gate(spark, folder):
    hits = _hits(spark, folder).join(questions(spark, folder).selectExpr("query_id", "qlabel = 3 as relaxed"), "query_id")
    return op.relevance_gate(hits, 0.35, "relaxed").select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("low_relevance", TOP_SQL + """ select query_id, chunk_id, s < 0.4 as is_low, cast(floor(greatest(0.0, least(1.0, s)) * 100 + 0.5) as bigint) as percent,
  bool_and(s < 0.4) over (partition by query_id) as all_low from top""")
def low_relevance(spark, folder):
    return op.flag_low_relevance(_hits(spark, folder), 0.4).select("query_id", "chunk_id", "is_low", "percent", "all_low")


@query("retrieval_quality", TOP_SQL + """, per as (select query_id, max(case when rank = 1 and label = qlabel then 1 else 0 end) as one, max(case when label = qlabel then 1 else 0 end) as anyhit from top group by query_id)
select count(*) as questions, round(avg(one), 6) as hit_at_1, round(avg(anyhit), 6) as hit_at_k from per""")
def retrieval_quality(spark, folder):
    labels = table(spark, folder, "embeddings").selectExpr("vec_id as chunk_id", "label")
    hits = _hits(spark, folder).join(labels, "chunk_id").join(questions(spark, folder).select("query_id", "qlabel"), "query_id")
    return op.retrieval_quality(hits.withColumn("relevant", F.expr("label = qlabel")))


@query("document_summary", f"""with {fx.TAGS_SQL}, held as (select document_id, list(tag order by tag) as tags from tags group by document_id),
d as (select distinct vec_id % 50 as document_id from embeddings), n as (select vec_id % 50 as document_id, count(*) as chunk_count, bool_or(label = 9) as pdf from embeddings group by 1)
select document_id, coalesce(tags, []) as tags, chunk_count, pdf as has_pdf from d left join held using (document_id) left join n using (document_id)""")
def document_summary(spark, folder):
    chunks = fx.chunks(spark, folder)
    return op.document_summary(chunks.select("document_id").distinct(), fx.tags(spark, folder), chunks, chunks.where("label = 9")).select("document_id", "tags", "chunk_count", "has_pdf")


@query("tags_by_document", TOP_SQL + " select document_id, list(tag order by tag) as tags from tags where document_id in (select document_id from top) group by document_id")
def tags_by_document(spark, folder):
    return op.tags_by_document(fx.tags(spark, folder), _hits(spark, folder))


@query("distinct_tags", f"with {fx.TAGS_SQL} select distinct tag from tags")
def distinct_tags(spark, folder):
    return op.distinct_tags(fx.tags(spark, folder))


@query("chunk_document", "select o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey")
def chunk_document(spark, folder):
    chunks = table(spark, folder, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return chunks.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_suppkey")


EVIDENCE_SQL = f"""with {SIMS_SQL}, first as (
  select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from sims left join held using (document_id)
  where qlabel >= 7 or tags is null or list_contains(tags, 'T' || cast(qlabel as varchar)) qualify rank <= 5
), gated as (select * from first where s >= 0.999 and qlabel % 2 = 0 or s >= 1.1), rest as (select * from q where query_id not in (select query_id from gated)),
one as (select *, row_number() over (partition by query_id, document_id order by s desc, chunk_id) as nth from sims join held using (document_id)
  where query_id in (select query_id from rest) and qlabel < 5 and list_contains(tags, 'T' || cast(qlabel as varchar)) qualify nth = 1),
second as (select *, row_number() over (partition by query_id order by s desc, document_id) as rank from one qualify rank <= 5),
ev as (select query_id, chunk_id, document_id, rank, s, 'search' as branch from gated union all select query_id, chunk_id, document_id, rank, s, 'tagged' from second
  union all select query_id, null, null, null, null, 'none' from rest where query_id not in (select query_id from second))"""


def _evidence(spark, folder):
    """Questions of even labels accept their own vector; the others fall through to their tag, or to nothing."""
    asked = questions(spark, folder).selectExpr("*", "if(qlabel < 5, array(concat('T', qlabel)), null) as mentioned", "false as relaxed")
    even, odd = asked.where("qlabel % 2 = 0").drop("qlabel"), asked.where("qlabel % 2 = 1").drop("qlabel")
    chunks = tagged_chunks(spark, folder)
    return op.evidence(even, chunks, threshold=0.999).unionByName(op.evidence(odd, chunks, threshold=1.1))


@query("evidence", EVIDENCE_SQL + " select query_id, chunk_id, document_id, rank, round(s, 6) as similarity, branch from ev")
def evidence(spark, folder):
    return _evidence(spark, folder).select("query_id", "chunk_id", "document_id", "rank", F.round("similarity", 6).alias("similarity"), "branch")


@query("tag_match", TOP_SQL + """, carried as (select distinct query_id, tag from top join tags using (document_id)),
m as (select query_id, unnest(['T' || cast(qlabel as varchar), 'T' || cast((qlabel + 1) % 10 as varchar)]) as tag, unnest([1, 2]) as pos from q)
select query_id, list(m.tag order by pos) filter (where c.tag is not null) as matched from m left join carried c using (query_id, tag) group by query_id""")
def tag_match(spark, folder):
    asked = questions(spark, folder).selectExpr("query_id", "array(concat('T', qlabel), concat('T', (qlabel + 1) % 10)) as mentioned")
    return op.tag_match(asked, _hits(spark, folder), fx.tags(spark, folder))


@query("build_context", TOP_SQL + """, shown as (select *, case when qlabel % 2 = 0 and qlabel < 7 then ['T' || cast(qlabel as varchar)] end as matched from top left join held using (document_id)),
per as (select query_id, max(s) as best, count(*) as n, any_value(matched) as matched,
  string_agg(cast(rank as varchar) || '. 『Document ' || cast(document_id as varchar) || '』' || (case when matched is not null and len(tags) > 0 then '（タグ: ' || array_to_string(tags, '、') || '）' else '' end)
    || '（類似度 ' || printf('%.2f', s) || '）' || chr(10) || '   chunk ' || cast(chunk_id as varchar), chr(10) order by rank) as body from shown group by query_id)
select query_id, '【関連資料の抜粋（類似度上位' || cast(n as varchar) || '件）】' || chr(10)
  || (case when matched is not null then '※質問に書かれたタグ名' || array_to_string(list_transform(matched, lambda t: '「' || t || '」'), '、') || 'は、以下の資料に付けられています（『文書名』の後ろに、その文書のタグ名を示します）。' || chr(10) else '' end)
  || (case when matched is not null and best < 0.45 then 'ただし、質問との類似度は最高でも' || printf('%.2f', best) || 'で、質問の内容に直接該当する記載があるとは限りません。' || chr(10) else '' end)
  || (case when matched is null and best < 0.45 then '※以下の抜粋はいずれも関連度が低く（最高でも類似度' || printf('%.2f', best) || '）、質問に直接該当する記載は見つかりませんでした。参考程度に留め、回答の冒頭で「資料には本件に直接該当する記載がない」旨を明記してください。' || chr(10) else '' end)
  || body as context from per""")
def build_context(spark, folder):
    hits = _hits(spark, folder).join(questions(spark, folder).select("query_id", "qlabel"), "query_id")
    held = fx.tags(spark, folder).groupBy("document_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    shown = hits.join(held, "document_id", "left").selectExpr("*", "if(qlabel % 2 = 0 and qlabel < 7, array(concat('T', qlabel)), null) as matched", "concat('Document ', document_id) as title", "concat('chunk ', chunk_id) as content")
    return op.build_context(shown)
