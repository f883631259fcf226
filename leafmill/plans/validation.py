"""Queries that check requests."""

from __future__ import annotations

from leafmill.operators import validation as op
from leafmill.tables import table

from .registry import query


@query("validate_queries", """with r as (select doc_id, case doc_id % 5 when 0 then '  ' else text end as q, case doc_id % 7 when 0 then null else doc_id % 25 end as k, case doc_id % 3 when 0 then ' ' when 1 then ' t ' end as tag from documents),
s as (select doc_id, trim(q, ' ' || chr(9) || chr(10)) as q, coalesce(k, 5) as k, trim(tag) as tag from r)
select doc_id, case when q = '' then 'blank' when length(q) > 2000 then 'long' when k < 1 or k > 20 then 'top_k' end as error, k as top_k, case when tag <> '' then tag end as tag from s""")
def validate_queries(spark, folder):
    rows = table(spark, folder, "documents").selectExpr("doc_id", "if(doc_id % 5 = 0, '  ', text) as query", "if(doc_id % 7 = 0, null, doc_id % 25) as top_k", "case doc_id % 3 when 0 then ' ' when 1 then ' t ' end as tag")
    return op.validate_queries(rows).select("doc_id", "error", "top_k", "tag")


@query("normalize_tags", """select p_partkey, case when p_size = 7 then null else list_distinct_ordered end as tags, case when p_size = 7 then 'long' end as error from (
  select p_partkey, p_size, case when p_brand = p_type then [p_brand, 'x'] else [p_brand, p_type, 'x'] end as list_distinct_ordered from part)""")
def normalize_tags(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", "concat(p_brand, ' ，', p_type, ',,、 ', p_brand, ', x', if(p_size = 7, concat(',', repeat('l', 256)), '')) as raw")
    return op.normalize_tags(rows).select("p_partkey", "tags", "error")


@query("normalize_file_names", """select p_partkey, case when p_size % 10 in (0, 1) then null when p_size % 2 = 0 then p_brand || '.md' else p_brand || '.txt' end as name, case p_size % 10 when 0 then 'blank' when 1 then 'blank' end as error from part""")
def normalize_file_names(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", r"case when p_size % 10 = 0 then 'a/ ' when p_size % 10 = 1 then '.md' when p_size % 2 = 0 then concat('a\\b/', p_brand) else concat(p_brand, '.txt') end as raw")
    return op.normalize_file_names(rows).select("p_partkey", "name", "error")


@query("safe_base_names", """select p_partkey, case p_size % 4 when 0 then 'document' when 1 then repeat('é', 100) when 2 then p_brand || '_x' else p_brand end as base from part""")
def safe_base_names(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", "case p_size % 4 when 0 then 'con.a.md' when 1 then concat(repeat('é', 300), '.md') when 2 then concat(' ', p_brand, '?x..') else concat(p_brand, '.HTML') end as raw")
    return op.safe_base_names(rows).select("p_partkey", "base")
