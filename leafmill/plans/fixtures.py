"""Derived inputs: document tables made from the given ones, in Spark and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.kernels import let
from leafmill.tables import dealt, table

#: Markdown documents, one for each order with lines: headings, a sentence and a table with ditto marks.
#: Every fourth has a delimiter row that is one cell short.
MARKDOWN_SQL = """
md_lines as (
  select l_orderkey as k, l_partkey % 5 as code, l_linenumber as ln, l_partkey as pk, l_suppkey as sk,
    cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem
), md_cells as (
  select *, case when lag(code) over (partition by k order by code, ln, pk, sk, qty, cents) = code then '〃' else cast(code as varchar) end as cell from md_lines
), md_rows as (
  select k, string_agg('| ' || cell || ' | ' || cast(qty as varchar) || ' | ' || cast(cents as varchar) || ' |', chr(10) order by code, ln, pk, sk, qty, cents) as body
  from md_cells group by k
), md as (
  select o_orderkey as doc_id, concat_ws(chr(10), '# Order ' || cast(o_orderkey as varchar), '', 'Status ' || o_orderstatus || '.', '', '## Lines', '',
    '| part | qty | cents |', case when o_orderkey % 4 = 1 then '| --- | --- |' else '| --- | --- | --- |' end, body) as text
  from orders join md_rows on o_orderkey = k
)"""


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text), as MARKDOWN_SQL's md. The order lines are dealt into parts of a bounded size, so what a task sorts does not grow with the tables."""
    lines = dealt(table(spark, folder, "lineitem"), "l_orderkey").selectExpr(
        "l_orderkey as k", "struct(l_partkey % 5 as code, l_linenumber as ln, l_partkey as pk, l_suppkey as sk, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as cents) as line"
    )
    cell = lambda rows, r, i: F.when(F.get(rows, i - 1)["code"] == r["code"], F.lit("〃")).otherwise(r["code"].cast("string"))
    row = lambda rows, r, i: F.concat(F.lit("| "), cell(rows, r, i), F.lit(" | "), r["qty"].cast("string"), F.lit(" | "), r["cents"].cast("string"), F.lit(" |"))
    rows = lines.groupBy("k").agg(F.sort_array(F.collect_list("line")).alias("rows"))
    rows = rows.select("k", let(F.col("rows"), lambda rs: F.array_join(F.transform(rs, lambda r, i: row(rs, r, i)), "\n")).alias("body"))
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as doc_id", "o_orderstatus as status")
    return orders.join(rows, orders.doc_id == rows.k).selectExpr(
        "doc_id",
        r"""concat_ws('\n', concat('# Order ', doc_id), '', concat('Status ', status, '.'), '', '## Lines', '', '| part | qty | cents |',
            if(doc_id % 4 = 1, '| --- | --- |', '| --- | --- | --- |'), body) as text""",
    )


#: Documents of the embeddings and their tags; labels of 7 and more give no tag.
TAGS_SQL = "tags as (select distinct vec_id % 50 as document_id, 'T' || cast(label as varchar) as tag from embeddings where label < 7)"


def tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("label < 7").selectExpr("vec_id % 50 as document_id", "concat('T', label) as tag").distinct()


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as chunks of 50 documents."""
    return table(spark, folder, "embeddings").selectExpr("vec_id as chunk_id", "vec_id % 50 as document_id", "vec_id as chunk_index", "embedding", "label")


#: An alternate reading of the documents: equal, with misread words, or with other white space.
READING_SQL = """
ocr as (
  select doc_id, text, case doc_id % 3 when 0 then text when 1 then regexp_replace(text, '\\bthe\\b', 'tbe', 'g') else replace(text, '. ', '.  ') end as alternate from documents
)"""


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "text", r"case doc_id % 3 when 0 then text when 1 then regexp_replace(text, '\\bthe\\b', 'tbe') else replace(text, '. ', '.  ') end as alternate"
    )


#: Draft events of the event stream, ordered by (ts, event_id).
LIFE_SQL = """
life as (
  select event_id, ts, user_id as draft_id,
    case event_type when 'signup' then 'queue' when 'view' then (case when event_id % 2 = 0 then 'start' else 'progress' end)
      when 'purchase' then 'complete' when 'error' then 'fail' else 'discard' end as event,
    cast(event_id % 10 as int) as pages_done
  from events
)"""


def life(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id", "ts", "user_id as draft_id",
        """case event_type when 'signup' then 'queue' when 'view' then if(event_id % 2 = 0, 'start', 'progress')
           when 'purchase' then 'complete' when 'error' then 'fail' else 'discard' end as event""",
        "cast(event_id % 10 as int) as pages_done",
    )


#: Image bundles of the parts, and references into them.
BUNDLE_SQL = """
files as (
  select p_partkey % 20 as bundle_id, p_partkey as file_id, p_size % 3 <> 0 as structured,
    'img/' || (case when p_size % 2 = 1 then upper(replace(p_name, ' ', '-')) else replace(p_name, ' ', '-') end) || '-' || cast(p_partkey % 7 as varchar) || '.png' as path from part
), refs as (
  select p_partkey % 20 as bundle_id, p_partkey as ref_id, case p_partkey % 4
    when 0 then '../img/' || replace(p_name, ' ', '-') || '-' || cast(p_partkey % 7 as varchar) || '.png?v=1' when 1 then 'http://x.example/' || cast(p_partkey as varchar)
    when 2 then '../../' || p_brand else 'a/./b/../' || p_brand || '%20x' end as ref from part
)"""


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey % 20 as bundle_id", "p_partkey as file_id", "p_size % 3 <> 0 as structured",
        "concat('img/', if(p_size % 2 = 1, upper(replace(p_name, ' ', '-')), replace(p_name, ' ', '-')), '-', p_partkey % 7, '.png') as path",
    )


def bundle_references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey % 20 as bundle_id", "p_partkey as ref_id",
        """case p_partkey % 4 when 0 then concat('../img/', replace(p_name, ' ', '-'), '-', p_partkey % 7, '.png?v=1') when 1 then concat('http://x.example/', p_partkey)
           when 2 then concat('../../', p_brand) else concat('a/./b/../', p_brand, '%20x') end as ref""",
    )
