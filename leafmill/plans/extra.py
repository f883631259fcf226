"""Queries of the remaining operators: registrations, JSON columns, review lists, text layers, embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import kernels
from leafmill.operators import ingest, reconcile
from leafmill.tables import table

from . import fixtures as fx
from .reconcile import SEGMENTS_SQL, _corrected
from .registry import query


@query("existing_registration", "select c_custkey, c_custkey % 3 = 0 as registered from customer")
def existing_registration(spark, folder):
    """Which incoming names are registered already."""
    names = table(spark, folder, "customer").selectExpr("c_custkey", "concat('f', c_custkey) as source_file_name")
    return ingest.existing_registration(names, names.where("c_custkey % 3 = 0")).select("c_custkey", "registered")


@query("replace_registrations", """with d as (select doc_id, doc_id % 2 = 0 as old, doc_id % 3 = 0 as new, doc_id % 9 <> 0 as good from documents), k as (select *, new and good as fresh from d where old or (new and good))
select 'document' as what, doc_id, case when fresh then 'new' else 'old' end as value from k union all select 'chunk', doc_id, case when fresh then 'new' else 'old' end from k
union all select 'tag', doc_id, case when fresh then 'T2' else 'T1' end from k union all select 'pdf', doc_id, case when fresh and doc_id % 5 = 0 then 'new' else 'old' end from k where old or doc_id % 5 = 0
union all select 'refused', doc_id, 'no-chunks' from d where new and not good""")
def replace_registrations(spark, folder):
    """Documents registered again: a third of all, of which every ninth has no chunk and every fifth a whole pdf."""
    docs = table(spark, folder, "documents")

    def tables(rows, name, tag, chunked, pdf):
        at = rows.selectExpr("doc_id as document_id", f"'{name}' as title", f"{1 if name == 'old' else 2} as created_at")
        return {
            "documents": at, "tags": at.selectExpr("document_id", f"'{tag}' as tag"), "chunks": at.where(chunked).selectExpr("document_id", "0 as chunk_index", f"'{name}' as content"),
            "pdfs": at.selectExpr("document_id", f"{pdf} as file_name", f"cast('{name}' as binary) as content"),
        }

    current = tables(docs.where("doc_id % 2 = 0"), "old", "T1", "true", "'f.pdf'")
    out, refused = ingest.replace_registrations(current, tables(docs.where("doc_id % 3 = 0"), "new", "T2", "document_id % 9 <> 0", "if(document_id % 5 = 0, 'f.pdf', null)"))
    value = {"documents": "title", "tags": "tag", "chunks": "content", "pdfs": "cast(content as string)"}
    rows = [df.selectExpr(f"'{t[:-1]}' as what", "document_id as doc_id", f"{value[t]} as value") for t, df in out.items()]
    return reduce(DataFrame.unionByName, [*rows, refused.selectExpr("'refused' as what", "document_id as doc_id", "reason as value")])


@query("page_texts", """with l as (select doc_id, unnest(range(1, 4)) as page, doc_id % 5 as k from documents) select doc_id, page, case when k <> 0 and not (page = 2 and k = 1) then case when page = 3 then 'page three of document ' || cast(doc_id as varchar) else 'some text that is long enough' end end as page_text from l""")
def page_texts(spark, folder):
    """The text layer's page of each page of a document; null for a thin one and for documents without a layer."""
    docs = table(spark, folder, "documents")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    layer = docs.where("doc_id % 5 <> 0").selectExpr("doc_id", "concat(if(doc_id % 2 = 0, 'some text that is long enough', 'some text that is long enough'), char(12), if(doc_id % 5 = 1, ' thin. ', 'some text that is long enough'), char(12), 'page three of document ', doc_id) as text")
    return reconcile.page_texts(pages, reconcile.split_text_layer(layer))


@query("json_columns", "select conv_id, turn, role, text as content from conversations")
def json_columns(spark, folder):
    """Structs to JSON and back, other characters than ASCII kept."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.struct("role", F.col("text").alias("content")).alias("message"))
    back = ingest.from_json(ingest.to_json(rows, "message"), "message", "role string, content string")
    return back.select("conv_id", "turn", "message.role", "message.content")


@query("assemble_segments", f"""with {SEGMENTS_SQL} select doc_id, count(*) + (doc_id % 6 = 0)::int as n_segments, (case when doc_id % 6 = 0 then 'page-review-marker:needs_review,' else '' end) || string_agg(segment_id || ':' || status, ',' order by pos) as listed from done group by doc_id""")
def assemble_segments(spark, folder):
    segments = _corrected(spark, folder)
    reviews = segments.where("doc_id % 6 = 0").select("doc_id").distinct().withColumn("reason", F.lit("check the page"))
    out = reconcile.assemble_segments(segments, reviews)
    return out.select("doc_id", F.size("segments").cast("long").alias("n_segments"), F.array_join(F.transform("segments", lambda s: F.concat(s["segment_id"], F.lit(":"), s["status"])), ",").alias("listed"))


@query("text_layer_evidence", r"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[|*_`#>~]', '', 'g'), '\.{2,}', '', 'g'), '\s+', '', 'g') as page,
  case doc_id % 4 when 0 then 'ab' when 1 then 'nowhere-to-be-found' else regexp_replace(regexp_replace(regexp_replace(left(text, 12), '[|*_`#>~]', '', 'g'), '\.{2,}', '', 'g'), '\s+', '', 'g') end as needle from (select doc_id, nfc_normalize(text) as text from documents))
select doc_id, case when length(needle) >= 3 and length(page) >= 20 then contains(page, needle) end as found from s""")
def text_layer_evidence(spark, folder):
    return _evidence(table(spark, folder, "documents"))


@query("text_layer_evidence_all")
def text_layer_evidence_all(spark, folder):
    """The same, under the name by which the tests know it."""
    return _evidence(table(spark, folder, "documents"))


def _evidence(docs):
    rows = docs.select("doc_id", kernels.squash(F.col("text")).alias("page"), kernels.squash(F.expr("case doc_id % 4 when 0 then 'ab' when 1 then 'nowhere-to-be-found' else left(text, 12) end")).alias("needle"))
    return rows.select("doc_id", reconcile.text_layer_evidence(rows, "needle", "page").alias("found"))


@query("embed_chunks")
def embed_chunks(spark, folder):
    """Every chunk of the Markdown documents with a vector of word counts."""
    from leafmill.operators import chunking

    return ingest.embed_column(chunking.chunk_documents(fx.markdown(spark, folder)), "content", dim=32)


@query("correction_similarity")
def correction_similarity(spark, folder):
    """Corrections judged by the similarity kernel, behind its native shortcuts."""
    segments = _corrected(spark, folder).select("doc_id", "pos", "segment_id", "primary_text", "alternate_text", "is_match")
    corrections = segments.where("not is_match").selectExpr("doc_id", "segment_id", "if(doc_id % 2 = 0, concat(primary_text, ' y'), 'garbled') as corrected_text", "false as still_uncertain", "'r' as reason")
    return reconcile.apply_corrections(segments, corrections).select("doc_id", "pos", "status", "final_text")
